"""Operators with SQL oracles, the classifiers, the neighbour search and the pipeline."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import ann, lines, mixing, quality, sharding, toxicity
from tracemill.llm.common import table
from tracemill.llm.queries import ORACLES, QUERIES


def compare(con, sql, df, path):
    df.write.parquet(f"{path}/out")
    con.sql(f"CREATE OR REPLACE TABLE o AS {sql}")
    cols = ", ".join(sorted(c[0] for c in con.sql("DESCRIBE o").fetchall()))
    mine = f"(SELECT {cols} FROM '{path}/out/*.parquet')"
    assert con.sql(f"SELECT count(*) FROM (FROM {mine} EXCEPT ALL SELECT {cols} FROM o)").fetchall() == [(0,)]
    assert con.sql(f"SELECT count(*) FROM (SELECT {cols} FROM o EXCEPT ALL FROM {mine})").fetchall() == [(0,)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(name, spark, sf, con, tmp_path):
    compare(con, ORACLES[name], QUERIES[name](spark, sf), tmp_path)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op8_sharding", "op9_mixing"])
def test_odd_rows_match_the_sql(name, spark, odd, nothing, tmp_path):
    run = {"op1_line_dedup": lines.op1_line_dedup, "op8_sharding": sharding.op8_sharding, "op9_mixing": mixing.op9_mixing}[name]
    odd.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/docs/*.parquet'")
    compare(con, ORACLES[name], run(odd), tmp_path)
    assert run(nothing).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("sizes", [(24,), (1, 2, 3, 4, 5), (6, 9, 12)])
def test_line_links_match_brute_force(docs_of, sizes):
    rng = np.random.default_rng(2)
    some = set()
    for size in sizes:
        for b in ["".join(rng.choice(list("abñ 1"), size)) for _ in range(12)]:
            for _ in range(8):
                c = list(b)
                for _ in range(rng.integers(0, 4)):
                    k, a = rng.integers(len(c) + 1), rng.integers(3)
                    if a == 0 and k < len(c):
                        c[k] = "x"
                    elif a == 1:
                        c.insert(k, "y")
                    elif k < len(c):
                        del c[k]
                some.add("".join(c))
    some = sorted(some - {""})
    docs = docs_of([(i, x + "\n\n" + some[0], "a") for i, x in enumerate(some)])
    got = {some[r["doc_id"]]: r["n_links"] for r in lines.op1_line_dedup(docs).collect() if r["line_no"] == 0}
    assert got == {x: sum(x != y and lev(x, y) <= 2 for y in some) for x in some}


@pytest.mark.parametrize("edits", [1, 3])
def test_lines_of_all_lengths_with_other_edits(docs_of, edits):
    rng = np.random.default_rng(edits)
    some = sorted({"".join(rng.choice(list("ab7😀"), rng.integers(1, 8))) for _ in range(120)})
    got = {some[r["id"]]: r["n_links"] for r in lines.line_classes(docs_of([(i, x, "a") for i, x in enumerate(some)]), edits=edits).collect()}
    assert got == {x: sum(x != y and lev(x, y) <= edits for y in some) for x in some}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = np.random.default_rng(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(list("abc"), rng.integers(1, 60)))
        b = list("q" * int(rng.integers(0, 2)) * 40 + a)
        for _ in range(rng.integers(0, 5)):
            if b:
                b[rng.integers(len(b))] = rng.choice(list("abcé"))
        rows.append((a, "".join(b)[rng.integers(0, 3) :]))
    df = spark.createDataFrame([r for r in rows if r[1]], "a string, b string")
    wrong = df.where(lines.close(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits))
    assert wrong.count() == 0


def test_shards_are_even_and_gapless(spark, sf):
    out = sharding.op8_sharding(table(spark, sf, "documents")).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["doc_id"]):
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8)) and all([r["slot"] for r in rs] == list(range(len(rs))) for rs in by.values())
    total, most = sum(r["size"] for r in out), max(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in rs) - total / 8) <= most for rs in by.values())


def test_shards_keep_every_row(odd, nothing):
    out = sharding.shards_of(odd)
    places = Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sharding.op8_sharding(odd).collect())
    rows = out.collect()
    assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows) == places
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter((r["doc_id"], r["text"], r["source"]) for r in odd.collect())
    assert sharding.shards_of(nothing).count() == 0


def test_mixing_targets(spark, sf):
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"))
    w = {r["source"]: r for r in mixing.weights(sized, max_repeat=1.5).collect()}
    repeats = [r["quota"] / r["total"] for r in w.values()]
    assert min(repeats) == pytest.approx(1, abs=1e-3) and max(repeats) == pytest.approx(1.5, abs=1e-2)
    skewed = spark.createDataFrame([(1, "a", 900), (2, "b", 90), (3, "c", 10)], "doc_id long, source string, tokens long")
    got = mixing.weights(skewed, target_entropy=0.9).collect()
    assert -sum(r["weight"] * np.log(r["weight"]) for r in got) == pytest.approx(0.9, abs=1e-6)
    uses = Counter(r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect())
    plan = Counter(r["doc_id"] for r in mixing.op9_mixing(docs).select("doc_id").collect())
    assert uses == plan and set(uses) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_mixing_keeps_columns_and_odd_rows(odd, nothing):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() >= odd.count() and mixing.mixed(nothing).count() == 0


def auc(y, s):
    """Equal scores count half."""
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n + 1) / 2)[at]
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("name,label,least", [("op10_quality", "quality", 0.98), ("op7_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(name, label, least, spark):
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d).join(table(spark, d, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    y, s = np.array([r[label] for r in held]), np.array([r["score"] for r in held])
    assert auc(y, s) > least and np.mean(np.array([r["predicted"] for r in held]) == y) > 0.9


@pytest.mark.parametrize("run", [quality.op10_quality, toxicity.op7_toxicity], ids=["op10", "op7"])
def test_classifiers_on_odd_rows(run, odd, nothing, labels):
    out = run(odd, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 for r in out) and run(nothing, labels).count() == 0 and run(odd, labels.limit(0)).count() == len(out)


def test_quality_matches_brute_force(spark, sf):
    """The scores from tables and sums in tasks against all of it in one place."""
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.collect()
    good = {r["doc_id"] for r in marks.collect() if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    x = np.concatenate([quality.features([r["text"]]) for r in rows]).astype(np.float64)  # each text on its own
    p = np.array([r["doc_id"] in good for r in rows])
    m = {"u": x.T @ x, "p": x[p].T @ x[p]}
    measured = quality.labelled(quality.measured(docs, "doc_id", "text"), marks, "quality")
    summed = quality.moments(measured)
    assert all(np.allclose(summed[k], m[k], rtol=1e-6, atol=1e-6) for k in m)
    w = quality.fit(m, 0.6)
    at = quality.bin_of(x @ w)
    binned = quality.histogram(measured, w)
    assert np.abs(binned - np.stack([np.bincount(at, minlength=quality.BINS), np.bincount(at[p], minlength=quality.BINS)])).sum() <= 4
    prior = 0.5
    for _ in range(3):
        w = quality.fit(m, prior)
        at = quality.bin_of(x @ w)
        counts = np.stack([np.bincount(at, minlength=quality.BINS), np.bincount(at[p], minlength=quality.BINS)])
        prior = quality.prior_of(counts)
    a, b = quality.calibrate(counts, prior)
    want = dict(zip((r["doc_id"] for r in rows), 1 / (1 + np.exp(-(a * (x @ w) + b)))))
    got = {r["doc_id"]: r["score"] for r in quality.op10_quality(docs, marks).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 0.05  # a score at the edge of a bin moves the prior


def test_the_fit_is_a_minimum_of_the_non_negative_risk():
    rng = np.random.default_rng(6)
    n = 4000
    y = rng.random(n) < 0.6
    x = np.zeros((n, quality.DIM))
    x[:, 0] = 1
    x[:, 1:6] = rng.normal(size=(n, 5)) + y[:, None] * np.array([1.5, -1, 0, 0, 0.5])
    p = y & (rng.random(n) < 0.4)
    m = {"u": x.T @ x, "p": x[p].T @ x[p]}

    def risk(w, prior):
        loss = lambda z: (1 - z) ** 2 / 4
        z, reg = x @ w, w @ quality.penalty(p.sum()) @ w / 2
        return prior * loss(z[p]).mean() + max(0.0, loss(-z).mean() - prior * loss(-z[p]).mean()) + reg

    w = quality.fit(m, 0.6)
    for _ in range(200):
        assert risk(w + 0.02 * rng.normal(size=len(w)), 0.6) > risk(w, 0.6) - 1e-6
    at = quality.bin_of(x @ w)
    counts = np.stack([np.bincount(at, minlength=quality.BINS), np.bincount(at[p], minlength=quality.BINS)])
    assert abs(quality.prior_of(counts) - 0.6) < 0.1
    a, b = quality.calibrate(counts, 0.6)
    assert np.mean((a * (x @ w) + b > 0) == y) > 0.75


def test_features_of_whole_texts():
    texts = [None, "", " ", "a b", "Ab ab", "word " * 3000, "é ñ"]
    x = quality.features(texts)
    assert x.shape == (7, quality.DIM) and np.isfinite(x).all() and np.allclose(x[0], x[1]) and not x[1, quality.STYLE :].any()
    assert np.allclose(x, np.concatenate([quality.features([t]) for t in texts]))


def test_accepted_keeps_rows_unchanged(odd, labels, nothing):
    assert quality.accepted(odd, labels, 0.0).count() == odd.count() and quality.accepted(odd, labels).columns == odd.columns
    assert quality.accepted(nothing, labels).count() == 0


def test_grammar_scores_clauses_not_words():
    g = toxicity.Grammar({}, {})
    score = lambda t: g.measures(t) @ toxicity.START
    assert score("You are an idiot.") > score("The idiot.") > score("You are not an idiot.") > score("A fine day.")
    assert score("They said idiot.") < score("Idiot.") and score("I will kill you.") > score("I will kill time.")
    assert score("Kill time. You rest.") < score("Kill you. Time rests.")


def clauses(rng, n):
    """Labelled texts in which the words of a clause alone say nothing: what counts is how they stand to each other."""
    rows = []
    for i in range(n):
        w = rng.choice(["idiot", "moron", "scum", "trash", "clown", "loser"])
        v = rng.choice(["kill", "hurt", "destroy", "shoot"])
        who = rng.choice(["you", "them", "him", "her"])
        fill = lambda: " ".join("".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeou") for _ in range(3)) for _ in range(12))  # noqa: E731, B023
        toxic = [f"{who} are such an {w}", f"{w} like {who}", f"we will {v} {who}", f"{who} deserve it, {v} {who} now"]
        fine = [f"{who} are not an {w}", f"he said {who} are an {w}", f"she wrote that we {v} {who}", f"we {v} the old time", f"we never {v} {who}", f"the {w} bin"]
        y = int(rng.random() < 0.5)
        rows.append((i, f"{fill()}. {rng.choice(toxic if y else fine).capitalize()}. {fill()}.", y))
    return rows


def test_the_composed_grammar_beats_one_state(spark, docs_of, monkeypatch):
    import random

    rows = clauses(random.Random(4), 600)
    docs = docs_of([(i, t, "a") for i, t, _ in rows])
    marks = spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in rows}

    def accuracy():
        held = [r for r in toxicity.op7_toxicity(docs, marks, 0.5).collect() if r["held_out"]]
        return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])

    composed = accuracy()
    arc = lambda c: toxicity.ARCS.index(("insult" if c == toxicity.INSULT else "threat", False, False)) if c in (toxicity.INSULT, toxicity.THREAT) else -1
    monkeypatch.setattr(toxicity, "compose", lambda: (np.zeros((1, 8), int), np.array([[arc(c) for c in range(8)]])))
    one_state = accuracy()
    assert composed > 0.95 and one_state < composed - 0.15


def test_patterns_come_from_different_texts_not_from_copies(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts, marks = [], []
    base = [word() for _ in range(80)]
    for _ in range(20):
        near = list(base)
        near[rng.randrange(80)] = word()
        texts.append(" ".join(near))
        marks.append(1)
    for k in range(20):
        texts.append(" ".join([word() for _ in range(60)] + ["zonkus", "quibl" + word()[:3], "quibl" + word()[:3]]) + " " + "z" * 30_000)
        marks.append(1)
    for _ in range(300):
        texts.append(" ".join(word() for _ in range(60)))
        marks.append(0)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids, marks)), "doc_id long, toxic int")
    words, beginnings = toxicity.learn_patterns(toxicity.sample(docs, labels, 1000))[-1]
    assert {w for w in words if set(w) != {"z"}} == {"zonkus"} and {b for b in beginnings if set(b) != {"z"}} == {"quibl"}


def test_pattern_counts_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join("".join(rng.choice(list("abc"), rng.integers(2, 7))) for _ in range(8)), int(rng.integers(2)), int(rng.integers(3))) for _ in range(60)]
    got = {r["pattern"]: r for r in toxicity._counts(spark.createDataFrame(rows, "t string, y int, fold int")).collect()}
    want, kinds = Counter(), {}
    for t, y, f in rows:
        words = {w for w in t.split() if len(w) > 2}
        want.update((p, y, f) for p in words | {w[:n] + "*" for w in words for n in range(3, len(w))})
        for w in words if y else ():
            for n in range(3, len(w)):
                kinds.setdefault(w[:n] + "*", {}).setdefault(f, set()).add(w)
    assert {(p, y, f): r[f"{'nt'[y]}{f}"] for p, r in got.items() for y in (0, 1) for f in range(3) if r[f"{'nt'[y]}{f}"]} == {k: c for k, c in want.items() if any(want[k[0], 1, f] for f in range(3))}
    for p, by in kinds.items():
        assert [got[p][f"kinds{f}"] for f in range(4)] == [len(set().union(*(v for g, v in by.items() if g != f))) for f in range(4)]


def brute_neighbours(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, v in ok if i != q and len(v) == len(x))
            out[q] = d[:k]
    return out


def test_neighbours_recall(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 100, 10)
    got = {}
    for r in ann.op3_ann(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_neighbours_are_whole_whatever_the_batches(spark, kind):
    """20,000 vectors; a third of them in one dense cluster whose codes hardly differ."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 32))
    if kind == "clusters":
        x[::3] = rng.normal(size=32) + 0.05 * rng.normal(size=(len(x[::3]), 32))
        x[1::9] = x[1] + 0.3 * rng.normal(size=(len(x[1::9]), 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    answers, size = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("10000", "700"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            answers.append([tuple(r) for r in ann.nearest(df, every=500, keep=20).orderBy("query_id", "rank").collect()])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = []
    for i in range(0, len(x), 500):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        for rank, j in enumerate(sorted(np.argpartition(d, 20)[:20], key=lambda j: (d[j], j))[:10]):
            want.append((i, rank + 1, int(j), float(d[j])))
    assert answers[0] == answers[1] == want


def test_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 400)]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [None] * 6), (1004, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [1.0, 2.5]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 5, 6.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows)]
    want = brute_neighbours(f32, 100, 10)
    got = {}
    for r in ann.op3_ann(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert ann.op3_ann(df.limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, sf, odd, nothing):
    pipe = pytest.importorskip("corpus_pipeline")
    kept = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, odd, sf)
        kept[name] = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert name == "sharding" or out.columns == odd.columns
        assert {"text", "source", "lang"} <= set(out.columns) and stage(spark, nothing, sf).count() == 0
    every = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert kept["quality_classifier"] <= every and kept["sharding"] == kept["benchmark_decontamination"] == every and kept["source_mixing"] >= every
    assert set(kept["simhash_near_dedup"]) == {None, 1, 4, 6, 8, 9, 10} and kept["simhash_near_dedup"][None] == 2


def test_pipeline_stages(spark, sf, tmp_path):
    pipe = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    kept, at = [docs], docs
    for k, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, at, sf).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(at)
        if k < 4:
            assert at.columns == docs.columns
    ids = [Counter(r[0] for r in d.select("doc_id").collect()) for d in kept]
    good = {r["doc_id"] for r in quality.op10_quality(docs, table(spark, sf, "labels")).collect() if r["predicted"]}
    assert set(ids[1]) == good
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    def shingles(d):
        w = text[d].lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(d) for d in ids[1]}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    twins = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    gone = set(ids[1]) - set(ids[2])
    assert all(any((a, d) in twins for a in ids[1]) for d in gone)
    left = {(a, b) for a, b in twins if a in ids[2] and b in ids[2]}
    assert twins and not left
    norm = lambda s: " ".join(s.lower().split())
    bench = [norm(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert set(ids[3]) == {d for d in ids[2] if not any(b in norm(text[d]) for b in bench)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/2/*.parquet'")
    assert ids[4] == Counter(r[0] for r in con.sql("WITH RECURSIVE " + mixing.USES_SQL.format(docs="documents") + " SELECT doc_id FROM uses").fetchall())
    con.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{tmp_path}/3/*.parquet'")
    compare(con, sharding.OP8_SQL, kept[5], tmp_path)
    assert ids[5] == ids[4]
    assert Counter((r["doc_id"], r["text"]) for r in kept[5].collect()) == Counter((r["doc_id"], r["text"]) for r in kept[4].collect())
    assert pipe.run(spark, sf).count() == kept[5].count()
