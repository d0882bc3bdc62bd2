"""Text operators against brute force, and their defined results on odd input."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tracemill.llm import decontaminate, licenses, simhash, substrings, textkit
from tracemill.llm.common import table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(df):
    return df.collect()


# -- simhash ---------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: [(id, fp)] -> {row number: least id reachable}."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def check_simhash(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [(d, brute_print(t)) for d, t in rows]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints)))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(docs).collect())
    assert got == want


def test_simhash_matches_brute_force(spark, sf):
    check_simhash(table(spark, sf, "documents"))


def test_simhash_on_odd_rows(odd, nothing):
    check_simhash(odd)
    assert simhash.op2_simhash(nothing).count() == 0


def test_links_of_dense_buckets_are_whole(spark):
    """A ball of values around one: more in a bucket than are compared in pairs, some only reachable over others."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 5))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    from tracemill.llm.graph import components

    got = {r["node"]: r["root"] for r in components(simhash.links(df, 2)).collect()}
    vs = [v for (v,) in signed]
    group = {v: v for v in vs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    arr = np.array(vs, dtype=np.int64).view(np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 2):
            a, b = find(vs[i]), find(vs[i + 1 + j])
            group[max(a, b)] = min(a, b)
    assert {v: got.get(v, v) for v in vs} == {v: find(v) for v in vs}


@pytest.mark.parametrize("few", [500_000, 40, 0])
def test_components_match_brute_force(spark, monkeypatch, few):
    from tracemill.llm import graph

    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    edges = [(rng.randrange(-60, 60) * 3, rng.randrange(-60, 60) * 3) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, k) for k in range(5001, 5040)] + [(7, 7)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in group if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_catches_near_copies_and_leaves_others(docs_of, odd, nothing):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for g in range(40):
        base = [rng.choice(words) for _ in range(250)]
        for c in range(rng.choice([1, 2, 3])):
            near = list(base)
            for _ in range(c * 2):
                near[rng.randrange(250)] = rng.choice(words)
            rows.append((100 * g + c, " ".join(near), "a"))
        n += 1
    kept = {r["doc_id"] for r in simhash.one_of_each(docs_of(rows)).collect()}
    assert kept == set(brute_groups([(i, t) for i, t, _ in rows]).values()) and {100 * g for g in range(40)} <= kept
    out = simhash.one_of_each(odd)
    # 7 is 6 with six words around it: 56 of 62 shingles are the same, a similarity of 0.90
    assert out.columns == odd.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, -1, 1, 4, 6, 8, 9, 10]
    assert simhash.one_of_each(nothing).count() == 0


def brute_groups(rows, similarity=0.8):
    """[(id, text)] -> {id: least id of the group}, by the Jaccard similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = {i: i for i, _ in rows}

    def find(i):
        return i if group[i] == i else find(group[i])

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(rows[a][0]), find(rows[b][0])
            group[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_copies_with_a_passage_put_in_or_cut_are_found(docs_of):
    rng = random.Random(11)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(30):
        size = rng.choice([60, 150, 500])
        base = new(size)
        at = rng.randrange(size)
        rows += [(10 * g, " ".join(base), "a"), (10 * g + 1, " ".join(base + new(size // 6)), "a"), (10 * g + 2, " ".join(base[size // 8 :]), "a")]
        rows += [(10 * g + 3, " ".join(base[:at] + new(size // 10) + base[at:]), "a")]
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs_of(rows)).collect()}
    want = brute_groups([(i, t) for i, t, _ in rows])
    assert got == want and len(set(want.values())) < 45


def test_an_unrelated_text_does_not_undo_a_link(docs_of):
    base = [f"t{k}" for k in range(60)]
    near = base[:-1] + ["other"]
    for seed in range(8):
        mixed = list(base)
        random.Random(seed).shuffle(mixed)
        rows = [(1, " ".join(mixed), "a"), (2, " ".join(base), "a"), (3, " ".join(near), "a")]
        assert sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(rows)).collect()) == [1, 2]


@pytest.mark.parametrize("block,turns", [(4096, 8), (16, 0)])
def test_a_large_group_of_near_copies_is_whole(docs_of, monkeypatch, block, turns):
    """Pairs lie about the threshold, so no text links to all others, and no single hub gathers them."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "TURNS", turns)
    rng = random.Random(21)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        near = list(base)
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), "a"))
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs_of(rows)).collect()}
    assert got == brute_groups([(i, t) for i, t, _ in rows])


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(2))
        x, y = (np.frombuffer(simhash._bitmap(s), dtype=np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_rows_that_share_an_id_are_judged_by_their_own_text(docs_of):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    docs = docs_of([(1, text("a"), "s"), (2, text("a"), "s"), (2, text("b"), "s"), (2, text("b"), "s"), (3, text("c"), "s")])
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"][0]) for r in left.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_copies_are_found_beside_texts_that_share_words_or_passages(docs_of):
    """Pairs whose own link counts, among others of the same words or the same common passage that offer themselves first."""
    rng = random.Random(12)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows, common = [], new(40)
    for g in range(12):
        base = new(150)
        for k in range(6):
            mixed = list(base)
            rng.shuffle(mixed)
            rows.append((20 * g + k, " ".join(mixed), "a"))
        # a chain in which each is near the next alone
        for k in range(6):
            rows.append((20 * g + 6 + k, " ".join(common + base[10 * k : 10 * k + 95]), "a"))
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs_of(rows)).collect()}
    assert got == brute_groups([(i, t) for i, t, _ in rows])
    assert all(got[20 * g + 11] == 20 * g + 6 and got[20 * g + 5] == 20 * g + 5 for g in range(12))


# -- substrings ------------------------------------------------------------------------------------------------------


def brute_strip(rows, size=35):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check_strip(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, substrings.op4_substring(docs).collect())) == brute_strip(rows)


def test_substrings_match_brute_force(spark, sf):
    check_strip(table(spark, sf, "documents"))


def test_substrings_on_odd_rows(odd, nothing, docs_of):
    check_strip(odd)
    assert substrings.op4_substring(nothing).count() == 0
    # one word over and over: windows overlap their own repeats
    check_strip(docs_of([(1, "a " * 36, "s"), (2, "a " * 35, "s"), (3, "b " * 34, "s"), (4, "c " * 35, "s")]))


def test_the_number_of_ranges_does_not_change_the_result(spark, sf):
    docs = table(spark, sf, "documents").limit(120)
    found = [sorted((bytes(r["sha"]), r["n_removed"], r["kept"]) for r in substrings.strip_repeats(docs, range_bytes=n)[1].collect() if r["n_removed"]) for n in (1 << 10, 1 << 25)]
    assert found[0] == found[1] and found[0]


def test_the_sketch_loses_nothing_and_lets_little_more_through():
    rng = np.random.default_rng(5)
    for keys in (10, 1000, 300_000):
        prints = rng.integers(0, 1 << 32, keys, dtype=np.uint32)
        again, twice = prints[: keys // 10], rng.integers(0, 1 << 32, keys // 20, dtype=np.uint32)
        sketch = substrings.RangeSketch(keys + len(again) + len(twice))
        for part in np.array_split(prints, 3):  # partition sketches, merged one by one
            sketch.add(part, twice[:0])
        sketch.add(again, twice)
        count = Counter(prints.tolist()) + Counter(again.tolist())
        often = np.array([count[p] > 1 for p in prints.tolist()])
        assert sketch.repeated(prints)[often].all() and sketch.repeated(twice).all()
        assert sketch.repeated(prints)[~often].mean() < 0.05


def test_few_runs_pass_whatever_the_corpus_holds(spark, docs_of, monkeypatch):
    """Ranges are sized by the text, so the share of windows that goes on doesn't grow."""
    rng = random.Random(8)
    docs = docs_of([(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(500)), "s") for i in range(400)])
    seen = []
    kept = substrings._runs_of
    monkeypatch.setattr(substrings, "_runs_of", lambda parts: seen.append(kept(parts).count()) or kept(parts))
    for n in (100, 400):
        substrings.strip_repeats(docs.limit(n))
        assert seen.pop() < 0.05 * n * 500 / 8


def test_words_that_collide_in_polynomials_are_told_apart(docs_of):
    """Thue-Morse words have equal polynomial hashes modulo 2^64, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    text = lambda w: " ".join(f"{w} x{i}" for i in range(20))
    check_strip(docs_of([(1, text(one), "s"), (2, text(other), "s"), (3, text(one) + " y", "s")]))
    w = textkit.Words([f"{one[:200]} {other[:200]} a a\0 ab {'q' * 300} {'q' * 301}".encode()])
    assert len({*w.hashes().tolist(), *w.hashes(1).tolist()}) == 14


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeated_lines_with_one_changed_word(docs_of, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(1000 + i, " ".join(word() for _ in range(400)), "s") for i in range(50)]
    for g in range(12):
        line = [word() for _ in range(10)]
        rows += [(2 * g + k, " ".join(line * 8 + [word()] + line * 8), "s") for k in range(2)]
    check_strip(docs_of(rows))


@pytest.mark.parametrize("seed", range(6))
def test_runs_hold_every_window_once(seed):
    rng = random.Random(seed)
    size = rng.choice([3, 8, 9, 20, 35])
    texts = [" ".join(rng.choice("abcdefgh"[: rng.choice([2, 8])]) for _ in range(rng.randint(0, 90))) for _ in range(20)]
    w = textkit.Words([t.encode() for t in texts])
    start, count, key = substrings.runs(w.hashes(), w, size)
    got = [s + k for s, c in zip(start.tolist(), count.tolist()) for k in range(c)]
    words = [t.split() for t in texts]
    want, at = [], 0
    for ws in words:
        want += [at + i for i in range(len(ws) - size + 1)]
        at += len(ws)
    assert got == want
    flat, keys = [x for ws in words for x in ws], {}
    for s, c, k in zip(start.tolist(), count.tolist(), key.tolist()):
        for i in range(s, s + c):
            assert keys.setdefault(tuple(flat[i : i + size]), k) == k  # equal windows have equal keys
        assert len({tuple(flat[i : i + size]) for i in range(s, s + c)}) == c


def test_grams_and_sliding():
    x = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 3, 5, 8, 35):
        g = textkit.grams(x, size)
        assert len(g) == 51 - size
        same = {}
        for i, h in enumerate(g.tolist()):
            assert same.setdefault(tuple(x[i : i + size].tolist()), h) == h
        assert len(set(same.values())) == len(same)
        assert textkit.sliding(x, size, np.minimum).tolist() == [min(x[i : i + size].tolist()) for i in range(51 - size)]


# -- licences --------------------------------------------------------------------------------------------------------


def check_licenses(docs):
    for r, row in zip(docs.select("doc_id", "text").collect(), licenses.op5_licenses(docs).collect()):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert tuple(row)[:6] == (r["doc_id"], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(","))) and 0 <= row["score"] <= 1


def test_licenses_match_brute_force(spark, sf, odd, nothing, docs_of):
    check_licenses(table(spark, sf, "documents").coalesce(1))
    check_licenses(odd.coalesce(1))
    assert licenses.op5_licenses(nothing).count() == 0
    mixed = docs_of([(1, "CC-BY cc by By cc. General (Public) LICENSE general public general public license; all rights reserved", "a"), (2, "all all rights reserved", "a")])
    check_licenses(mixed.coalesce(1))


def test_licence_spans_chain_over_gaps():
    s = licenses.Scanner(licenses.BASE, licenses.TEMPLATES)
    whole = licenses.TEMPLATES["mit"][0].replace("free of charge", "free of all charge")
    (label, start, end, share) = s.scan("before " + whole + " after")[2][0]
    assert label == "mit" and start == 1 and end == 1 + len(whole.split()) and share > 0.95
    # under the share of a template that a finding needs
    assert s.scan("x y " + " ".join(whole.split()[:20]) + " z")[1:] == ([], [])
    # whole bodies carry the labels of their passages
    bsd = " 1. ".join(licenses.TEMPLATES["bsd"][:4]) + " " + licenses.TEMPLATES["no-warranty"][2]
    assert {f[0] for f in s.scan(bsd)[2]} == {"bsd", "no-warranty"}


def brute_findings(words, templates, least, gap, cover):
    """Longest matches by trying every stretch, and chains by looking at every earlier one."""
    found = []
    every = {tuple(t[i:j]) for _, t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max((n for n in range(1, e + 1) if tuple(words[e - n : e]) in every), default=0) for e in range(len(words) + 1)]
    matches = [(e - n, n) for e, n in enumerate(longest) if n >= least and not (e < len(words) and longest[e + 1] == n + 1)]
    for label, t in templates:
        spans = sorted((s, at, n) for s, n in matches for at in range(len(t) - n + 1) if t[at : at + n] == words[s : s + n])
        chains = []
        for s, at, n in spans:
            fits = [c for c in chains if 0 <= s - c[1] <= gap and 0 <= at - c[2] <= gap]
            best = max(fits, key=lambda c: c[3], default=None)
            if best is None:
                chains.append([s, s + n, at + n, n])
            else:
                best[1:] = [s + n, at + n, best[3] + n]
        found += [(label, a, b, c / len(t)) for a, b, _, c in chains if c >= max(least, cover * len(t))]
    return Counter(found)


@pytest.mark.parametrize("seed", range(8))
def test_findings_match_brute_force(seed):
    """Repeated words, so that many chains are open at once."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdef"
    templates = {f"t{k}": [" ".join(rng.choice(letters) for _ in range(rng.randint(6, 14)))] for k in range(4)}
    s = licenses.Scanner({}, templates, least=2, gap=2, cover=0.5)
    lists = [(k, t[0].split()) for k, t in templates.items()]
    for _ in range(20):
        words = [rng.choice(letters + "z") for _ in range(40)]
        for _, t in rng.sample(lists, 2):
            at = rng.randrange(len(words))
            words[at:at] = t
        assert Counter(s.scan(" ".join(words))[2]) == brute_findings(words, lists, 2, 2, 0.5)


def test_labels_and_score_follow_from_findings(spark, sf):
    docs = table(spark, sf, "documents")
    lists = [(label, t.split()) for label, ts in licenses.TEMPLATES.items() for t in ts]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    marked = 0
    for r in licenses.op5_licenses(docs).collect():
        words = [w.decode() for w in licenses.words_of(text[r["doc_id"]])]
        if len(words) > 400:
            continue
        own = brute_findings(words, [t for t in lists if set(t[1]) & set(words)], 4, 6, 0.6)
        at = [(i, i + len(p.split()), x) for p, x in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        covered = {k for a, b, *_ in at for k in range(a, b)} | {k for _, a, b, _ in own for k in range(a, b)}
        assert r["labels"] == ",".join(sorted({x for *_, x in at} | {f[0] for f in own}))
        assert r["score"] == pytest.approx(len(covered) / len(words) if words else 0)
        marked += bool(own)
    assert marked


def test_matching_statistics_match_brute_force():
    rng = random.Random(1)
    templates = {f"t{k}": [" ".join(rng.choice("abc") for _ in range(12))] for k in range(3)}
    s = licenses.Scanner({}, templates, least=1, gap=0, cover=0.0)
    for _ in range(30):
        words = [rng.choice("abcd") for _ in range(30)]
        got = set()
        spans = {}
        s._chains = lambda found: spans.update(found) or []
        s.scan(" ".join(words))
        for t, parts in spans.items():
            own = templates[s.templates[t][0]][0].split()
            for start, at, size in parts:
                assert words[start : start + size] == own[at : at + size]
                got.add((start + size, size))
        every = {" ".join(t[0].split()[i:j]) for t in templates.values() for i in range(12) for j in range(i + 1, 13)}
        for end in range(1, 31):
            longest = max((n for n in range(1, end + 1) if " ".join(words[end - n : end]) in every), default=0)
            extends = end < 30 and longest and " ".join(words[end - longest : end + 1]) in every
            if longest and not extends:
                assert (end, longest) in got


# -- decontamination -------------------------------------------------------------------------------------------------


def brute_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_match_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 20)))) for i in range(12)]
    texts = []
    for _ in range(40):
        i, body = rng.choice(items)
        chars = list(body)
        for _ in range(rng.choice([0, 1, 3, 6, 10, 15])):
            k, a = rng.randrange(len(chars)), rng.random()
            if a < 0.34:
                chars[k] = rng.choice("abcdefgh")
            elif a < 0.67:
                chars.insert(k, rng.choice("abcdefgh"))
            else:
                del chars[k]
        texts.append(" ".join(word() for _ in range(rng.randint(0, 30))) + " " + "".join(chars) + " " + " ".join(word() for _ in range(rng.randint(0, 30))))
    texts += [None, "", "short", items[0][1]]
    index = decontaminate.Index(items, 0.1)
    got = {(t, index.ids[i]): e for t, hits in enumerate(decontaminate.leaks(index, texts)) for i, e, _ in hits}
    norm = lambda s: " ".join((s or "").lower().split())
    want = {}
    for t, text in enumerate(texts):
        for n, (i, body) in enumerate(zip(index.ids, index.text)):
            e = brute_edits("".join(map(chr, body)), norm(text))
            if e <= index.k[n]:
                want[t, i] = e
    assert got == want and len(want) > 20


def test_short_items_are_found_as_whole_words(docs_of, spark):
    items = [(1, "yes"), (2, "It is"), (3, "What is 2+2?"), (4, "seventeen"), (5, "on the table"), (6, ""), (7, None), (8, "a b")]
    texts = {
        1: "YES", 2: "yesterday eyes", 3: "so it  is\nsaid", 4: "quit is", 5: "q: what is 2+2? 4", 6: "xwhat is 2+2?", 7: "seventeenth", 8: "of seventeen",
        9: "on  The table", 10: "on the tables, on the table", 11: None, 12: "", 13: "a a b", 14: "ab a", 15: "what is 2+3?",
    }
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(d, t, "s") for d, t in texts.items()])
    norm = lambda s: " ".join((s or "").lower().split())
    want = {(d, i) for d, t in texts.items() for i, b in items if norm(b) and f" {norm(b)} " in f" {norm(t)} "}
    got = decontaminate.op6_decontamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["edits"] == 0 for r in got)
    assert {(1, 1), (3, 2), (5, 3), (8, 4), (9, 5), (10, 5), (13, 8)} == want
    for most in (8_000_000, 20):
        left = decontaminate.clean(docs, bench, most_chars=most)
        assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in want} and left.columns == docs.columns


def test_decontamination_of_tables(spark, sf, odd, nothing):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    norm = lambda s: " ".join((s or "").lower().split())
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    texts = {r["doc_id"]: norm(r["text"]) for r in docs.collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items if b in t}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.op6_decontamination(docs, bench).collect()}
    assert exact == {k for k, e in got.items() if e == 0}
    left = decontaminate.clean(docs, bench)
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in got} and left.columns == docs.columns
    blocks = decontaminate.find_leaks(docs, bench, most_chars=2000)
    assert {(r["id"], r["item"]) for r in blocks.collect()} == set(got)
    assert Counter(r["doc_id"] for r in decontaminate.clean(docs, bench, most_chars=2000).collect()) == Counter(r["doc_id"] for r in left.collect())
    assert decontaminate.op6_decontamination(odd, bench).count() == 0 and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.op6_decontamination(nothing, bench).count() == 0 and decontaminate.op6_decontamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 3, 8])
def test_banded_alignment(k):
    rng = random.Random(k)
    for _ in range(60):
        p = [rng.randrange(1, 4) for _ in range(20)]
        t = p[:]
        for _ in range(rng.randint(0, k + 2)):
            t[rng.randrange(len(t))] = rng.randrange(1, 4)
        text = [9] * 5 + t + [9] * 5
        edits, _ = decontaminate.align(np.array(p, np.uint32), np.array(text, np.uint32), 5, 1, k)
        assert min(edits, k + 1) == min(brute_edits(p, text), k + 1) or edits >= brute_edits(p, text)
