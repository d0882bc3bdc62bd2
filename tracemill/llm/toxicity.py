"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, report, copula,
boundary, other); insults and threats carry weights. Five small transducers
read the classes side by side: one each remembers a recent target, a negation
in force, reported speech, a threat under way and an insult that waits for its
target. Their composition is built once, over the states that can be reached,
as a table (state, class) -> (state, output). An output names the arc that was
taken: an insult or threat that stands bare, is aimed, or is followed by its
target, each plain or negated, reported or not. A text's score comes from the
matched clauses alone: per kind of arc the weights of its words, each clause
bounded, times what the arc is worth, so "you are not an idiot" and "they said
idiot" can count far less than "you idiot".

What the arcs are worth starts from a prior of this grammar and is learned from
the labels by a logistic fit that is drawn to the prior, so arcs that the
labels don't show keep it. Insult patterns beyond the seed words (whole words
and word beginnings) are learned from the labels too, by counts over all texts
of the sample that the tasks add up.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, held_out, slices

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, STOP = range(8)

#: Seed words of each class, in English, German, French and Spanish. Fixed values of this grammar.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb fool imbecile garbage filth vermin ugly idioten dumm dreck abschaum imbécile crétin ordure stupide estúpido imbécil basura escoria".split(),
    THREAT: "kill hurt destroy beat punish shoot stab töten vernichten tuer détruire matar destruir".split(),
    TARGET: "you your yours they them he she him her people du dich dir euch vous toi tu te ustedes ti".split(),
    NEGATION: "not never no isn't aren't don't nicht kein nie jamais nunca".split(),
    REPORT: "said says say quoted wrote claimed reportedly called sagte schrieb disait écrivait dijo escribió".split(),
    COPULA: "is are am was were be ist sind bist est sont es son eres".split(),
}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")


def _counter(start: int):
    """A transducer that counts down from ``start`` to 0 when its class is read."""
    return lambda fires, s, c: start if c == fires else 0 if c == STOP else max(0, s - 1)


#: name -> (class that starts it, number of words it stays in force)
PARTS = {"target": (TARGET, 5), "negation": (NEGATION, 3), "report": (REPORT, 8), "threat": (THREAT, 4), "insult": (INSULT, 3)}

#: What a unit of a matched word is worth on each kind of arc before anything is learned: the logarithm of odds.
WORTH = {"insult": 2.0, "insult aimed": 3.0, "insult, then target": 1.0, "threat": 0.3, "threat aimed": 3.0, "threat, then target": 3.0}
#: What is left of it under a negation and in reported speech.
NEGATED, REPORTED = 0.15, 0.3
ARCS = list(product(WORTH, (False, True), (False, True)))
START = np.array([WORTH[kind] * (NEGATED if neg else 1.0) * (REPORTED if rep else 1.0) for kind, neg, rep in ARCS] + [-3.0])


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Tables next[state, class] and arc[state, class] (index into ARCS, -1: none) of the composed transducer; state 0 starts a clause."""
    steps = {k: _counter(n) for k, (_, n) in PARTS.items()}
    names, number = list(PARTS), {a: i for i, a in enumerate(ARCS)}
    ids: dict[tuple[int, ...], int] = {(0,) * len(names): 0}
    queue, nxt, arcs = [(0,) * len(names)], [], []
    for state in queue:
        row, out = [], []
        on = dict(zip(names, state))
        for c in range(8):
            to = tuple(steps[k](PARTS[k][0], s, c) for k, s in zip(names, state))
            if to not in ids:
                ids[to] = len(ids)
                queue.append(to)
            row.append(ids[to])
            kind = None
            if c == INSULT:
                kind = "insult aimed" if on["target"] else "insult"
            elif c == THREAT:
                kind = "threat aimed" if on["target"] else "threat"
            elif c == TARGET and on["threat"]:
                kind = "threat, then target"
            elif c == TARGET and on["insult"]:
                kind = "insult, then target"
            out.append(-1 if kind is None else number[kind, bool(on["negation"]), bool(on["report"])])
        nxt.append(row)
        arcs.append(out)
    return np.array(nxt, dtype=np.int32), np.array(arcs, dtype=np.int32)


#: Matched weight of one kind of arc that counts in one clause at most.
CLAUSE = 3.0
#: The same in a whole text: what comes on top of it says no more.
TEXT = 4.0
MEASURES = len(ARCS) + 1


class Grammar:
    """The composed transducer with its lexicon: words, and word beginnings, with a class and a weight."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.next, self.arc = (t.tolist() for t in compose())
        self.exact = {w: (c, 1.0) for c, ws in SEEDS.items() for w in ws}
        self.exact |= {w: (INSULT, v) for w, v in words.items()}
        self.exact |= {c: (STOP, 0.0) for c in ".!?;:\n"}
        self.beginnings = beginnings
        self.lengths = sorted({len(b) for b in beginnings})
        self.memo: dict[str, tuple[int, float]] = {}

    def look(self, word: str) -> tuple[int, float]:
        found = self.exact.get(word)
        if found is None:
            found = (OTHER, 0.0)
            for n in self.lengths:
                if len(word) > n and word[:n] in self.beginnings:
                    found = (INSULT, self.beginnings[word[:n]])
                    break
        return found

    def measures(self, text: str | None) -> np.ndarray:
        """What the clauses of a whole text match on each arc, up to TEXT, and 1."""
        memo, look = self.memo, self.look
        if len(memo) > 500_000:
            memo.clear()
        codes = []
        for w in WORD.findall((text or "").lower()):
            code = memo.get(w)
            if code is None:
                code = memo[w] = look(w)
            codes.append(code)
        total = np.zeros(MEASURES)
        total[-1] = 1.0
        if any(c == INSULT or c == THREAT for c, _ in codes):
            nxt, arcs, state, last, clause = self.next, self.arc, 0, 0.0, {}
            for c, weight in codes:
                arc = arcs[state][c]
                if arc >= 0:
                    # a target that follows has the weight of the word it belongs to
                    last = last if c == TARGET else weight
                    clause[arc] = clause.get(arc, 0.0) + last
                if c == STOP and clause:
                    for k, v in clause.items():
                        total[k] += min(CLAUSE, v)
                    clause = {}
                state = nxt[state][c]
            for k, v in clause.items():
                total[k] += min(CLAUSE, v)
            total[:-1] = np.minimum(TEXT, total[:-1])
        return total


def near_hashes(text: str, shingle: int = 5, least: int = 4) -> list[int]:
    """A text's few least shingle hashes; texts that share one are taken for near copies."""
    words = text.lower().split()
    return heapq.nsmallest(least, {zlib.crc32(" ".join(words[i : i + shingle]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - shingle + 1))})


FOLDS = 3
LETTERS = re.compile(r"[^\W\d_]{3,}")


def sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, id, t, y, fold, alone) for up to ``rows`` labelled documents that may be learned from, the least by a hash of their id.

    Texts are whole. ``alone`` is false for a text that has a near copy before it.
    """
    one = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    few = cut(one.select("id", "y", F.xxhash64(F.col("id").cast("string")).alias("k")).orderBy("k", "id").limit(rows))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    own = cut(text.join(F.broadcast(few), "id").groupBy("k", "id", "y").agg(F.min("t").alias("t")))

    def hashed(batches):
        for b in slices(batches):
            h = pa.array([near_hashes(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), h], names=["k", "id", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    each = cut(own.select("k", "id", "t").mapInArrow(hashed, f"k long, id {kind}, h array<long>").select(F.struct("k", "id").alias("x"), F.explode("h").alias("h")))
    after = each.join(each.groupBy("h").agg(F.min("x").alias("first")), "h").where("first < x").select("x.k", "x.id").distinct()
    out = own.join(after.withColumn("copy", F.lit(True)), ["k", "id"], "left")
    return out.select("k", "id", "t", "y", F.pmod("k", F.lit(FOLDS)).cast("int").alias("fold"), F.col("copy").isNull().alias("alone"))


def _counts(texts: DataFrame) -> DataFrame:
    """(pattern, t0.., n0.., kinds0..): in how many toxic (t) and other (n) texts of each fold a word or beginning (with a star) stands.

    kinds has for each fold, and at last for all, how many different words of toxic texts outside it begin so.
    """

    def run(batches):
        seen: Counter = Counter()

        def sent():
            keys = list(seen)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["pattern", "at", "c"])

        for b in slices(batches):
            for t, y, fold in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = set(LETTERS.findall(t.lower()))
                words |= {w[:n] + "*" for w in words for n in range(3, min(9, len(w)))}
                seen.update((w, 2 * fold + y) for w in words)
            if len(seen) > 1_000_000:
                yield sent()
                seen.clear()
        yield sent()

    part = texts.select("t", F.col("y").cast("int"), "fold").mapInArrow(run, "pattern string, at int, c long")
    cell = lambda at: F.sum(F.when(F.col("at") == at, F.col("c")).otherwise(0))
    each = part.groupBy("pattern").agg(*[cell(2 * f + y).alias(f"{'nt'[y]}{f}") for f in range(FOLDS) for y in (0, 1)])
    each = cut(each.where(" + ".join(f"t{f}" for f in range(FOLDS)) + " > 0"))
    toxic = [" + ".join(f"t{g}" for g in range(FOLDS) if g != f) + " > 0" for f in range(FOLDS + 1)]
    words = each.where("pattern NOT LIKE '%*' AND length(pattern) > 3").select(F.explode(F.expr("transform(sequence(3, least(8, length(pattern) - 1)), n -> concat(left(pattern, n), '*'))")).alias("pattern"), *[F.expr(c).alias(f"k{f}") for f, c in enumerate(toxic)])
    kinds = words.groupBy("pattern").agg(*[F.count_if(f"k{f}").alias(f"kinds{f}") for f in range(FOLDS + 1)])
    return each.join(kinds, "pattern", "left")


def learn_patterns(texts: DataFrame, log_chance: float = 14.0) -> list[tuple[dict[str, float], dict[str, float]]]:
    """Words and word beginnings that stand in toxic texts far more often than chance allows: without each fold, and at last with all.

    A pattern in t toxic and n other texts, where a share p of texts is toxic,
    needs t log(1/p) - 4 n >= log_chance: by chance alone less than one pattern in
    a million passes, and an occurrence outside toxic texts weighs heavily
    against it. A beginning needs three different words in toxic texts, else the
    word itself is the pattern; of nested beginnings the shortest is kept, made
    longer while that loses next to none of its texts. Of near copies one text
    counts, so that copies don't make a text's rare words look significant.
    Counts are added up by the tasks; the driver gets the patterns that pass.
    """
    alone = texts.where("alone")
    sums = {(r["fold"], r["y"]): r["n"] for r in alone.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    tests = []
    for f in range(FOLDS + 1):
        own = [g for g in range(FOLDS) if g != f]
        toxic, both = sum(sums.get((g, 1), 0) for g in own), sum(sums.get((g, y), 0) for g in own for y in (0, 1))
        p = min(0.5, max(1e-3, toxic / max(1, both)))
        t, n = (F.expr(" + ".join(f"{x}{g}" for g in own)) for x in "tn")
        strong = (t * math.log(1 / p) - 4 * n >= log_chance) & (t / (t + n) > max(0.8, 4 * p))
        strong &= ~F.col("pattern").endswith("*") | (F.col(f"kinds{f}") >= 3)
        tests.append(F.when(strong, F.struct(t.alias("t"), n.alias("n"))).alias(f"s{f}"))
    found = _counts(alone).select("pattern", *tests).where(" OR ".join(f"s{f} IS NOT NULL" for f in range(FOLDS + 1))).collect()
    return [_chosen({r["pattern"]: (r[f"s{f}"]["t"], r[f"s{f}"]["n"]) for r in found if r[f"s{f}"] is not None}) for f in range(FOLDS + 1)]


def _chosen(strong: dict[str, tuple[int, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the words and beginnings to keep of the strong patterns (toxic texts, other texts)."""
    weight = {k: t / (t + n + 0.5) for k, (t, n) in strong.items()}
    starts = {k[:-1] for k in strong if k[-1] == "*"}
    short = {b for b in starts if not any(b[:n] in starts for n in range(3, len(b)))}
    words = {k: w for k, w in weight.items() if k[-1] != "*" and not any(k[:n] in short and len(k) > n for n in range(3, 9))}
    longer: dict[str, list[str]] = {}
    for b in sorted(starts):
        longer.setdefault(b[:-1], []).append(b)

    def grown(b):
        while more := [x for x in longer.get(b, ()) if strong[x + "*"][0] >= 0.95 * strong[b + "*"][0]]:
            b = more[0]
        return b

    return words, {grown(b): weight[b + "*"] for b in sorted(short)}


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic regression drawn to ``start``, by damped Newton steps; the last column is the intercept."""
    t = start.copy()
    prec = ridge * np.eye(x.shape[1])
    prec[-1, -1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + prec + 1e-9 * np.eye(len(t)), x.T @ (q - y) + prec @ (t - start))
        t = t - step * min(1.0, 3 / max(1e-12, np.abs(step).max()))
    return t


def train(texts: DataFrame) -> tuple[Grammar, np.ndarray]:
    """The grammar learned from the whole ``sample``, and what its arcs are worth.

    The worth is fitted to what grammars that were learned without a text's fold
    match in it, so that it sees patterns as new texts do.
    """
    learned = [Grammar(*p) for p in learn_patterns(texts)]

    def run(batches):
        for b in slices(batches):
            x = [learned[f].measures(t) for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["x", "y"])

    got = texts.select("t", "fold", "y").mapInArrow(run, "x array<double>, y int").collect()  # the sample's bound in rows, of MEASURES numbers
    x, y = np.array([r["x"] for r in got]).reshape(-1, MEASURES), np.array([r["y"] for r in got], dtype=float)
    return learned[-1], logistic(x, y, START) if len(set(y)) > 1 else START


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12_000) -> DataFrame:
    """(id, score) for every row of ``docs``: the higher, the likelier toxic.

    The fit takes a bounded sample of labelled rows (``sample_rows``), whole
    texts; every text is scored whole. Null and empty texts match nothing and
    get the score of such a text; null ids are scored but never learned from;
    repeated rows are repeated; other columns are ignored; with no labels at all
    the seed grammar scores alone.
    """
    grammar, worth = train(cut(sample(docs, labels, sample_rows, id_col, text_col)))
    grammar.memo.clear()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            x = np.array([grammar.measures(t) for t in b.column(1).to_pylist()]).reshape(-1, MEASURES)
            score = 1 / (1 + np.exp(-np.clip(x @ worth, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double")


def op7_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    out = assess(docs, labels)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
