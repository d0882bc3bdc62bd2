"""Quality by positive-unlabelled learning with a non-negative risk.

Each text gives a short vector: style measures, and the shares of its words and
of its character trigrams that fall into hash buckets. With the squared loss the
non-negative PU risk

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]),   z = w.x, l(z) = (1 - z)^2 / 4

depends on the data only through first and second moments of the trusted
positives P and of the unlabelled texts U. Both are summed over the whole
tables in one distributed pass (a fixed number of sums, whatever the input),
and the risk is minimised on the driver. The class prior pi is estimated from
the tails of the scores: inf over t of P_U(z >= t) / P_P(z >= t), with an
allowance for chance (best-bin estimate), and the fit is repeated with it.
Scores are made probabilities by a logistic curve over the binned counts of the
positives, weighted to the prior, against the unlabelled rest. Labels 0 are not
used, and nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, held_out, keep_rows, slices, small
from tracemill.llm.textkit import U, Words, chunks, mix

BINS = 400
SYMBOLS = b"#$%&*@^~=<>{}[]\\/_+`"


def style(text: str | None) -> list[float]:
    """Style measures of a whole text, each between 0 and about 1."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = max(1, len(words))
    seen = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    upper, lower, high = seen[65:91].sum(), seen[97:123].sum(), seen[128:].sum()
    symbols = seen[list(SYMBOLS)].sum()
    marks = seen[list(b".,;:?")].sum()
    lines = [x for x in b.split(b"\n") if x]
    distinct = len(set(words)) / n
    twice = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
    size = min(1.0, np.log1p(n) / 10)
    per = lambda count, full: min(1.0, count / n / full)
    return [
        1.0,
        size,
        size * size,
        per(seen[124], 0.1),
        per(seen[124], 1),
        per(seen[33], 0.1),
        per(seen[33], 1),
        per(symbols, 0.1),
        per(symbols, 1),
        per(seen[48:58].sum(), 1),
        per(marks, 0.5),
        per(len(lines), 0.3),
        min(1.0, twice / 0.1),
        min(1.0, twice),
        min(1.0, max(0.0, 0.4 - distinct) / 0.4) * (n >= 30),
        min(1.0, distinct / 0.6),
        min(1.0, max(0.0, upper / max(1, upper + lower) - 0.2) / 0.3),
        upper / max(1, upper + lower),
        high / max(1, len(b)),
        min(1.0, (len(b) - len(lines)) / n / 12),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(len(words) == 0),
    ]


STYLE = len(style(""))
#: Buckets of hashed words and of hashed character trigrams.
WORDS, TRIGRAMS = 48, 48
DIM = STYLE + WORDS + TRIGRAMS


def _shares(owner: np.ndarray, hashes: np.ndarray, texts: int, buckets: int) -> np.ndarray:
    """For each text the shares of its hashes that fall into each bucket, scaled to 1 where they are even."""
    at = (mix(hashes) >> U(40)).astype(np.int64) % buckets
    count = np.bincount(owner * buckets + at, minlength=texts * buckets).reshape(texts, buckets)
    return count * buckets / np.maximum(1, count.sum(axis=1, keepdims=True)) / 4


def features(texts: list[str | None]) -> np.ndarray:
    """The vectors of whole texts, a row each, in half precision."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    normal = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    for i, j in chunks(normal):
        w = Words(normal[i:j])
        out[i:j, :STYLE] = [style(t) for t in texts[i:j]]
        out[i:j, STYLE : STYLE + WORDS] = _shares(np.repeat(np.arange(j - i), w.counts), w.hashes(), j - i, WORDS)
        buf = w.buf.astype(U)
        grams = buf[:-2] | buf[1:-1] << U(8) | buf[2:] << U(16)
        begin = np.cumsum([0] + [len(t) + 1 if t else 0 for t in normal[i:j]])
        owner = np.searchsorted(begin, np.arange(len(grams)), side="right") - 1
        inside = np.arange(len(grams)) + 2 < begin[owner + 1]  # up to the space that ends a text
        out[i:j, STYLE + WORDS :] = _shares(owner[inside], grams[inside], j - i, TRIGRAMS)
    return out.astype(np.float16)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) for every row: the vector of its whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            x = pa.array([v.tobytes() for v in features(b.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, x binary")


def _matrix(batch, index: int = 0) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(index).to_pylist()), dtype=np.float16).reshape(-1, DIM).astype(np.float64)


def moments(rows: DataFrame) -> dict[str, np.ndarray]:
    """Sums of x x' over (x, positive) rows for all rows and for the positives. x[0] is 1, so counts and means are in them."""

    def run(batches):
        total = np.zeros((2, DIM, DIM))
        for b in batches:
            x, p = _matrix(b), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            total[0] += x.T @ x
            total[1] += x[p].T @ x[p]
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "v"])

    got = rows.select("x", "positive").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # 2 DIM^2 rows
    flat = np.zeros(2 * DIM * DIM)
    for r in got:
        flat[r["cell"]] = r["v"]
    u, p = flat.reshape(2, DIM, DIM)
    return {"u": u, "p": p}


def penalty(n: float, ridge: float = 1e-3, hashed: float = 30.0) -> np.ndarray:
    """Ridge: a little for style measures, and for hashed shares the more the fewer positives there are."""
    return np.diag(np.concatenate([np.full(STYLE, ridge), np.full(WORDS + TRIGRAMS, ridge + hashed / max(1.0, np.sqrt(n)))]))


def fit(m: dict[str, np.ndarray], prior: float, steps: int = 400) -> np.ndarray:
    """Minimise the non-negative PU risk for squared loss, from the unbiased solution on."""
    mu, mp = m["u"] / max(1.0, m["u"][0, 0]), m["p"] / max(1.0, m["p"][0, 0])
    reg = penalty(m["p"][0, 0])
    # unbiased risk: l(z) - l(-z) = -z, so grad = -pi E_P[x] + (E_U[x] + M_U w) / 2
    w = np.linalg.solve(mu / 2 + reg, prior * mp[0] - mu[0] / 2)
    rate = 0.5 / np.linalg.norm(mu + prior * mp + reg, 2)
    for _ in range(steps):
        negative = (1 + 2 * mu[0] @ w + w @ mu @ w) / 4 - prior * (1 + 2 * mp[0] @ w + w @ mp @ w) / 4
        up = prior * (mp @ w - mp[0]) / 2
        down = (mu[0] + mu @ w) / 2 - prior * (mp[0] + mp @ w) / 2
        # where the negatives' part has gone below nought it is raised again, as the corrected estimator asks
        w = w - rate * (up + down + reg @ w if negative >= 0 else -down)
    return w


def histogram(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Counts of scores z in BINS bins over [-3, 3], of all rows and of the trusted positives."""

    def run(batches):
        total = np.zeros((2, BINS))
        for b in batches:
            at = bin_of(_matrix(b) @ w)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at[b.column(1).to_numpy(zero_copy_only=False).astype(bool)], minlength=BINS)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "v"])

    flat = np.zeros(2 * BINS)
    for r in rows.select("x", "positive").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        flat[r["cell"]] = r["v"]
    return flat.reshape(2, BINS)


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 3) / 6 * BINS, 0, BINS - 1).astype(np.int64)


def prior_of(counts: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled."""
    u, p = counts[0], counts[1]
    nu, np_ = u.sum(), p.sum()
    if not nu or not np_:
        return 0.5
    qu, qp = np.cumsum(u[::-1])[::-1] / nu, np.cumsum(p[::-1])[::-1] / np_
    chance = np.sqrt(np.log(4 / delta) / 2 / nu) + np.sqrt(np.log(4 / delta) / 2 / np_)
    ok = qp > 0
    bound = np.where(ok, (qu + chance) / np.maximum(qp, 1e-12), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.95))


def calibrate(counts: np.ndarray, prior: float, steps: int = 100) -> tuple[float, float]:
    """Logistic curve a z + b, by damped Newton steps, for the positives expected in each bin against what else is there."""
    u, p = counts
    n1 = prior * u.sum() * p / max(1.0, p.sum())
    n0 = np.maximum(0.0, u - n1)
    z = (np.arange(BINS) + 0.5) / BINS * 6 - 3
    x = np.stack([z, np.ones(BINS)], axis=1)
    n = n0 + n1
    t = np.array([2.0, 0.0])
    prec = 1e-2 * np.eye(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (n * q - n1) + prec @ t
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + prec, grad)
        t = t - step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
    return float(t[0]), float(t[1])


def train(rows: DataFrame, rounds: int = 3) -> dict:
    """Fit on (x, positive) rows: trusted positives among unlabelled ones."""
    m = moments(rows)
    prior, w = 0.5, np.zeros(DIM)
    if m["p"][0, 0] == 0:
        return {"w": w, "a": 0.0, "b": 0.0, "prior": prior}
    counts = None
    for _ in range(rounds):
        w = fit(m, prior)
        counts = histogram(rows, w)
        prior = prior_of(counts)
    a, b = calibrate(counts, prior)
    return {"w": w, "a": a, "b": b, "prior": prior}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["a"] * (x @ model["w"]) + model["b"], -30, 30)))


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """(id, x) -> (id, score), each in [0, 1]."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(_matrix(b, 1), model))], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Add ``positive``: whether the row has label 1 and may be learned from. Repeated labels of an id: the greatest."""
    one = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    good = small(cut(one.where("y = 1").select("id", F.lit(True).alias("positive"))))
    return rows.join(good, "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``; more likely of quality 1 the higher.

    Null and empty texts are scored by their measures like any other; null ids
    are scored but never learned from; repeated rows are repeated; other
    columns are ignored; without any trusted positive each score is 0.5.
    """
    x = cut(measured(docs, id_col, text_col))
    return scored(x, train(labelled(x, labels, "quality")))


def op10_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    out = assess(docs, labels)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more, unchanged) that score at least ``threshold``.

    Texts are scored where they lie: there is no join and no shuffle of texts.
    Null, empty and repeated texts and null ids are treated as by ``assess``;
    an empty table gives an empty result; without any trusted positive each row
    scores 0.5 and goes unless the threshold allows it.
    """
    x = cut(measured(docs, "doc_id", "text"))
    model = train(labelled(x, labels, "quality"))
    return keep_rows(docs, "text", lambda texts: scores(features(texts).astype(np.float64), model) >= threshold)
