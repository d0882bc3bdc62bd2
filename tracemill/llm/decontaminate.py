"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

An item of n characters that stands in a text with at most k edits shares at
least n - q + 1 - k q character q-grams with it, all on diagonals at most k
apart. Shared q-grams are therefore counted per item in bands of 2 (k + 1)
diagonals that overlap by half, so that one band holds them all; only bands
that reach the bound are aligned, and only alignments within the budget count.
Items under 2 q characters have no budget: they count where they stand exactly,
as whole words. Those under q characters have no q-gram and are looked up by
their words.
Texts and items are compared in lower case with each run of white space as one
space. Each text is scanned whole, where it lies: there is no shuffle of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, keep_rows, slices, small
from tracemill.llm.textkit import U

Q = 8
BASE = U(0x9E3779B97F4A7C15)
CHUNK = 1 << 19  # characters scanned at a time, unless one text alone is longer


def normal(text: str | None) -> np.ndarray:
    """Code points of a text in lower case with runs of white space as one space."""
    s = " ".join((text or "").lower().split())
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _string(x: np.ndarray) -> str:
    return x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def qgrams(x: np.ndarray) -> np.ndarray:
    """Polynomial hash of the Q characters from each place on."""
    h, base, width = x.astype(np.uint64), BASE, 1
    if len(x) < Q:
        return h[:0]
    while width < Q:
        h = h[:-width] * base + h[width:]
        base = U(int(base) * int(base) & (1 << 64) - 1)
        width *= 2
    return h


class Index:
    """q-grams of benchmark items, with each item's edit budget and bound."""

    BITS = 21

    def __init__(self, items: list[tuple[object, str]], rate: float):
        kept = [(i, x) for i, x in ((i, normal(t)) for i, t in items) if len(x)]
        self.ids = [i for i, _ in kept]
        self.text = [x for _, x in kept]
        self.n = np.array([len(x) for x in self.text], dtype=np.int64)
        # the budget never exceeds what the bound can tell from nothing
        self.k = np.clip((rate * self.n).astype(np.int64), 0, np.maximum(0, (self.n - Q) // Q))
        self.bound = self.n - Q + 1 - self.k * Q
        #: items without a q-gram by their words, and the numbers of words these have
        self.tiny: dict[tuple[str, ...], list[int]] = {}
        for i in np.flatnonzero(self.n < Q).tolist():
            self.tiny.setdefault(tuple(_string(self.text[i]).split()), []).append(i)
        self.tiny_words = sorted({len(w) for w in self.tiny})
        grams = [qgrams(x) for x in self.text]
        all_ = np.concatenate([np.zeros(0, U), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(all_, kind="stable")
        self.grams, first = np.unique(all_[order], return_index=True)
        self.item, self.at = item[order], at[order]
        self.first = np.append(first, len(order))
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self._slot(self.grams)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U(0xD6E8FEB86659FD93)) >> U(64 - self.BITS)).astype(np.int64)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) pairs of a character array whose shared q-grams reach the item's bound."""
        none = np.zeros(0, np.int64)
        if len(x) < Q or not len(self.grams):
            return none, none
        h = qgrams(x)
        pos = np.flatnonzero(self.maybe[self._slot(h)])
        g = np.searchsorted(self.grams, h[pos])
        ok = self.grams[np.minimum(g, len(self.grams) - 1)] == h[pos]
        pos, g = pos[ok], g[ok]
        count = self.first[g + 1] - self.first[g]
        where = np.repeat(self.first[g] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item = self.item[where]
        diagonal = np.repeat(pos, count) - self.at[where] + self.n.max()  # never negative
        band = diagonal // (self.k[item] + 1)
        key, hits = np.unique(item * (1 << 40) + band, return_counts=True)
        # a band and the next one together are 2 (k + 1) diagonals wide
        after = np.searchsorted(key, key + 1)
        joined = hits + np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), hits[np.minimum(after, len(key) - 1)], 0)
        good = joined >= self.bound[key >> 40]
        return key[good] >> 40, key[good] & ((1 << 40) - 1)

    def short(self, x: np.ndarray) -> dict[int, int]:
        """The items without a q-gram that stand in a character array as whole words, each with the end of its first place."""
        found: dict[int, int] = {}
        if self.tiny and len(x):
            words = _string(x).split(" ")
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            for k in self.tiny_words:
                for at, own in enumerate(zip(*(words[j:] for j in range(k)))):
                    for i in self.tiny.get(own, ()):
                        found.setdefault(i, int(ends[at + k - 1]))
        return found

    def span(self, item: int, band: int) -> tuple[int, int]:
        """First diagonal and number of diagonals of a candidate's two bands."""
        k = int(self.k[item])
        return band * (k + 1) - int(self.n.max()), 2 * (k + 1)


def align(pattern: np.ndarray, text: np.ndarray, low: int, width: int, k: int) -> tuple[int, int]:
    """Least edits of the whole pattern against some stretch of the text, on ``width`` diagonals from ``low`` and k to each side; where it ends.

    Text characters outside the text match nothing.
    """
    start, width = low - k, width + 2 * k
    n = len(pattern)
    t = np.zeros(n + width, dtype=np.uint32)
    a, b = max(0, start), min(len(text), start + len(t))
    if b > a:
        t[a - start : b - start] = text[a:b]
    ramp = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i in range(n):
        new = row + (t[i : i + width] != pattern[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > k:
            return k + 1, 0
    best = int(row.argmin())
    return int(row[best]), start + n + best


def _whole(text: np.ndarray, begin: int, end: int) -> bool:
    """Whether a stretch of a text begins and ends with words."""
    return (begin <= 0 or text[begin - 1] == 32) and (end >= len(text) or text[end] == 32)


def _exact(index: Index, item: int, text: np.ndarray, low: int, width: int) -> int | None:
    """Where a short item first stands in a text as whole words, beginning on one of the diagonals."""
    n = int(index.n[item])
    for begin in range(max(0, low), min(len(text) - n, low + width - 1) + 1):
        if np.array_equal(text[begin : begin + n], index.text[item]) and _whole(text, begin, begin + n):
            return begin + n
    return None


def leaks(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """For each text the items found: (item number, edits, where it ends), the best place of each item."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        j, total, part = i, 0, []
        while j < len(texts) and (j == i or total < CHUNK):
            part.append(normal(texts[j]))
            total += len(part[-1]) + 1
            j += 1
        # a zero parts the texts: it stands in no item, so no q-gram crosses it
        ends = np.cumsum([len(x) + 1 for x in part])
        joined = np.zeros(int(ends[-1]), dtype=np.uint32)
        for x, e in zip(part, ends):
            joined[e - 1 - len(x) : e - 1] = x
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, band in zip(*(c.tolist() for c in index.candidates(joined))):
            low, width = index.span(item, band)
            n, k = int(index.n[item]), int(index.k[item])
            # every text that the candidate's region touches
            for d in range(int(np.searchsorted(ends, max(0, low), side="right")), len(part)):
                begin = int(ends[d]) - 1 - len(part[d])
                if begin >= low + width + n + k:
                    break
                if n < 2 * Q:
                    end = _exact(index, item, part[d], low - begin, width)
                    if end is not None:
                        best[d, item] = min(best.get((d, item), (1, 0)), (0, end))
                    continue
                edits, end = align(index.text[item], part[d], low - begin, width, k)
                if edits <= k and (edits, end) < best.get((d, item), (k + 1, 0)):
                    best[d, item] = (edits, end)
        for d, x in enumerate(part) if index.tiny else ():
            best |= {(d, item): (0, end) for item, end in index.short(x).items()}
        for (d, item), (edits, end) in sorted(best.items()):
            out[i + d].append((item, edits, end))
        i = j
    return out


def _parts(benchmark: DataFrame, text_col: str, most_chars: int) -> int:
    """Blocks of about ``most_chars`` characters, each small enough to be sent to every task."""
    total = benchmark.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    return int(max(1, -(-total // most_chars)))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, parts: int):
    """The items in blocks, by a hash."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).orderBy("i", "t").collect()
        yield [(r["i"], r["t"]) for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.1, most_chars: int = 8_000_000) -> DataFrame:
    """(id, item, edits, share, end) for each benchmark item found in each row of ``docs``.

    An item is found where its text stands with at most ``rate`` of its length
    in edits (items under 2 Q characters: exactly, as whole words); ``end`` is
    where it ends in the normalised text. Null and empty items are found
    nowhere. A benchmark over ``most_chars`` characters is handled in blocks, one
    pass after the other, so that the driver and the tasks hold one at a time.
    Null and empty texts hold nothing; null ids are returned as they are;
    repeated rows give repeated results; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found, parts = None, _parts(benchmark, item_text, most_chars)
    for items in _blocks(benchmark, item_col, item_text, parts):
        part = base.mapInArrow(_finder(Index(items, rate), item_kind), f"id {kind}, item {item_kind}, edits int, share double, end long")
        if parts > 1:
            part = cut(part)
        found = part if found is None else found.union(part)
    return found


def _finder(index: Index, item_kind: str):
    def run(batches):
        for b in slices(batches):
            got = leaks(index, b.column(1).to_pylist())
            rows = [(i, *hit) for i, hits in enumerate(got) for hit in hits]
            if rows:
                at, item, edits, end = (np.array(c) for c in zip(*rows))
                share = edits / index.n[item]
                ids = pa.array([index.ids[k] for k in item], pa.string() if item_kind == "string" else None)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), ids, pa.array(edits, pa.int32()), pa.array(share), pa.array(end, pa.int64())], names=["id", "item", "edits", "share", "end"])

    return run


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each benchmark item found in each document: doc_id, item_id, edits, share, end."""
    out = find_leaks(docs, benchmark)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "share", "end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, most_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged: texts are filtered where they lie.

    Items count as in ``find_leaks``. Null and empty texts hold nothing and
    stay; ties and repeated rows are judged alike; null ids and extra columns,
    whatever their names, don't matter; empty tables give all of ``docs``. With
    a benchmark of several blocks, each block's filter is one pass that notes
    the hashes of the texts that go.
    """
    parts = _parts(benchmark, "text", most_chars)
    blocks = _blocks(benchmark, "item_id", "text", parts)
    if parts == 1:
        index = Index(next(blocks), rate)
        return keep_rows(docs, "text", lambda texts: [not hits for hits in leaks(index, texts)])
    text = F.col("text").cast("string")
    gone = None
    for items in blocks:
        index = Index(items, rate)
        part = keep_rows(docs.select(text.alias("text")), "text", lambda texts, index=index: [bool(hits) for hits in leaks(index, texts)])
        part = cut(part.select(F.xxhash64("text").alias("_h"), F.xxhash64(F.reverse("text")).alias("_r")).distinct())
        gone = part if gone is None else gone.union(part)
    gone = small(cut(gone.distinct()))
    return docs.join(gone, (F.xxhash64(text) == gone["_h"]) & (F.xxhash64(F.reverse(text)) == gone["_r"]), "left_anti")
