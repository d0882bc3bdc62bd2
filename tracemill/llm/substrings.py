"""Substring dedup behind a count-min prefilter.

A window is ``size`` consecutive words of one document; every word covered by a
window whose word sequence also starts anywhere else goes.

1. Each window has an anchor, the place of the least hash among its short word
   grams (the first of equal ones). Neighbouring windows with one anchor and the
   same longer side of it are a run; all of them hold the anchor's gram and half
   a window's words on that side. The hash of these words is the run's key.
   Equal windows have equal keys in different runs, so the number of runs of a
   key bounds the number of starts of each window in them from above, with about
   seven times fewer updates than windows.
2. Keys are counted in a count-min sketch that is dealt by ranges of the key's
   hash, as many as the corpus needs, so it never fills up and no task or driver
   holds it whole. A task sends each range what its texts' partition sketch has
   there; the range merges the parts and answers which of the sender's runs it
   estimates repeated. Answers meet the texts' numbers by the sender's portion.
3. Only texts that have such runs are read again, and only the windows of these
   runs are grouped exactly. Of texts that stand in several rows one brings its
   windows.
4. Windows found repeated go back to their text; only texts that lose a part
   of their words are read again. The others' digests are known from step 1.

Window identity is by 96 bits, 64 and 32 of two independent hashes built from
two independent 64-bit hashes of each word; text identity is by SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, slices, small
from tracemill.llm.textkit import U, Words, chunks, grams, mix, sliding

GRAM = 8  # words in an anchor's gram, or the window's size if smaller
ROWS = 2  # rows of the sketch
#: Runs in a portion of a task's texts, so that its memory stays bounded whatever its partition holds (one text alone may have more).
HELD = 2_000_000
#: Bytes of text to a range of the sketch.
RANGE = 1 << 25


def _normal(batch_column) -> list[bytes]:
    return [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in batch_column.to_pylist()]


def _pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as compressed byte planes of their differences."""
    steps = np.diff(ascending, prepend=0).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def runs(x: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run of windows, in order."""
    n, none = len(x), np.zeros(0, np.int64)
    if n < size:
        return none, none, np.zeros(0, U)
    room = np.repeat(w.first[1:], w.counts) - np.arange(n)
    s = np.flatnonzero(room[: n - size + 1] >= size)
    if not len(s):
        return none, none, np.zeros(0, U)
    gram = min(GRAM, size)
    rest = size - gram
    half = (rest + 1) // 2
    g = grams(x, gram)
    # the upper half of the hash decides, then the place
    least = sliding((g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U), rest + 1, np.minimum)
    place = (least & U(0xFFFFFFFF)).astype(np.int64)[s]
    left = place - s >= half
    new = (np.diff(s) != 1) | (np.diff(place) != 0) | (left[1:] != left[:-1]) | (room[s[1:]] > room[s[:-1]])
    at = np.flatnonzero(np.concatenate([[True], new]))
    before, after = grams(x, gram + half, 1), grams(x, size - half + 1 if rest else gram, 2)
    p, is_left = place[at], left[at]
    key = np.where(is_left, before[np.maximum(0, p - half)], after[np.minimum(p, len(after) - 1)])
    return s[at], np.diff(np.append(at, len(s))), key


def _sha(normal: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(t).digest() for t in normal]


class _Portion:
    """Some texts of a task: their runs' keys, in order."""

    def __init__(self, number: int):
        self.number, self.keys, self.held, self.texts, self.seen = number, [], 0, 0, set()

    def messages(self, ranges: int):
        """Rows (range, cells, at, twice) to the sketch's ranges, and (None, None, at, None) of the runs known to be repeated.

        cells are fingerprints of keys that stand once here, ``at`` the numbers
        of their runs, twice the fingerprints of keys that stand more often.
        """
        keys = np.concatenate([np.zeros(0, U), *self.keys])
        distinct, first, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        sure = np.flatnonzero(count[which] > 1)
        if len(sure):
            yield None, None, _pack(sure), None
        h = mix(distinct + U(1))
        to = (((h >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)
        cell, more = (h & U(0xFFFFFFFF)).astype("<u4"), count > 1
        order = np.lexsort((first, more, to))
        to, cell, more, first = to[order], cell[order], more[order], first[order]
        ends = np.flatnonzero(np.append(np.diff(to) != 0, [True])) + 1 if len(to) else to
        begin = 0
        for end in ends:
            mid = begin + int(np.searchsorted(more[begin:end], True))
            yield int(to[begin]), cell[begin:mid].tobytes(), _pack(first[begin:mid]), cell[mid:end].tobytes()
            begin = end


#: A row is a document (id, n, sha; chunk, idx, first and count too if it brings its runs), or a message to a range of the sketch,
#: or, with no range, the numbers of runs of a portion that are known to be repeated.
SURVEY = [("n", pa.int64()), ("sha", pa.binary()), ("chunk", pa.int64()), ("idx", pa.int32()), ("first", pa.int32()), ("count", pa.int32()), ("range", pa.int32()), ("cells", pa.binary()), ("at", pa.binary()), ("twice", pa.binary())]


def _survey(docs: DataFrame, kind: str, size: int, ranges: int) -> DataFrame:
    """First pass: documents, and the messages of each portion to the sketch."""
    schema = f"id {kind}, n long, sha binary, chunk long, idx int, first int, count int, range int, cells binary, at binary, twice binary"

    def batch(ids, **given):
        m = len(ids)
        cols = [pa.array(given[k], t) if k in given else pa.nulls(m, t) for k, t in SURVEY]
        return pa.RecordBatch.from_arrays([ids, *cols], names=["id", *(k for k, _ in SURVEY)])

    def run(batches):
        id_type = None
        number = TaskContext.get().partitionId() << 16
        portion = _Portion(number)

        def sent():
            for to, cells, at, twice in portion.messages(ranges):
                yield batch(pa.nulls(1, id_type), chunk=[portion.number], range=[to], cells=[cells], at=[at], twice=[twice])

        for b in slices(batches):
            normal, id_type = _normal(b.column(1)), b.column(0).type
            shas = _sha(normal)
            for i, j in chunks(normal):
                if portion.held > HELD:
                    yield from sent()
                    number += 1
                    portion = _Portion(number)
                w = Words(normal[i:j])
                enough = w.counts >= size
                # copies within a portion bring their runs once
                bring = [k for k in np.flatnonzero(enough).tolist() if not (shas[i + k] in portion.seen or portion.seen.add(shas[i + k]))]
                own = w if len(bring) == j - i else Words([normal[i + k] for k in bring])
                starts, _, keys = runs(own.hashes(), own, size)
                edges = np.searchsorted(starts, own.first)
                idx, first, count, chunk = ([None] * (j - i) for _ in range(4))
                for at, k in enumerate(bring):
                    idx[k], first[k], count[k], chunk[k] = portion.texts + at, portion.held + int(edges[at]), int(edges[at + 1] - edges[at]), portion.number
                portion.keys.append(keys)
                portion.held += len(keys)
                portion.texts += len(bring)
                yield batch(b.column(0).slice(i, j - i), n=w.counts, sha=shas[i:j], chunk=chunk, idx=idx, first=first, count=count)
        if id_type is not None:
            yield from sent()

    return docs.mapInArrow(run, schema)


def _cells(prints: np.ndarray, row: int, log2: int) -> np.ndarray:
    """Counter of each fingerprint in a row of the sketch."""
    return (mix(prints.astype(U) + U((0xA24BAED4963EE407 * (row + 1)) & (1 << 64) - 1)) >> U(64 - log2)).astype(np.int64)


class RangeSketch:
    """One range of the merged count-min sketch: counters that stop at two, eight for each key."""

    def __init__(self, keys: int):
        self.log2 = int(np.clip(np.ceil(np.log2(8 * max(1, keys))), 10, 32))
        self.one = np.zeros((ROWS, 1 << self.log2), dtype=bool)
        self.two = np.zeros((ROWS, 1 << self.log2), dtype=bool)

    def add(self, prints: np.ndarray, twice: np.ndarray) -> None:
        """Merge parts: fingerprints that stand once, or more often, in each of them."""
        for row in range(ROWS):
            cell = np.sort(_cells(prints, row, self.log2))
            self.two[row, cell[1:][cell[1:] == cell[:-1]]] = True
            self.two[row, cell[self.one[row, cell]]] = True
            self.one[row, cell] = True
            more = _cells(twice, row, self.log2)
            self.one[row, more] = self.two[row, more] = True

    def repeated(self, prints: np.ndarray) -> np.ndarray:
        """Whether the sketch estimates at least two."""
        out = np.ones(len(prints), dtype=bool)
        for row in range(ROWS):
            out &= self.two[row, _cells(prints, row, self.log2)]
        return out


def _answers(messages: DataFrame) -> DataFrame:
    """(range, chunk, cells, at, twice) -> (chunk, at): the runs of a portion whose key is estimated repeated."""

    def run(batches):
        number, parts = None, []

        def answered():
            read = lambda x: np.frombuffer(x, dtype="<u4")
            cells, twice = [read(p[1]) for p in parts], [read(p[3]) for p in parts]
            sketch = RangeSketch(sum(map(len, cells)) + sum(map(len, twice)))
            sketch.add(np.concatenate(cells), np.concatenate(twice))
            chunk, at = [], []
            for (c, _, packed, _), own in zip(parts, cells):
                hit = np.flatnonzero(sketch.repeated(own))
                if len(hit):
                    chunk.append(c)
                    at.append(_pack(_unpack(packed)[hit]))
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(at, pa.binary())], names=["chunk", "at"])

        for b in batches:
            for to, *part in zip(*(b.column(i).to_pylist() for i in range(5))):
                if to != number and parts:
                    yield answered()
                    parts = []
                number = to
                parts.append(part)
        if parts:
            yield answered()

    dealt = messages.select("range", "chunk", "cells", "at", "twice").repartition("range").sortWithinPartitions("range", "chunk")
    return dealt.mapInArrow(run, "chunk long, at binary")


#: Kinds of rows that meet by portion: answers, texts that have copies (one of each is kept, the others go), texts.
ANSWER, KEPT, GONE, TEXT = range(4)


def _hit(stream: DataFrame) -> DataFrame:
    """(chunk, kind, first, count, idx, sha, at) rows -> (num, sha, copied, at): the texts with runs estimated repeated, and which these are."""

    def run(batches):
        chunk, hits, before, marks = None, [], None, {}
        for b in batches:
            out = [], [], [], []
            for c, kind, first, count, idx, sha, at in zip(*(b.column(i).to_pylist() for i in range(7))):
                if c != chunk:
                    chunk, hits, before, marks = c, [], None, {}
                if kind == ANSWER:
                    hits.append(_unpack(at))
                elif kind != TEXT:
                    marks[first] = kind
                elif hits and marks.get(first) != GONE:
                    if before is None:
                        before = np.sort(np.concatenate(hits))
                    low, high = np.searchsorted(before, (first, first + count))
                    if high > low:
                        for col, v in zip(out, ((chunk << 22) + idx, sha, first in marks, _pack(before[low:high] - first))):
                            col.append(v)
            kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(out, kinds)], names=["num", "sha", "copied", "at"])

    return stream.repartition("chunk").sortWithinPartitions("chunk", "kind", "first").mapInArrow(run, "num long, sha binary, copied boolean, at binary")


def _reread(base: DataFrame, rows: DataFrame, hit: DataFrame) -> DataFrame:
    """(sha, words): the words of each text in ``hit``, once, found by the id of one of its rows; rows without an id are all read."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            normal = _normal(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(_sha(normal), pa.binary()), pa.array([press.compress(t) for t in normal], pa.binary())], names=["sha", "words"])

    ids = rows.join(small(hit.select("sha")), "sha", "left_semi").groupBy("sha").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("id").distinct()
    texts = base.join(small(cut(ids)), "id", "left_semi").select("t").union(base.where("id IS NULL").select("t"))
    return texts.mapInArrow(run, "sha binary, words binary").groupBy("sha").agg(F.first("words").alias("words"))


#: A text with windows estimated repeated: its compressed words (null if the text has copies and so goes whole), the first window
#: number of windows and windows before of each such run, and the hashes of all these windows.
PARTS = "num long, sha binary, words binary, start array<int>, n array<int>, before array<int>, h1 array<long>, h2 array<int>"


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """(num, sha, copied, at, words) -> PARTS."""

    def parts(num, sha, copied, at, words, normal):
        w = Words(normal)
        x = w.hashes()
        start, count, _ = runs(x, w, size)
        edges = np.searchsorted(start, w.first)
        picked = [_unpack(a) + e for a, e in zip(at, edges.tolist())]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
        hit = np.concatenate(picked)
        start, count = start[hit], count[hit]
        ends = np.concatenate([[0], np.cumsum(count)])
        windows = np.repeat(start - ends[:-1], count) + np.arange(ends[-1])
        own = np.repeat(w.first[:-1], np.diff(offsets))
        of_runs = lambda v: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v.astype(np.int32)))
        of_windows = lambda v: pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(v[windows]))
        kept = [None if c else t for c, t in zip(copied, words)]
        cols = [pa.array(num, pa.int64()), pa.array(sha, pa.binary()), pa.array(kept, pa.binary()), of_runs(start - own), of_runs(count), of_runs(ends[:-1] - np.repeat(ends[offsets[:-1]], np.diff(offsets))), of_windows(grams(x, size, 3).view(np.int64)), of_windows(grams(w.hashes(1), size, 4).view(np.int32)[::2])]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PARTS.split(", ")])

    def run(batches):
        raw = zstandard.ZstdDecompressor()
        for b in slices(batches):
            cols = [c.to_pylist() for c in b.columns]
            normal = [raw.decompress(t) for t in cols[4]]
            for i, j in chunks(normal):
                yield parts(*(c[i:j] for c in cols), normal[i:j])

    return texts.select("num", "sha", "copied", "at", "words").mapInArrow(run, PARTS)


def _runs_of(parts: DataFrame) -> DataFrame:
    """PARTS -> a row for each run: id (the text's number), start, n, r1 and r2 (hashes of its ends and length), h1, h2."""
    each = parts.select(F.col("num").alias("id"), "h1", "h2", F.inline(F.arrays_zip("start", "n", "before")))
    part = lambda h: F.slice(h, F.col("before") + 1, F.col("n"))
    each = each.select("id", "start", "n", part("h1").alias("h1"), part("h2").alias("h2"))
    ends = [F.element_at("h1", 1), F.element_at("h2", 1), F.element_at("h1", -1), F.element_at("h2", -1), F.col("n")]
    return each.select("id", "start", "n", F.xxhash64(*ends).alias("r1"), F.xxhash64(F.lit(1), *ends).alias("r2"), "h1", "h2")


#: A run that stands more often than HOT is dealt to SALTS tasks.
HOT, SALTS = 1000, 64


def _repeated(keyed: DataFrame) -> DataFrame:
    """Runs -> (id, start, n): the repeated windows.

    A run is shorter than a window, so equal runs have equal first and last
    windows and lengths (two windows less than a window apart fix every word
    between); they are first grouped by these. All windows of a run that stands
    twice are repeated. One of each run then brings its windows to the exact
    grouping, and only runs that stand once ask for its answer.
    """
    kinds = keyed.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.first(F.struct("id", "start", "h1", "h2")).alias("x")).select("r1", "r2", "c", "x.*")
    # a run that stands very often is dealt to SALTS tasks: its rows by their text, its kind to all of them
    often = cut(keyed.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1"))
    hot = small(often.where(F.col("c") > HOT).select("r1", "r2", F.lit(True).alias("hot")))
    rows = keyed.select("id", "start", "n", "r1", "r2").join(hot, ["r1", "r2"], "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = often.select("r1", "r2", F.explode(F.sequence(F.lit(0), F.when(F.col("c") > HOT, SALTS - 1).otherwise(0))).alias("salt"))
    whole = rows.join(dealt, ["r1", "r2", "salt"], "left_semi").select("id", "start", "n")
    # both uses below read all columns of the grouping, so that its exchange, the largest one, is made once
    single = (F.col("c") == 1) & F.col("id").isNotNull() & F.col("start").isNotNull()
    each = kinds.select("id", single.alias("single"), F.col("start").alias("s"), F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h"))
    each = each.select("id", "single", (F.col("s") + F.col("at")).alias("start"), "h.h1", "h.h2")
    twice = each.groupBy("h1", "h2").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("c")).where("c > 1").select("h1", "h2")
    part = each.where("single").select("id", "start", "h1", "h2").join(twice, ["h1", "h2"], "left_semi").select("id", "start", F.lit(1).alias("n"))
    return whole.union(part)


def _strip(texts: DataFrame, size: int) -> DataFrame:
    """(sha, words, at: repeated windows as start and number) -> (sha, n_removed, kept words)."""

    def run(batches):
        raw = zstandard.ZstdDecompressor()
        for b in batches:
            removed, kept = [], []
            for text, starts, counts in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = raw.decompress(text).split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(starts) + np.array(counts) - 1 + size, -1)
                stays = np.cumsum(edge)[:-1] == 0
                kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]))
                removed.append(int(len(words) - stays.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["sha", "n_removed", "kept"])

    return texts.select("sha", "words", "at.start", "at.n").mapInArrow(run, "sha binary, n_removed long, kept binary")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Find and cut repeated passages.

    Returns (per document: id, n, sha of its words; per distinct text that
    loses words: sha, n_removed, kept words as bytes, null if nothing stays).
    Null and empty texts have no words; texts shorter than a window lose none;
    a text that also stands in another row is repeated whole; repeated rows
    count as rows of their own; other columns are ignored. ``range_bytes`` is
    the text to a range of the sketch: it decides about memory, not the result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    survey = cut(_survey(base, kind, size, int(np.clip(-(-total // range_bytes), 32, 1 << 18))))
    rows = survey.where("n IS NOT NULL").select("id", "n", "sha")
    texts = survey.where("idx IS NOT NULL")
    answers = _answers(survey.where("range IS NOT NULL")).union(survey.where("n IS NULL AND range IS NULL").select("chunk", "at"))
    # texts in several rows go whole; the first portion that has one keeps it, for its windows
    whole = cut(rows.where(F.col("n") >= size).groupBy("sha").agg(F.count("*").alias("c")).where("c > 1").select("sha"))
    copies = texts.select("chunk", "first", "sha").join(small(whole), "sha", "left_semi")
    one = copies.groupBy("sha").agg(F.min(F.struct("chunk", "first")).alias("k")).select("sha", "k.*", F.lit(KEPT).alias("kind"))
    marks = copies.join(one, ["sha", "chunk", "first"], "left").select("chunk", F.coalesce("kind", F.lit(GONE)).alias("kind"), "first")
    none = lambda t: F.lit(None).cast(t)
    stream = texts.select("chunk", F.lit(TEXT).alias("kind"), "first", "count", "idx", "sha", none("binary").alias("at"))
    stream = stream.union(answers.select("chunk", F.lit(ANSWER), none("int"), none("int"), none("int"), none("binary"), "at"))
    stream = stream.union(marks.select("chunk", "kind", "first", none("int"), none("int"), none("binary"), none("binary")))
    hit = cut(_hit(stream))
    # made again for each use from the exchange of the words, which is smaller than the windows
    parts = _windows(_reread(base, rows, hit).join(hit, "sha"), size)
    at = _repeated(_runs_of(parts)).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("at")).withColumnRenamed("id", "num")
    partly = _strip(parts.where("words IS NOT NULL").select("num", "sha", "words").join(at, "num"), size)
    lost = partly.union(whole.select("sha", none("long").alias("n_removed"), none("binary").alias("kept")))
    return rows, lost


def op4_substring(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_words, n_removed, kept_sha256."""
    rows, lost = strip_repeats(docs)
    lost = lost.select("sha", F.lit(True).alias("hit"), "n_removed", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
    return rows.join(lost, "sha", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(F.col("hit"), F.coalesce("n_removed", "n")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("hit"), F.col("kept_sha256")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows SEMI JOIN repeated USING (s)),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM hits)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
