"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

Fingerprints are reduced to their distinct values first, so copies cost
nothing further. A distinct value is cut into 8 blocks of 8 bits; two values
that differ in at most d bits agree on at least 8-d blocks, so each value is
sent to C(8, d) tables keyed by the blocks it keeps (28 tables with 48-bit
keys for d = 2). All values in one bucket agree on the key and hence lie in a
space of 2^(8d) values; within it neighbours are found by probing the few
masks of up to d bits, so the work in a bucket of m values is O(m log m), and
only a spanning forest of the verified links leaves it (at most m-1 rows).
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracemill.llm.common import cut, slices, small, tight
from tracemill.llm.graph import components
from tracemill.llm.textkit import Words, chunks, grams, mix

BLOCKS, WIDTH = 8, 8
#: Shingles hashed at a time, so that a very long text needs bounded memory beside itself.
STEP = 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : at + min(STEP, n - at) + shingle - 1]
        hashes = [digest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(shingle)))] or [digest(b" ".join(part), 42)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += _column_sums(bits)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of the 64 columns of 0/1 bytes; eight byte lanes are added at once, 255 rows at most."""
    lanes = bits.view(np.uint64)
    parts = [lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8) for i in range(0, len(lanes), 255)]
    return np.sum(parts, axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row of ``docs``; a null or empty text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(distance: int) -> list[int]:
    """For each choice of ``distance`` blocks to ignore, the mask of the blocks kept, as a signed long."""
    out = []
    for gone in combinations(range(BLOCKS), distance):
        keep = sum(((1 << WIDTH) - 1) << (WIDTH * i) for i in range(BLOCKS) if i not in gone)
        out.append(keep - (1 << 64) if keep >> 63 else keep)
    return out


def _probes(free: np.uint64, distance: int) -> np.ndarray:
    bits = [np.uint64(1) << np.uint64(i) for i in range(64) if int(free) >> i & 1]
    return np.array([np.bitwise_or.reduce(c) for k in range(1, distance + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _forest(fps: np.ndarray, free: np.uint64, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among the sorted distinct ``fps`` of one bucket."""
    m = len(fps)
    if m <= 64:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
    else:
        left, right = [], []
        for mask in _probes(free, distance):
            at = np.minimum(np.searchsorted(fps, fps ^ mask), m - 1)
            hit = np.nonzero((fps[at] == fps ^ mask) & (at > np.arange(m)))[0]
            left.append(hit)
            right.append(at[hit])
        i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.nonzero(label != np.arange(m))[0]
    return fps[own], fps[label[own]]


def links(values: DataFrame, distance: int = 2) -> DataFrame:
    """(fp) distinct longs -> (a, b): links within ``distance`` bits, a spanning forest of each bucket."""
    masks = block_masks(distance)
    key = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("t") + 1).bitwiseAND(F.col("fp"))
    # one pass over (table, value); each bucket is whole in one task and bounded by 2^(8 distance) values
    dealt = values.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t")).withColumn("k", key)
    dealt = dealt.repartition("t", "k").sortWithinPartitions("t", "k", "fp").select("t", "fp")
    wide = np.array(masks, dtype=np.int64).view(np.uint64)

    def run(batches):
        t0, f0 = np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def edges(t, f):
            k = f & wide[t]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], len(t))
            left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                x, y = _forest(np.sort(f[s:e]), ~wide[t[s]], distance)
                left.append(x)
                right.append(y)
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            t = np.concatenate([t0, batch.column(0).to_numpy()])
            f = np.concatenate([f0, batch.column(1).to_numpy().view(np.uint64)])
            k = f & wide[t]
            last = np.nonzero((t != t[-1]) | (k != k[-1]))[0]
            at = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if at:
                yield edges(t[:at], f[:at])
            t0, f0 = t[at:], f[at:]
        if len(t0):
            yield edges(t0, f0)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id (the least id reachable over links).

    Null ids take part by their text and get the least id of their component,
    null if it has none; null and empty texts have fingerprint 0 and are linked
    like any other; repeated rows give repeated results; further columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(fps.select("fp").distinct(), distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    # a group of copies is one key of the rows: where the distinct values are few, the rows stay where they are
    return fps.join(small(by_fp), "fp").select("id", "fp", "component_id")


def op2_simhash(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _content(words: list[bytes]) -> int:
    """64-bit hash of a word sequence."""
    return xxhash.xxh64_intdigest(b" ".join(words), 1)


def _normal(texts) -> list[bytes]:
    return [b" ".join(_words(t)) for t in texts]


def _sets(normal: list[bytes], shingle: int):
    """Sorted distinct 64-bit hashes of each text's word shingles (fewer words: the whole sequence), text by text."""
    for i, j in chunks(normal):
        w = Words(normal[i:j])
        g = grams(w.hashes(), shingle)
        for t, at, n in zip(normal[i:j], w.first.tolist(), w.counts.tolist()):
            if n >= shingle:
                yield np.unique(g[at : at + n - shingle + 1])
            else:
                yield np.array([xxhash.xxh64_intdigest(t, 42)] if n else [], dtype=np.uint64)


def contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, c, fp): a hash of each text's word sequence, and its fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            c = np.array([_content(_words(t)) for t in texts], dtype=np.uint64).view(np.int64)
            fp = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), fp], names=["id", "c", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, c long, fp long")


#: log2 of the counters that tell common shingles from rare ones, and of those in a piece.
COUNTERS, PIECE = 22, 18


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _commonness(texts: DataFrame, shingle: int) -> np.ndarray:
    """Counts of shingles by slot (2^COUNTERS, up to 65535). They only order shingles, so what shares a slot does no harm."""
    width = 1 << PIECE

    def count(batches):
        total = np.zeros(1 << COUNTERS, dtype=np.uint32)
        for b in slices(batches):
            for s in _sets(_normal(b.column(0).to_pylist()), shingle):
                np.add.at(total, _slot(s), 1)
        parts = np.minimum(total, 255).astype(np.uint8).reshape(-1, width)
        some = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names=["piece", "n"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(n), dtype=np.uint8).astype(np.uint32)
        some = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.minimum(total[i], 65535).astype("<u2").tobytes() for i in some], pa.binary())], names=["piece", "n"])

    out = np.zeros(1 << COUNTERS, dtype=np.uint16)
    for r in texts.mapInArrow(count, "piece int, n binary").repartition("piece").mapInArrow(merge, "piece int, n binary").toLocalIterator():
        out[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(bytes(r["n"]), dtype="<u2")
    return out


def _prefixes(texts: DataFrame, shingle: int, similarity: float, common) -> DataFrame:
    """(h, c, n, pos): the rarest of the n shingles of each text, as many as sets that are ``similarity`` alike must share one of."""

    def run(batches):
        counts, seen = common.value, set()
        for b in slices(batches):
            # copies within a task bring their rows once; those of different tasks are told apart by c
            if len(seen) > 1_000_000:
                seen.clear()
            normal = [t for t in _normal(b.column(0).to_pylist()) if not ((c := xxhash.xxh64_intdigest(t, 1)) in seen or seen.add(c))]
            out = [(np.zeros(0, np.uint64), 0, 0)]
            for t, s in zip(normal, _sets(normal, shingle)):
                n = len(s)
                first = np.lexsort((s, counts[_slot(s)]))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                out.append((s[first], xxhash.xxh64_intdigest(t, 1), n))
            size = [len(h) for h, _, _ in out]
            c = np.repeat(np.array([c for _, c, _ in out], dtype=np.uint64), size).view(np.int64)
            pos = np.concatenate([np.arange(k) for k in size])
            cols = [np.concatenate([h for h, _, _ in out]).view(np.int64), c, np.repeat([n for _, _, n in out], size).astype(np.int32), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "c", "n", "pos"])

    return texts.mapInArrow(run, "h long, c long, n int, pos int")


def _grouped(batches):
    """Arrow batches sorted by their first column as lists of arrays that hold whole groups."""
    held = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]):
            at = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on in the next batch
            if at:
                yield [x[:at] for x in held]
            held = [x[at:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _may(x, i, y, j, similarity: float):
    """Whether sets of x and y shingles whose first common one stands at places i and j can be ``similarity`` alike."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    return (np.minimum(x - i, y - j) >= similarity / (1 + similarity) * (x + y) - 1e-6) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)


def _shared(prefixes: DataFrame) -> DataFrame:
    """(h, c, n, pos): the prefix shingles that stand in several texts, once for each text."""
    names = ["h", "c", "n", "pos"]

    def run(batches):
        held, before = None, False  # the last row, and whether the one before it has its shingle
        for b in batches:
            cols = [x.to_numpy() for x in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(cols[0]):
                h, c = cols[:2]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])  # copies bring the same rows
                cols = [x[new] for x in cols]
                same = cols[0][1:] == cols[0][:-1]
                left = np.concatenate([[before], same])
                keep = left[:-1] | same
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in cols], names=names)
                held, before = [x[-1:] for x in cols], bool(left[-1])
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)

    return prefixes.repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, "h long, c long, n int, pos int")


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``shared`` with the root of each text's group so far."""
    own = shared.select("h", "c", "n", "pos").join(small(roots).toDF("c", "root"), "c", "left")
    return own.select("h", "c", "n", "pos", F.coalesce("root", "c").alias("root"))


def _unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``shared``, with roots, whose shingle stands in texts of several groups."""
    own = _rooted(shared, roots)
    several = own.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    return own.join(small(cut(several)), "h", "left_semi")


def _offers(open_: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): a partner of another group for each text, one that it can be alike.

    Each shingle offers one text to all others: at first the one that has the
    fewest rarer shingles, as the original among its altered copies does, and
    then another one every turn.
    """
    rank = F.col("pos").cast("long") if turn == 0 else F.xxhash64(F.lit(turn), "c")
    first = open_.groupBy("h").agg(F.min(F.struct(rank.alias("rank"), "c", "n", "pos", "root")).alias("f")).select("h", "f")
    both = open_.join(first, "h").where("root != f.root")
    room = F.least(F.col("n") - F.col("pos"), F.col("f.n") - F.col("f.pos")) >= similarity / (1 + similarity) * (F.col("n") + F.col("f.n")) - 1e-6
    sizes = F.least("n", "f.n") >= similarity * F.greatest("n", "f.n") - 1e-6
    return both.where(room & sizes).groupBy("c").agg(F.min(F.struct("f.rank", "f.c")).alias("x")).select(F.col("c").alias("a"), F.col("x.c").alias("b"))


#: Bits of the map of a shingle set.
BITS = 1024


def _bitmap(s: np.ndarray) -> bytes:
    """For each of BITS classes of shingles whether the set has an odd number. Two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((mix(s) >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _texts_of(asked: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(c, w, bits): the compressed words and bitmaps of the texts asked for, read from ``docs`` by the id of one row of each."""

    def packed(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            normal = _normal(b.column(0).to_pylist())
            c = np.array([xxhash.xxh64_intdigest(t, 1) for t in normal], dtype=np.uint64).view(np.int64)
            cols = [[press.compress(t) for t in normal], [_bitmap(x) for x in _sets(normal, shingle)]]
            yield pa.RecordBatch.from_arrays([pa.array(c), *(pa.array(x, pa.binary()) for x in cols)], names=["c", "w", "bits"])

    one = cut(rows.where("id IS NOT NULL").join(asked, "c", "left_semi").groupBy("c").agg(F.min("id").alias("id")))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(small(one.select("id").distinct()), "id", "left_semi").select("t")
    return cut(text.mapInArrow(packed, "c long, w binary, bits binary").dropDuplicates(["c"]))


def _verified(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) edges whose texts' shingle sets have at least the Jaccard similarity."""

    def compare(batches):
        raw = zstandard.ZstdDecompressor()
        for b in slices(batches, 200):
            at: dict[bytes, int] = {}
            place = [[at.setdefault(w, len(at)) for w in b.column(k).to_pylist()] for k in (2, 3)]
            sets = list(_sets([raw.decompress(w) for w in at], shingle))
            keep = []
            for x, y in zip(*place):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # only the texts asked for travel
    named = edges.select(F.col("a").alias("c")).union(edges.select("b")).distinct()
    words = texts.select("c", "w").join(small(cut(named)), "c", "left_semi")
    pairs = edges.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return tight(cut(pairs.mapInArrow(compare, "a long, b long")))


#: Turns in which each text of an unsettled shingle tries one partner, before all pairs that are left are tried.
TURNS = 8


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, c, component_id) by links between texts whose sets of ``shingle``-word shingles are at least ``similarity`` alike.

    First the SimHash blocks: texts whose fingerprints differ in ``distance``
    bits or fewer are candidates. Sets that are just ``similarity`` alike have
    fingerprints some ten bits apart, which no blocks can find, so the rest comes
    from prefixes: of two sets of n and m shingles that are so much alike, with
    all shingles in one order, the first n - ceil(similarity n) + 1 of the one
    and as many of the other by m have one in common, wherever words were put
    in, left out or replaced. Shingles are ordered by how common they are, rare
    ones first, so that a passage that many texts hold seldom makes candidates.
    In each of a few turns every text tries one partner that it shares a prefix
    shingle and not yet a group with, which gathers a large group in stars; then
    all pairs that are not together yet are tried, so none is left out, but for
    those that sizes, places or bitmaps of the sets show to be too different. Each
    candidate is verified on the full shingle sets, so no link is false.

    Rows with equal word sequences (hash c) are always together. Null and empty
    texts are one group. Texts that stand only in rows without an id can't be
    read again and link to their equals alone.
    """
    rows = cut(contents(docs, id_col, text_col, shingle))
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    common = docs.sparkSession.sparkContext.broadcast(_commonness(texts, shingle))
    shared = tight(cut(_shared(_prefixes(texts, shingle, similarity, common))))
    # the fingerprints' links, between one text of each value, and from each text to the one of its value
    values = tight(cut(rows.groupBy("fp").agg(F.min("c").alias("c"))))
    near = links(values.select("fp"), distance).join(values.toDF("a", "ca"), "a").join(values.toDF("b", "cb"), "b").select("ca", "cb")
    same = rows.select("c", "fp").distinct().join(small(values).toDF("fp", "to"), "fp").select("c", "to")
    tried = tight(cut(_ordered(near.union(same).toDF("a", "b"))))
    asked = shared.select("c").union(tried.select("a")).union(tried.select("b")).distinct()
    words = _texts_of(asked, rows, docs, id_col, text_col, shingle)
    held = _verified(tried, words, shingle, similarity)
    roots = components(held)
    for turn in range(TURNS):
        shared = tight(cut(_unsettled(shared, roots)))
        new = tight(cut(_ordered(_offers(shared, turn, similarity)).join(tried, ["a", "b"], "left_anti")))
        tried, found = tried.union(new), _verified(new, words, shingle, similarity)
        held = held.union(found)
        if not (n := found.count()):
            break
        roots = components(held)
        if 100 * n < shared.select("c").distinct().count():
            break
    rest = tight(cut(_ordered(_apart(shared, roots, words, similarity)).join(tried, ["a", "b"], "left_anti")))
    roots = components(held.union(_verified(rest, words, shingle, similarity)))
    named = rows.select("id", "c").join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = cut(named.select("id", "c", "root"))
    return named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "c", "component_id")


#: Rows that are held against others at once, and rows of a shingle's block: larger shingles are dealt in pairs of blocks.
ROWS, BLOCK = 256, 4096


def _apart(shared: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of texts that share a prefix shingle, are not of one root and can be ``similarity`` alike.

    Sizes and places decide that, since texts whose first common shingle stands
    at given places have no more in common than what follows in both; then
    bitmaps, since sets of n and m shingles that are so much alike differ in
    (n + m)(1 - similarity) / (1 + similarity) shingles at most.
    """

    def pairs(c, n, pos, root, part, bits):
        crossed = part.any() and not part.all()  # two blocks: pairs within them are tried elsewhere
        for s in range(0, len(c), ROWS):
            e = min(s + ROWS, len(c))
            # sizes ascend: partners come later and aren't too long for the longest here
            far = int(np.searchsorted(n, n[e - 1] / similarity + 1e-6, side="right"))
            i, j = slice(s, e), slice(s, far)
            ok = (root[i, None] != root[None, j]) & (np.arange(s, e)[:, None] < np.arange(s, far)[None, :])
            if crossed:
                ok &= part[i, None] != part[None, j]
            ok &= _may(n[i, None], pos[i, None], n[None, j], pos[None, j], similarity)
            u, v = np.nonzero(ok)
            for k in range(0, len(u), 100_000):
                x, y = s + u[k : k + 100_000], s + v[k : k + 100_000]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                close = apart <= (n[x] + n[y]) * (1 - similarity) / (1 + similarity) + 1e-6
                if close.any():
                    yield c[x[close]], c[y[close]]

    def run(batches):
        for g, c, n, pos, root, part, bits in _grouped(batches):
            maps = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(g), -1)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            ends = np.append(starts[1:], len(g))
            out, held = [], 0
            for s, e in zip(starts, ends):
                if (root[s:e] != root[s]).any():
                    for a, b in pairs(c[s:e], n[s:e].astype(np.int64), pos[s:e], root[s:e], part[s:e], maps[s:e]):
                        out.append((a, b))
                        held += len(a)
                        if held > 1_000_000:
                            yield sent(out)
                            out, held = [], 0
            if out:
                yield sent(out)

    def sent(out):
        pairs_ = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs_[:, k])) for k in (0, 1)], names=["a", "b"])

    own = _rooted(shared, roots)
    blocks = own.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    own = own.join(blocks.where("low < high").select("h", "blocks"), "h").join(texts.select("c", "bits"), "c")
    block = F.pmod(F.xxhash64("c"), "blocks").cast("int")
    own = own.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")))
    dealt = own.select(group.alias("g"), "c", "n", "pos", "root", (F.col("i") <= F.col("j")).alias("part"), "bits").repartition("g").sortWithinPartitions("g", "n")
    return dealt.mapInArrow(run, "a long, b long")


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the greater end first."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more, unchanged) that stay when one document of each group of ``similar`` is kept, that of the least id.

    Only the ids that go meet the texts. Of rows with one id and equal words one
    stays at most; rows with one id and different words are judged by their own
    text. Rows without an id can't be named and stay. An empty table gives an
    empty result; other columns, whatever their names, are unchanged.
    """
    out = cut(similar(docs, **options))
    again = cut(out.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("doc_id")))
    gone = cut(out.where("component_id < id").select(F.col("id").alias("doc_id"), "c").distinct())
    if again.isEmpty():
        return docs.join(small(gone.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    # ids that stand in several rows are told apart by their words, and taken apart from the others
    single = docs.join(small(gone.select("doc_id").union(again).distinct()), "doc_id", "left_anti").select(*docs.columns)
    several, at, own = docs.join(small(again), "doc_id", "left_semi").select(*docs.columns), docs.columns.index("text"), "__words"

    def run(batches):
        for b in slices(batches):
            c = np.array([_content(_words(t)) for t in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield b.append_column(own, pa.array(c))

    known = several.mapInArrow(run, StructType([*several.schema.fields, StructField(own, LongType())])).dropDuplicates(["doc_id", own])
    return single.union(known.join(gone.toDF("doc_id", own), ["doc_id", own], "left_anti").select(*docs.columns))
