"""Nearest neighbours by score-aware (anisotropic) quantisation and four-bit table scans.

The nearest vector to q has the greatest q.x - |x|^2 / 2, the inner product of
(q, 1) with (x, -|x|^2 / 2): a maximum inner product search. Vectors are cut
into two-dimensional parts of 16 centres each (four bits a part). Codes are
chosen to keep the score-aware loss small, which weighs the part of a
residual that is parallel to its vector more than the rest, since that is what
moves large inner products. A query's scores of all codes of a part are one
table row, so a scan adds a few table entries per row of the index.

Each row is stored with its codes and the length of its residual. The rows that
scan best are scored again exactly; then so is every other row that its residual
may let be as near as the last of the k found. So the answer does not depend on
how the index is dealt or cut into batches, and rows that share their codes, as
in a dense cluster, are never told apart by chance.

The code book is trained on a bounded sample, every vector is encoded, and
vectors that are equal stand in the index once, with their ten and one least
ids, so a group of copies can't crowd out other neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import cut

CENTRES = 16
PART = 2
#: Coarse cells by which the rows of a partition are ordered, so that the rows of a batch lie together.
CELLS = 64


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with a non-zero vector of finite numbers, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & some)


class CodeBook:
    """Centres of each part, trained with the anisotropic loss.

    With eta the weight of the parallel against the orthogonal residual, the
    loss of a residual r of x is |r|^2 + (eta - 1) (r.x)^2 / |x|^2.
    """

    def __init__(self, sample: np.ndarray, eta: float = 3.0, rounds: int = 8, seed: int = 7):
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // PART)
        x = self._wide(sample)
        rng = np.random.default_rng(seed)
        self.eta = eta
        picks = rng.choice(len(x), size=CENTRES, replace=len(x) < CENTRES)
        self.centres = x[picks].reshape(CENTRES, self.parts, PART).transpose(1, 0, 2).copy()
        for k in range(rounds):
            codes = self.encode(sample, passes=0 if k < 3 else 1)
            self._refit(x, codes)
        self.cells = sample[rng.choice(len(x), size=min(CELLS, len(x)), replace=False)]
        for _ in range(3):
            at = self.cell(sample)
            self.cells = np.stack([sample[at == c].mean(axis=0) if (at == c).any() else self.cells[c] for c in range(len(self.cells))])

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return ((self.cells**2).sum(axis=1)[None, :] - 2 * vectors @ self.cells.T).argmin(axis=1)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        pad = self.parts * PART - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))) if pad else x

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Weighted least squares for each centre, with the other parts' residuals held."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        dec = self.decode(codes)
        par = ((x - dec) * unit).sum(axis=1)
        for m in range(self.parts):
            s = slice(m * PART, (m + 1) * PART)
            xm, um = x[:, s], unit[:, s]
            own = ((xm - dec[:, s]) * um).sum(axis=1)
            rest = par - own  # parallel residual of the other parts
            for c in range(CENTRES):
                rows = codes[:, m] == c
                if not rows.any():
                    continue
                u, t = um[rows], xm[rows]
                a = rows.sum() * np.eye(PART) + (self.eta - 1) * u.T @ u
                b = t.sum(axis=0) + (self.eta - 1) * u.T @ ((t * u).sum(axis=1) + rest[rows])
                self.centres[m, c] = np.linalg.solve(a + 1e-9 * np.eye(PART), b)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts)[None, :], codes].reshape(len(codes), -1)

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres on."""
        x = self._wide(vectors)
        n = len(x)
        xp = x.reshape(n, self.parts, PART)
        dist = np.stack([((xp[:, m, None, :] - self.centres[m][None]) ** 2).sum(axis=2) for m in range(self.parts)], axis=1)
        codes = dist.argmin(axis=2)
        if not passes:
            return codes
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, self.parts, PART)
        along = np.stack([((xp[:, m, None, :] - self.centres[m][None]) * unit[:, m, None, :]).sum(axis=2) for m in range(self.parts)], axis=1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(passes):
            for m in range(self.parts):
                others = total - along[rows, m, codes[:, m]]
                codes[:, m] = (dist[:, m] + (self.eta - 1) * (others[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = others + along[rows, m, codes[:, m]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each centre: queries x parts x 16."""
        q = self._wide(queries).reshape(len(queries), self.parts, PART)
        return np.einsum("qmp,mcp->qmc", q, self.centres).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    wide = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return wide[:, ::2] * CENTRES + wide[:, 1::2]


def unpack(packed: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([packed // CENTRES, packed % CENTRES], axis=2).reshape(len(packed), -1)[:, :parts]


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Sums of table entries for every query and row of packed codes. Two parts share a byte, so a pair's 256 sums are looked up at once."""
    out = np.zeros((len(tables), len(packed)), dtype=np.float32)
    wide = np.pad(tables, ((0, 0), (0, tables.shape[1] % 2), (0, 0)))
    for m in range(packed.shape[1]):
        pair = (wide[:, 2 * m, :, None] + wide[:, 2 * m + 1, None, :]).reshape(len(tables), CENTRES**2)
        out += pair[:, packed[:, m]]
    return out


def _train(index: DataFrame, rows: int) -> CodeBook:
    """A code book from up to ``rows`` vectors (NUMBERS numbers), the least by a hash of the id."""
    got = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").toArrow()
    return CodeBook(_vectors(got.column(0).combine_chunks()))


#: Numbers that are gathered on the driver or sent to the tasks at once.
NUMBERS = 4_000_000


def _vectors(column) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, keep: int = 100, sample: int = 20_000, query_block: int = 256) -> DataFrame:
    """The k nearest found of each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    score is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller id. Null, zero and non-finite vectors take no part;
    vectors of different lengths are never compared; an id that stands in
    several rows counts once for each different vector; other columns are
    ignored; with fewer than k other vectors, all are returned.

    ``keep`` rows of a batch are scored exactly for each query whatever their
    bound, to begin with. The code book sees ``sample`` vectors at most; every
    vector is encoded and searched.
    """
    rows = usable(vectors, id_col, vec_col)
    # equal vectors once, with as many ids as any answer can need; the limit is applied before the shuffle too
    dense = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.distinct().withColumn("r", F.row_number().over(dense)).where(F.col("r") <= k + 1)
    index = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("d", F.size("v")).withColumn("vec_id", F.element_at("ids", 1)))
    queries = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().withColumn("d", F.size("v")))
    found, before = None, 0
    # lengths that no query has are never searched
    for dim, n in queries.groupBy("d").count().orderBy("d").collect():
        own = index.where(F.col("d") == dim)
        book = _train(own, min(sample, max(CENTRES, NUMBERS // dim)))
        coded = cut(own.select("v", "ids").mapInArrow(_encoder(book), "v array<double>, ids array<long>, codes binary, gap double, cell int").sortWithinPartitions("cell"))
        blocks = max(1, -(-n // max(1, NUMBERS // (4 * dim))))  # so many queries travel at once, and so many passes are made, one by one
        for b in range(blocks):
            asked = queries.where((F.col("d") == dim) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b))
            got = asked.orderBy("vec_id", "v").select("vec_id", "v").toArrow()
            if len(got):
                q = _vectors(got.column(1).combine_chunks())
                part = cut(coded.mapInArrow(_scanner(book, got.column(0).to_numpy(), q, before, k, keep, query_block), "query_id long, qv long, vec_id long, score double"))
                before += len(got)
                found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the k best of each query over all tasks, by distance, then id
    best = Window.partitionBy("query_id", "qv").orderBy("score", "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _encoder(book: CodeBook):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(0))
                codes = book.encode(x)
                gap = np.sqrt(((book._wide(x) - book.decode(codes)) ** 2).sum(axis=1))
                packed = pa.array([c.tobytes() for c in pack(codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array(gap), pa.array(book.cell(x).astype(np.int32))], names=["v", "ids", "codes", "gap", "cell"])

    return run


def _scanner(book: CodeBook, ids: np.ndarray, q: np.ndarray, before: int, k: int, keep: int, query_block: int):
    """The k best rows of a task for each query, exactly. The queries are numbered from ``before``."""

    def run(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in ids]  # at most k rows a query leave a task
        last = np.full(len(ids), np.inf)  # how far the last of k is
        length = np.sqrt((q * q).sum(axis=1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, members, gap = _vectors(batch.column(0)), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(x), -1)
            size = (book.decode(unpack(packed, book.parts)) ** 2).sum(axis=1)
            middle = x.mean(axis=0)
            reach = np.sqrt(((x - middle) ** 2).sum(axis=1).max())
            # the whole batch is too far for some queries
            near = np.flatnonzero(np.sqrt(((q - middle) ** 2).sum(axis=1)) * (1 - 1e-9) - reach * (1 + 1e-9) <= last)
            top = min(keep, len(x))

            def offer(i, rows):
                d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
                rows = rows[d <= last[i]]
                pairs = [(float(s), v) for s, r in zip(d[d <= last[i]].tolist(), rows.tolist()) for v in members[r] if v != ids[i]]
                if pairs:
                    best[i] = sorted(best[i] + pairs)[:k]
                    if len(best[i]) == k:
                        last[i] = best[i][-1][0]

            for at in range(0, len(near), query_block):
                some = near[at : at + query_block]
                squares = (length[some] ** 2)[:, None] + size[None, :] - 2.0 * scan(book.tables(q[some]), packed)
                # rounding of the tables and their sums
                slack = 5e-7 * (book.parts + 8) * length[some][:, None] * np.sqrt(size)[None, :]
                least = np.sqrt(np.maximum(0, squares - slack)) - gap[None, :] - 1e-9 * (1 + gap[None, :])
                first = np.argpartition(squares, top - 1, axis=1)[:, :top]
                for i, row, bound in zip(some.tolist(), first, least):
                    offer(i, row)
                    bound[row] = np.nan  # done
                    rest = np.flatnonzero(bound <= last[i])
                    if len(rest):
                        offer(i, rest)
        rows = [(ids[i], before + i, v, s) for i, found in enumerate(best) for s, v in found]
        for at in range(0, len(rows), 50_000):
            c = list(zip(*rows[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64())], names=["query_id", "qv", "vec_id", "score"])

    return run


def op3_ann(embeddings: DataFrame) -> DataFrame:
    """The contract's digest: query_id, rank, vec_id, score."""
    return nearest(embeddings)
