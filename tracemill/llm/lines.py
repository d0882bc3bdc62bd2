"""Line dedup: all pairs of different lines within a few edits, in DataFrame operations only.

A line is cut into ``edits + 1`` segments of (nearly) equal length. Of two lines
within that many edits at least one segment of the shorter stands unchanged in
the longer, shifted by no more than the edits to its left and the length
difference allow. So each line is indexed by (length, segment number, segment)
and probes, for each length up to ``edits`` below its own, the few substrings at
the allowed shifts. Lines that share a key are candidates only if their counts of
some letters are as close as the edits allow (each edit changes two counts at
most); this is tested inside the join, so that many lines with one long common
segment do not come out of it in pairs. A banded bit-parallel edit distance (one
word of 2 edits + 2 bits a column) then decides.

Line texts are shuffled only for candidates; all else moves 64-bit hashes. Equal
lines are one class from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line) for each line that isn't empty, numbered from 0; null texts have none."""
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(t, "\n", -1)).alias("line_no", "line"))
    return rows.where("line != ''")


def line_key(line: Column) -> Column:
    """63 hash bits of a line, shifted up by one."""
    return F.shiftleft(F.xxhash64(line), 1)


#: Characters that are counted, modulo 32, in five bits each.
LETTERS = "etaoinsrhl01"


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, modulo 32, packed into a long. Each letter is taken out of what the ones before have left."""
    out, was = F.lit(0).cast("long"), line
    for i, c in enumerate(LETTERS):
        rest = F.replace(was, F.lit(c), F.lit(""))
        n = F.octet_length(was) - F.octet_length(rest)
        out = out.bitwiseOR(F.shiftleft((n % 32).cast("long"), 5 * i))
        was = rest
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """Sum over LETTERS of how far two packed counts are apart, the short way round 32: no more than the true sum."""
    out = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        d = (F.shiftright(a, 5 * i) - F.shiftright(b, 5 * i)).bitwiseAND(F.lit(31).cast("long"))
        out = out + F.least(d, 32 - d)
    return out


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each segment of lines of a length; longer ones last."""
    n = edits + 1
    base, extra = F.floor(length / n).cast("int"), (length % n).cast("int")
    out, start = [], F.lit(1)
    for i in range(n):
        size = base + (F.lit(i) >= F.lit(n) - extra).cast("int")
        out.append((start, size))
        start = start + size
    return out


def _signatures(lines: DataFrame, edits: int) -> DataFrame:
    """(k, own: keys the line is indexed by, probes: keys it is looked up with, c: letter counts), one row a class."""
    n = F.length("line")
    base = lines.where(n > edits).select(line_key(F.col("line")).alias("k"), "line", n.alias("n"))

    def key(length, i, start, size):
        return F.xxhash64(length, F.lit(i), F.expr("line").substr(start, size)).bitwiseOR(F.lit(1))

    cols = {f"o{i}": key(F.col("n"), i, s, size) for i, (s, size) in enumerate(_segments(F.col("n"), edits))}
    for gap in range(edits + 1):
        for i, (s, size) in enumerate(_segments(F.col("n") - gap, edits)):
            for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1):
                if gap or shift:  # at equal length without a shift it is the line's own key
                    h = key(F.col("n") - gap, i, s + shift, size)
                    # 0 is no key: the shorter line would have fewer characters than segments (a mask, as what is conditional is not computed once)
                    cols[f"p{gap}_{i}_{shift + edits}"] = h.bitwiseAND(F.negative((F.col("n") - gap > edits).cast("long"))) if gap else h
    cols["c"] = letter_counts(F.col("line"))
    # all values of a class are equal: fixed-width minima, combined map-side
    one = base.select("k", *[c.alias(x) for x, c in cols.items()]).groupBy("k").agg(*[F.min(x).alias(x) for x in cols])
    own, probes = [x for x in cols if x[0] == "o"], [x for x in cols if x[0] == "p"]
    # no value is null, so this keeps every row; it makes all uses read all columns, so that the exchange behind is made once
    one = one.where(" AND ".join(f"{x} IS NOT NULL" for x in cols))
    return one.select("k", F.array(*own).alias("own"), F.array(*probes).alias("probes"), "c")


def short_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(k, line, n): the classes of lines so short that they may be within ``edits`` of one that has no more characters than that."""
    n = F.length("line")
    return cut(lines.where(n <= 2 * edits).select(line_key(F.col("line")).alias("k"), "line", n.alias("n")).distinct())


def _with_tiny(short: DataFrame, edits: int) -> DataFrame:
    """(a, b) classes of a line of at most ``edits`` characters and a longer one that has a character of it, and a length to be within ``edits``."""
    char = F.explode(F.array_distinct(_none_if_blank(F.split("line", ""))))
    own = short.where(F.col("n") <= edits).select(F.col("k").alias("a"), F.col("n").alias("m"), char.alias("x"))
    longer = short.where(F.col("n") > edits).select(F.col("k").alias("b"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - edits), F.lit(edits))).alias("m"), "line")
    longer = longer.select("b", "m", char.alias("x"))
    return own.join(longer, ["m", "x"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(lines: DataFrame, short: DataFrame, edits: int) -> DataFrame:
    """(a, b) different classes, a < b, that share a key. ``short``: the short lines among them."""
    rows = _signatures(lines, edits)
    own = rows.select("k", "c", F.explode("own").alias("h"))
    twin = own.select(F.col("k").alias("k2"), F.col("c").alias("c2"), "h")
    probes = rows.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.explode("probes").alias("h")).where("h != 0")
    near = counts_apart(F.col("c"), F.col("c2")) <= 2 * edits
    same = own.join(twin, "h").where((F.col("k") < F.col("k2")) & near).select("k", "k2")
    other = own.join(probes, "h").where((F.col("k") != F.col("k2")) & near).select(F.least("k", "k2").alias("k"), F.greatest("k", "k2").alias("k2"))
    return same.union(other).toDF("a", "b").union(_with_tiny(short, edits)).distinct()


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: the optimiser would put the expression itself wherever it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


STRIDE = 32


def _stripped(z: Column) -> Column:
    """A pair of strings (x, y) without the leading strides of STRIDE characters that they share."""
    blocks = F.floor(F.least(F.length(z["x"]), F.length(z["y"])) / STRIDE).cast("int")

    def same(done, i):
        at = i * STRIDE + 1
        return F.when(done == i, F.when(z["x"].substr(at, F.lit(STRIDE)) == z["y"].substr(at, F.lit(STRIDE)), done + 1).otherwise(done)).otherwise(done)

    count = F.when(blocks > 0, F.aggregate(F.sequence(F.lit(0), blocks - 1), F.lit(0), same)).otherwise(F.lit(0))
    rest = lambda c, n: c.substr(n * STRIDE + 1, F.length(c))
    return let(count, lambda n: F.struct(rest(z["x"], n).alias("x"), rest(z["y"], n).alias("y")))


def close(x: Column, y: Column, edits: int) -> Column:
    """Whether two strings are within ``edits``. What both begin or end with does not matter to that and is cut off by strides first."""

    def decide(z):
        swap = F.length(z["x"]) < F.length(z["y"])
        chars = F.struct(F.split(F.when(swap, z["y"]).otherwise(z["x"]), "").alias("x"), F.split(F.when(swap, z["x"]).otherwise(z["y"]), "").alias("y"))
        filled = lambda c: F.struct(_none_if_blank(c["x"]).alias("x"), _none_if_blank(c["y"]).alias("y"))
        return let(chars, lambda c: let(filled(c), lambda f: within(f["x"], f["y"], edits)))

    back = lambda z: F.struct(F.reverse(z["x"]).alias("x"), F.reverse(z["y"]).alias("y"))
    pair = F.struct(x.alias("x"), y.alias("y"))
    return let(pair, lambda a: let(_stripped(a), lambda b: let(back(b), lambda c: let(_stripped(c), decide))))


def _none_if_blank(chars: Column) -> Column:
    """Splitting an empty string gives one empty string; it has no characters."""
    return F.filter(chars, lambda c: c != "")


def within(longer: Column, shorter: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits``: banded bit-parallel columns folded over the shorter.

    Bit j of a word is row i + edits - top + j of column i, so the band moves
    down a diagonal with each character. The distance is followed along the
    band's lowest diagonal to the last row, and along that row to its end.
    """
    top = 2 * edits + 1
    full = (1 << (top + 1)) - 1
    m, n = F.size(longer), F.size(shorter)

    def word(x):
        return F.lit(x).cast("long")

    def matches(i):
        c = F.get(shorter, i)
        out = word(0)
        for j in range(top + 1):
            out = out + F.when(F.get(longer, i + (edits - top + j)) == c, word(1 << j)).otherwise(word(0))
        return out

    def step(s, i):
        def with_eq(eq):
            d0 = (eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(word(full))
            return let(d0, with_d0)

        def with_d0(d0):
            hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(word(full))
            hn = d0.bitwiseAND(s["vp"])
            down = F.shiftright(d0, 1)
            # bit of the last row, once the band has reached it
            row = F.greatest(m - 1 - i - edits + top, F.lit(0))
            at_row = lambda x: (F.getbit(x, F.least(row, F.lit(top)))).cast("int")
            d = F.when(i < m - edits, s["d"] + 1 - F.getbit(d0, F.lit(top)).cast("int")).otherwise(s["d"] + at_row(hp) - at_row(hn))
            vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(word(full))
            return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"))

        return let(matches(i), with_eq)

    start = F.struct(word(full ^ ((1 << (top - edits)) - 1)).alias("vp"), word(0).alias("vn"), F.least(F.lit(edits), m).alias("d"))
    distance = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["d"])
    return F.when(m - n > edits, False).when(n <= 0, m <= edits).otherwise(distance <= edits)


def links(lines: DataFrame, edits: int = 2, short: DataFrame | None = None) -> DataFrame:
    """(a, b) classes of different lines within ``edits``, each pair once, but for the pairs of two lines of at most ``edits`` characters: all of these are."""
    pairs = cut(candidates(lines, short_lines(lines, edits) if short is None else short, edits))
    named = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    texts = lines.select(line_key(F.col("line")).alias("k"), "line").join(small(named), "k", "left_semi").groupBy("k").agg(F.min("line").alias("line"))
    texts = cut(texts)
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return both.where(close(F.col("x"), F.col("y"), edits)).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2) -> DataFrame:
    """A row for each line that isn't empty: id, line_no, class_id, n_links.

    class_id is the MD5 of the line, the same for equal lines; n_links is how
    many classes of other lines are within ``edits``. Null and empty texts have
    no lines; null ids and repeated rows are kept as they are; other columns are
    ignored; an empty table gives an empty result.
    """
    lines = split_lines(docs, id_col, text_col)
    short = short_lines(lines, edits)
    found = cut(links(lines, edits, short))
    degree = found.select(F.col("a").alias("k")).union(found.select("b")).groupBy("k").agg(F.count("*").alias("n_links"))
    # how many classes there are of lines that are all within reach of each other
    tiny = short.where(F.col("n") <= edits).count()
    rows = lines.select("id", "line_no", line_key(F.col("line")).alias("k"), F.md5(F.col("line").cast("binary")).alias("class_id"), (F.length("line") <= edits).alias("is_tiny"))
    rows = rows.join(small(cut(degree)), "k", "left")
    n = F.coalesce("n_links", F.lit(0)) + F.when(F.col("is_tiny"), F.lit(tiny - 1)).otherwise(0)
    return rows.select("id", "line_no", "class_id", n.cast("long").alias("n_links"))


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    """Each line of each document with its class and the number of its links."""
    out = line_classes(docs)
    return out.select(F.col("id").alias("doc_id"), "line_no", "class_id", "n_links")


#: Lines share one of three segments at a shift of two at most, and lines of four characters at most are compared outright. DuckDB's
#: distance counts bytes, so each character beyond ASCII is first put as one control character.
OP1_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
rows_ AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE line <> ''),
d AS (SELECT DISTINCT line, length(line) AS n FROM rows_),
odd AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT DISTINCT unnest(string_split(line, '')) AS c FROM d) WHERE strlen(c) > 1),
map AS (SELECT coalesce(string_agg(c, '' ORDER BY i), '') AS was, coalesce(string_agg(chr(CAST(CASE WHEN i < 9 THEN i WHEN i < 28 THEN i + 4 ELSE 0 END AS INTEGER)), '' ORDER BY i), '') AS becomes FROM odd),
s AS (SELECT line, n, n - CAST(g.range AS BIGINT) AS m, CAST(i.range AS BIGINT) AS i, CAST(h.range AS BIGINT) AS h FROM d, range(3) g, range(3) i, range(-2, 3) h),
keys AS (
  SELECT line, n, m, i, h, substr(line, CAST(1 + i * (m // 3) + greatest(0, i - (3 - m % 3)) + h AS BIGINT), CAST(m // 3 + CASE WHEN i >= 3 - m % 3 THEN 1 ELSE 0 END AS BIGINT)) AS seg
  FROM s WHERE m >= 3 AND 1 + i * (m // 3) + greatest(0, i - (3 - m % 3)) + h >= 1),
pairs AS (
  SELECT least(a.line, b.line) AS x, greatest(a.line, b.line) AS y FROM keys a JOIN keys b ON a.m = a.n AND a.h = 0 AND b.m = a.n AND b.i = a.i AND b.seg = a.seg AND a.line <> b.line
  UNION
  SELECT a.line, b.line FROM d a JOIN d b ON a.n <= 4 AND b.n <= 4 AND a.line < b.line),
links AS (SELECT x, y FROM pairs, map WHERE levenshtein(translate(x, was, becomes), translate(y, was, becomes)) <= 2),
degree AS (SELECT line, count(*) AS n FROM (SELECT x AS line FROM links UNION ALL SELECT y FROM links) GROUP BY line)
SELECT doc_id, line_no, md5(line) AS class_id, coalesce(degree.n, 0) AS n_links FROM rows_ LEFT JOIN degree USING (line)
"""
