"""Temperature mixing of sources, in DataFrame and SQL operations only.

Source s with share p of the tokens gets weight proportional to p^a. The
exponent a in [0, 1] is bisected: to the target entropy of the weights, or to
the least a (the flattest mixture) that repeats no source more often than the
limit. The weights are then realised in tokens: each source is passed in a new
permutation an epoch, its last epoch up to its budget, and each run of
``block_tokens`` of the whole mixture takes the same part of every source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small
from tracemill.operators.prefix import ranged, running

STEPS = 60  # halvings of the exponent's interval


def n_tokens(text: Column) -> Column:
    """Words of a text, 1 at least, as a long."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """60 bits that order a document within an epoch of its source; a null id counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def weights(sized: DataFrame, max_repeat: float = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens) rows -> source, total, exponent, weight, quota, full, rest.

    ``budget`` is the mixture's tokens; by default as many as let the source
    with the least repetition pass exactly once, so that no document is left
    out. quota is weight * budget, rounded; full its whole epochs and rest the
    tokens of the last one. Sources with one total have one weight, so only the
    different totals, with their numbers of sources, meet in a row for the
    bisection; documents never do. A null source is a source of its own.
    """
    totals = cut(sized.groupBy("source").agg(F.sum("tokens").alias("total")))
    row = totals.groupBy("total").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("total", "n"))).alias("s"), F.sum(F.col("total") * F.col("n")).alias("all"))
    row = row.withColumn("p", F.transform("s", lambda x: F.struct((x["total"] / F.col("all")).alias("p"), x["n"].alias("n"))))

    def norm(a):
        return F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["n"] * F.pow(x["p"], a))

    def entropy(a):
        z = norm(a)
        return F.aggregate("p", F.lit(0.0), lambda acc, x: acc - x["n"] * F.pow(x["p"], a) / z * F.log(F.pow(x["p"], a) / z))

    def too_flat(a):
        """Whether exponent ``a`` lies below the wanted one."""
        if target_entropy is not None:
            return entropy(a) > target_entropy
        most = F.array_max(F.transform("p", lambda x: F.pow(x["p"], a) / x["p"]))
        least = F.array_min(F.transform("p", lambda x: F.pow(x["p"], a) / x["p"])) if budget is None else F.col("all") * norm(a) / F.lit(float(budget))
        return most > max_repeat * least

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(acc["lo"]).alias("lo"), F.when(flat, acc["hi"]).otherwise(mid).alias("hi"))

    # where even exponent 0 is not too flat, the interval's upper end falls to 0
    row = cut(row.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"]))
    row = row.withColumn("z", norm(F.col("a")))
    size = F.lit(float(budget)) if budget is not None else F.col("all") * F.array_max(F.transform("p", lambda x: x["p"] * F.col("z") / F.pow(x["p"], F.col("a"))))
    got = row.select("a", "z", size.alias("size"), "all").first()  # four numbers
    weight = F.pow(F.col("total") / F.lit(got["all"]), F.lit(got["a"])) / F.lit(got["z"])
    each = totals.select("source", "total", F.lit(got["a"]).alias("exponent"), weight.alias("weight"))
    each = each.withColumn("quota", F.round(F.col("weight") * F.lit(got["size"])).cast("long"))
    return each.withColumn("full", F.expr("quota div total")).withColumn("rest", F.expr("quota % total"))


def schedule(docs: DataFrame, doc_id: str = "doc_id", seed: int = 42, block_tokens: int = 100_000, max_repeat: float = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(doc_id, source, tokens) -> a row for each time a document is used: the columns, epoch, key, weight, block, slot.

    A document is in an epoch of its source's whole passes; in the last, partial
    one it is if its key is at most the key at which the tokens before it still
    leave room. Repeated rows share a key and go together. block is the run of
    the mixture the use falls into, slot its place there. Empty in, empty out.
    Columns of ``docs`` named epoch, key, weight, block, slot or with a leading
    underscore are reserved.
    """
    w = cut(weights(docs, max_repeat, target_entropy, budget))
    size = w.agg(F.sum("quota")).first()[0] or 1
    blocks = -(-size // block_tokens)
    use = docs.join(small(w.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    use = use.where(F.col("quota") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    use = use.withColumn("key", order_key(F.col(doc_id), F.col("epoch"), seed)).drop("exponent", "rest")
    order = ["source", "epoch", "key", doc_id, "tokens"]
    at = running(ranged(use, order), order, ["source"], {"before": F.col("tokens")})
    # rows that share a key are told apart by arrival only: they all stand where the first does
    room = at.where(F.col("before") < F.col("quota"))
    ends = room.where(F.col("epoch") == F.col("full")).groupBy("source").agg(F.max("key").alias("_end"))
    ends = small(cut(ends.withColumnRenamed("source", "_s")))
    kept = at.join(ends, at["source"].eqNullSafe(ends["_s"]), "left").where((F.col("epoch") < F.col("full")) | (F.col("key") <= F.col("_end")))
    part = F.expr(f"(CAST(before AS DECIMAL(20,0)) * {blocks}) div CAST(quota AS DECIMAL(20,0))")
    kept = kept.withColumn("block", F.least(part, F.lit(blocks - 1)).cast("long"))
    inside = Window.partitionBy("block").orderBy("key", doc_id, "source", "tokens")
    return kept.withColumn("slot", (F.row_number().over(inside) - 1).cast("long")).select(*docs.columns, "epoch", "key", "weight", "block", "slot")


def cutoffs(sized: DataFrame, doc_id: str = "doc_id", seed: int = 42, **kwargs) -> DataFrame:
    """Per source: full (whole passes) and end (the last key of the partial pass; null if there is none)."""
    w = cut(weights(sized, **kwargs))
    rest = sized.join(small(w.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").where("rest > 0")
    rest = rest.select("source", "full", "rest", "tokens", doc_id, order_key(F.col(doc_id), F.col("full"), seed).alias("key"))
    order = ["source", "key", doc_id, "tokens"]
    at = running(ranged(rest, order), order, ["source"], {"before": F.col("tokens")})
    ends = at.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max("key").alias("end")).withColumnRenamed("source", "_s")
    return cut(w.join(ends, w["source"].eqNullSafe(ends["_s"]), "left").select("source", "full", "end"))


def mixed(docs: DataFrame, seed: int = 42, **kwargs) -> DataFrame:
    """``docs`` (with doc_id, source, text) with each row as often as the mixture uses it; the columns are unchanged.

    The same uses as ``schedule`` gives; texts are not shuffled for it, since a
    source's last key decides the partial pass. Null, empty and very long texts
    count their words, one at least; null ids and null sources are ids and a
    source of their own; repeated rows are used alike; an empty table gives an
    empty result; extra columns are kept, names with two leading underscores
    are reserved.
    """
    sized = cut(docs.select("doc_id", "source", n_tokens(F.col("text").cast("string")).alias("tokens")))
    ends = cutoffs(sized, "doc_id", seed, **kwargs).toDF("__source", "__full", "__end")
    both = docs.join(small(ends), docs["source"].eqNullSafe(ends["__source"]))
    full, end = F.col("__full"), F.col("__end")
    taken = end.isNotNull() & (order_key(F.col("doc_id"), full, seed) <= end)
    uses = full + F.when(taken, 1).otherwise(0)
    return both.where(uses > 0).withColumn("__use", F.explode(F.sequence(F.lit(1).cast("long"), uses))).select(*docs.columns)


def op9_mixing(docs: DataFrame) -> DataFrame:
    """Every use of a document in the mixture: doc_id, source, tokens, epoch, weight, block, slot."""
    sized = cut(docs.select("doc_id", "source", n_tokens(F.col("text").cast("string")).alias("tokens")))
    out = schedule(sized)
    return out.select("doc_id", "source", "tokens", "epoch", F.round("weight", 9).alias("weight"), "block", "slot")


#: The mixture as one SQL script part: CTE ``uses`` has a row for each use of a document of ``{docs}``.
USES_SQL = """
sized AS (SELECT doc_id, source, CAST(greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1) AS BIGINT) AS tokens FROM {docs}),
totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM sized GROUP BY source),
shares AS (SELECT source, total, total / sum(total) OVER () AS p, sum(total) OVER () AS whole FROM totals),
bisect(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN mid ELSE lo END, CASE WHEN f THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(p, (lo + hi) / 2) / p) > 2 * min(pow(p, (lo + hi) / 2) / p) FROM shares) AS f FROM bisect WHERE i < 60)),
ex AS (SELECT hi AS a FROM bisect WHERE i = 60),
z AS (SELECT a, (SELECT sum(pow(p, a)) FROM shares) AS z FROM ex),
quotas AS (
  SELECT source, total, pow(p, a) / z AS weight,
    CAST(round(pow(p, a) / z * (whole * (SELECT max(p * z / pow(p, a)) FROM shares, z))) AS BIGINT) AS quota FROM shares, z),
w AS (SELECT *, quota // total AS f, quota % total AS rest FROM quotas),
epochs AS (
  SELECT s.*, w.weight, w.quota, w.f, e.range AS epoch,
    CAST('0x' || substr(md5('42:' || e.range || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM sized s JOIN w ON s.source IS NOT DISTINCT FROM w.source, LATERAL (SELECT unnest(range(CAST(CASE WHEN rest > 0 THEN f + 1 ELSE f END AS BIGINT))) AS range) e
  WHERE quota > 0),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY epoch, key, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS before FROM epochs),
ends AS (SELECT source, max(key) AS last FROM placed WHERE before < quota AND epoch = f GROUP BY source),
uses AS (
  SELECT p.* FROM placed p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source WHERE epoch < f OR key <= last)
"""

OP9_SQL = "WITH RECURSIVE " + USES_SQL.format(docs="documents") + """,
n AS (SELECT CAST(ceil(sum(quota) / 100000.0) AS BIGINT) AS blocks FROM w),
b AS (SELECT u.*, CAST(least(before * blocks // quota, blocks - 1) AS BIGINT) AS block FROM uses u, n)
SELECT doc_id, source, tokens, epoch, round(weight, 9) AS weight, block,
  row_number() OVER (PARTITION BY block ORDER BY key, doc_id, source, tokens) - 1 AS slot FROM b
"""
