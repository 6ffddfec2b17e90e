"""Mixing sources to target weights by systematic sampling.

A source's documents stand in order of size, the longest first (then by doc_id, null last, then by their place in the input). Expected copies
are prefix-summed along that order, one random offset in [0, 1) of the source's own is added, and a document is taken once for each integer
crossed. A document has at most 3 copies.

Expected copies: with equal ones, the words taken would miss a target by up to the longest document. So the first WHOLE documents of a source
have whole numbers, which cross as many integers wherever the offset lies: along their words' prefix sum W, a document of size s has
floor((f W - taken so far) / s + offset) copies, where f = target / words of the source. What is then left of the target is shared evenly
by the other documents. So a source's taken words come within about the size of the document after the WHOLE longest ones, or of the
shortest of all if there are no more.

Null text has size 0, null source is a source of its own and comes last, texts of any length count whole, rows that repeat are documents of
their own (which of them is taken goes by their place in the input), an empty table gives an empty result. Extra columns are never read
by the plan, whatever their names and types, and pass through mix().

Only DataFrame operations run here. No window holds a source: rows are sorted into ranges of (source, size, doc_id, place), which split a hot
source, or a hot doc_id, anywhere; a row's rank is its number in its range and the counts of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, join_hot, partitions, row_hash, stored, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No target is above this many times its source's size.
MOST = 3
#: Documents of a source that have whole numbers of expected copies: that many rows of a source are in one group at most.
WHOLE = 1024
_SOURCE = ["s_null", "s_name"]


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _source_key() -> list[Column]:
    return [F.col("source").isNull().cast("int").alias("s_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s_name")]


def _sorted(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df in ranges of the order, with `range` and the row's number in it, from 0."""
    df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(df, tag).withColumns({"range": F.shiftright("place", 33), "number": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("place")


def targets(by: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """by (s_null, s_name, source_size ...), one row for each source, with its target.

    A target is min(most x size, level x weight) with the level at which targets add up to all sizes. The level rises while sources
    become full; each step adds up what isn't.
    """
    placed = _sorted(by, [F.col(c) for c in _SOURCE], "mix-sources")
    # One row a range.
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.col("before") + F.col("number")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int"))
    limit = F.lit(most) * F.col("source_size")
    placed = stored(placed.join(ranges, "range").withColumns({"weight": weight, "limit": limit, "ratio": limit / weight}).drop("range", "number", "before"), "mix-weights")
    level, full = -1.0, -1
    while True:
        over = F.col("ratio") <= F.lit(level)
        r = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("limit"))).alias("limits"), F.sum(F.when(~over, F.col("weight"))).alias("weights"), F.count_if(over).alias("full")).first()
        if r["full"] == full or not r["weights"]:
            break
        level, full = (r["all"] - (r["limits"] or 0)) / r["weights"], r["full"]
    target = F.when(F.col("ratio") <= F.lit(level), F.col("limit").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return placed.withColumn("target", target).drop("weight", "limit", "ratio")


def offset() -> Column:
    """A source's random offset in [0, 1), from a hash of its name: the same in each run."""
    seed = F.md5(F.concat(F.lit("offset:"), F.col("s_null").cast("string"), F.lit(":"), F.col("s_name")))
    return F.conv(F.substring(seed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _whole(longest: DataFrame) -> DataFrame:
    """s_null, s_name, whole (of the first documents their copies, in order), whole_size, whole_taken, from (s_null, s_name, nth, size, rate, offset)."""
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("nth", "size"))), lambda x: x["size"]).alias("sizes")
    by = longest.groupBy(*_SOURCE).agg(sizes, F.first("rate").alias("rate"), F.first("offset").alias("offset"))
    big = lambda n: F.lit(n).cast("bigint")

    def take(acc: Column, size: Column) -> Column:
        words = acc["words"] + size
        due = F.when(size > 0, (F.col("rate") * words - acc["taken"]) / size).otherwise(F.col("rate"))
        copies = F.greatest(F.least(F.floor(due + F.col("offset")), big(MOST)), big(0))
        return F.struct(words.alias("words"), (acc["taken"] + copies * size).alias("taken"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(big(0).alias("words"), big(0).alias("taken"), F.array().cast("array<bigint>").alias("copies"))
    by = by.withColumn("sum", F.aggregate("sizes", start, take))
    return by.select(*_SOURCE, F.col("sum.copies").alias("whole"), F.col("sum.words").alias("whole_size"), F.col("sum.taken").alias("whole_taken"))


def plan(docs: DataFrame, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies (0 to 3) of each row of docs (doc_id, text, source), and the columns named in carry."""
    rest = carry or []
    rows = docs.select(F.col(key).alias("doc_id"), *_source_key(), size_of(text_of()).alias("size"), F.monotonically_increasing_id().alias("row"), *rest)
    # Counted once; sorting into ranges reads its rows twice.
    rows = stored(rows, "mix-sizes")
    order = [F.col("s_null"), F.col("s_name"), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    rows = _sorted(rows, order, "mix-order").drop("row")
    cells = stored(rows.groupBy("range", *_SOURCE).agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")
    by = targets(cells.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows")))
    by = stored(by.withColumns({"rate": _rate(), "offset": offset()}), "mix-targets")
    before = F.coalesce(F.sum("n").over(W.partitionBy(*_SOURCE).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("before", before).select("range", *_SOURCE, "low", "before")
    nth = F.col("number") - F.col("low") + F.col("before") + F.lit(1)
    met = stored(rows.join(starts, ["range", *_SOURCE]).withColumn("nth", nth).drop("range", "number", "low", "before"), "mix-ranks")
    whole = _whole(met.where(F.col("nth") <= WHOLE).join(by.select(*_SOURCE, "rate", "offset"), _SOURCE))
    left = (F.col("target") - F.col("whole_taken")) / (F.col("source_size") - F.col("whole_size"))
    share = F.when(F.col("source_size") > F.col("whole_size"), F.greatest(F.least(left, F.lit(float(MOST))), F.lit(0.0))).otherwise(F.lit(0.0))
    sums = stored(by.join(whole, _SOURCE).withColumn("share", share), "mix-sums")
    source = F.struct(*_SOURCE).alias("source_key")
    total = met.count()
    first = met.where(F.col("nth") <= WHOLE).join(sums.select(*_SOURCE, "source_size", "target", "whole"), _SOURCE)
    first = first.select("doc_id", "size", "source_size", "target", F.element_at("whole", F.col("nth").cast("int")).alias("copies"), *rest)
    others = join_hot(met.where(F.col("nth") > WHOLE).select("*", source), sums.select(source, "rows", "source_size", "target", "share", "offset"), "source_key", "rows", total)
    upto = F.col("nth") - F.lit(WHOLE)
    crossed = F.floor(F.col("share") * upto + F.col("offset")) - F.floor(F.col("share") * (upto - 1) + F.col("offset"))
    others = others.select("doc_id", "size", "source_size", "target", F.greatest(F.least(crossed, F.lit(MOST)), F.lit(0)).cast("bigint").alias("copies"), *rest)
    return first.unionByName(others)


def query(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mix takes it, with all its columns."""
    rows = docs.select("doc_id", "text", "source", row_hash(docs).alias("rl_row"))
    # Rows that are alike in all columns share their copies: which of them gets which can't matter.
    planned = plan(rows, carry=["rl_row"]).groupBy("doc_id", "rl_row").agg(F.sum("copies").alias("__rl_sum"), F.count(F.lit(1)).alias("__rl_rows"))
    taken = planned.where("__rl_sum > 0").select(F.col("doc_id").alias("__rl_id"), F.col("rl_row").alias("__rl_hash"), "__rl_sum", "__rl_rows")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__rl_doc"), F.col("doc_id").alias("__rl_key"), row_hash(docs).alias("__rl_mark"))
    met = wide.join(taken, F.col("__rl_key").eqNullSafe(F.col("__rl_id")) & (F.col("__rl_mark") == F.col("__rl_hash")))
    few = met.where("__rl_rows = 1").select("__rl_doc", F.col("__rl_sum").alias("__rl_n"))
    alike = met.where("__rl_rows > 1").groupBy("__rl_key", "__rl_mark").agg(F.first("__rl_doc").alias("__rl_doc"), F.first("__rl_sum").alias("__rl_n")).select("__rl_doc", "__rl_n")
    out = few.unionByName(alike).select("__rl_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__rl_n"))).alias("__rl_copy"))
    return out.select("__rl_doc.*")


ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS s_null, coalesce(source, '') AS s_name,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT s_null, s_name, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY ALL
), w AS (
  SELECT *, (row_number() OVER (ORDER BY s_null, s_name) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, 3 * source_size AS lim, (3 * source_size)::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight FROM w
), c AS (
  SELECT *, (total - coalesce(CAST(sum(lim) OVER p AS BIGINT), 0))::DOUBLE / (all_weight - coalesce(CAST(sum(weight) OVER p AS BIGINT), 0)) AS lev
  FROM l WINDOW p AS (ORDER BY ratio, s_null, s_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT s_null, s_name, source_size,
         CASE WHEN lev >= ratio THEN lim::DOUBLE ELSE (SELECT arg_min(lev, (ratio, s_null, s_name)) FROM c WHERE lev < ratio) * weight END AS target
  FROM c
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('offset:' || s_null || ':' || s_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY s_null, s_name ORDER BY size DESC, doc_id NULLS LAST) AS nth FROM rows_
), g AS (
  SELECT r.doc_id, r.s_null, r.s_name, r.size, r.nth, f.source_size, f.target, f.rate, f.u FROM r JOIN f USING (s_null, s_name)
), first_ AS (
  SELECT s_null, s_name, nth, size, rate, u, CAST(sum(size) OVER (PARTITION BY s_null, s_name ORDER BY nth) AS BIGINT) AS words FROM g WHERE nth <= 1024
), walk AS (
  SELECT s_null, s_name, 0::BIGINT AS nth, 0::BIGINT AS copies, 0::BIGINT AS taken, 0::BIGINT AS words FROM f
  UNION ALL
  SELECT n.s_null, n.s_name, n.nth, n.copies, w.taken + n.copies * n.size, n.words
  FROM walk w, LATERAL (
    SELECT x.s_null, x.s_name, x.nth, x.size, x.words,
           greatest(least(CAST(floor(CASE WHEN x.size > 0 THEN (x.rate * x.words - w.taken) / x.size ELSE x.rate END + x.u) AS BIGINT), 3), 0) AS copies
    FROM first_ x WHERE x.s_null = w.s_null AND x.s_name = w.s_name AND x.nth = w.nth + 1
  ) n
), last_ AS (
  SELECT s_null, s_name, arg_max(taken, nth) AS taken, arg_max(words, nth) AS words FROM walk GROUP BY ALL
), h AS (
  SELECT g.*, g.nth - 1024 AS n,
         CASE WHEN source_size > last_.words THEN greatest(least((target - last_.taken) / (source_size - last_.words), 3.0::DOUBLE), 0.0::DOUBLE) ELSE 0 END AS share
  FROM g JOIN last_ USING (s_null, s_name)
)
SELECT h.doc_id, h.size, h.source_size, h.target,
       h.size * CASE WHEN h.nth <= 1024 THEN walk.copies
         ELSE CAST(greatest(least(floor(h.share * h.n + h.u) - floor(h.share * (h.n - 1) + h.u), 3), 0) AS BIGINT) END AS taken
FROM h LEFT JOIN walk ON walk.s_null = h.s_null AND walk.s_name = h.s_name AND walk.nth = h.nth
"""
