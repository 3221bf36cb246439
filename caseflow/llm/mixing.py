"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, prefix sums up to word budgets.

Every source gets a budget of words. A budget of k times the source's size or more takes k complete epochs of all
its documents; what is left is filled with documents in the order of exponential keys -ln(u) / weight, smallest
first, up to the prefix whose sum is nearest to it. u is a hash of the document's id and a seed, so reruns agree.

Scale: the prefix sums of a source are formed in two levels. Keys are cut into ranges, the sums of the ranges are
summed up over a table of (source, range), and only within one range are documents sorted. Ranges are equally wide in the
logarithm of the key, in which a weight is only a shift: whatever the weights are, the fullest holds less than
1 / (e * RANGES) of a source, 0.07 %. A source with a third of all rows is thus spread over thousands of ranges.

Edge cases: null text has size 0; a null source is a source of its own; null ids hash as empty text; rows that agree
in id, source, size and weight are interchangeable; other columns are ignored; an empty table gives no rows. Sources
of size 0 have target 0 and nothing is taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
RANGES = 512  # ranges a unit of log(key)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column) -> Column:
    """The document's weight in the draw: from 0.2 for fragments to 1 for 200 words and more."""
    return F.lit(0.2) + F.lit(0.8) * F.least(size.cast("double"), F.lit(200.0)) / F.lit(200.0)


def uniform(doc_id: Column, seed: int) -> Column:
    """48 bits of a hash, as a number strictly between 0 and 1."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Water filling in closed form: in the order of cap / weight, a source is full if what is left for it and all later
    ones, dealt by weight, reaches its cap. Works on one row a source.
    """
    everything = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("nth"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("nth", F.row_number().over(by_source) - 1)
        .withColumn("w", w)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.sum("w").over(after) <= F.col("left") * F.col("w"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.col("w") / F.col("open_w")).alias("target"))
    )


def mix(docs: DataFrame, *, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, selected, taken) of documents (doc_id, text, source).

    weight: the document's weight in the draw, positive, over the columns doc_id, source and size; `quality` of the
    size unless given. taken = size * (epochs + selected).
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = (
        sized.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / (quality(F.col("size")) if weight is None else weight))
        .withColumn("range", F.floor(F.log("key") * ranges).cast("int"))
    )
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    r, s, t = rows.alias("r"), sums.alias("s"), targets.alias("t")
    plan = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.range", "range_before", "source_size", "target").alias("p")
    within = Window.partitionBy("r.source", "r.range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    selected = (F.col("epochs") < most) & (F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size"))
    return (
        r.join(plan, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range")))
        .withColumn("before", F.col("range_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("selected", selected.cast("long"))
        .select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "epochs", "selected", (F.col("size") * (F.col("epochs") + F.col("selected"))).alias("taken"))
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17'), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0)
        / (0.2e0 + 0.8e0 * least(size::DOUBLE, 200e0) / 200e0) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, [5e0, 2e0, 1e0][(nth % 3 + 1)::INT] AS w, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS total FROM n),
l AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS "left",
        sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM w),
f AS (SELECT *, cap * w_after <= "left" * w AS "full" FROM l),
g AS (SELECT *, total - coalesce(sum(CASE WHEN "full" THEN cap END) OVER (), 0e0) AS rest, sum(CASE WHEN NOT "full" THEN w END) OVER () AS open_w FROM f),
t AS (SELECT source, source_size, CASE WHEN "full" THEN cap ELSE rest * w / open_w END AS target,
        CASE WHEN source_size > 0 THEN floor((CASE WHEN "full" THEN cap ELSE rest * w / open_w END) / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
c AS (SELECT k.*, source_size, target, epochs,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 2 AND before + size / 2e0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
