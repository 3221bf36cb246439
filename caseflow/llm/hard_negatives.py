"""Hard negatives for anchors, by angular triangle filtering.

Each row keeps its angles to reference directions. For an anchor a and a row v, every direction u bounds the angle between them: at
least the difference of their angles to u, at most their sum (or what is left of a full turn). Cosines of these, times both norms
and widened by more than their rounding, are an interval of the score. Only rows whose interval overlaps a wanted window
are scored with whole numbers.

First each anchor's best rows of its own label are found, its positives; then, for each anchor and positive, the best rows of
other labels with a score between two shares of the positive's. Both are searches of vector_search, which tells of tables,
rounds and scale.

Edge cases: rows with a null vec_id, label or vector, or with null or non-finite components, take no part; rows with the
anchor's vec_id are its own; anchors that repeat whole are one, other rows that repeat count each; a positive of negative
score has no window; ties go to the smaller vec_id; vectors of different lengths do not meet, one of zeros scores 0;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import Angles, asked, chunks_of, quantised, references, searched, tiles_of

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score, in hundredths of its positive's.
SHARES = (30, 90)
SHIFT_EVERY, LABELS = 7, 10

SQL = f"""WITH q AS (SELECT vec_id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS y, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.y = b.y AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {SHARES[0]} * positive_score <= 100 * score AND 100 * score <= {SHARES[1]} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors among rows, both (vec_id long,
    label long, vector array<long>)."""
    whole = lambda df: df.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("vec_id", "label", "vector")
    rows, asking, kind = whole(rows), asked(rows.sparkSession, whole(anchors)), Angles()
    pivots = references(rows)
    tiles = tiles_of(rows, kind, pivots)
    found = searched(tiles, chunks_of(asking, kind, pivots), kind, positives, side=1)
    windows = found.filter("score >= 0").select("key", F.col("vec_id").alias("tag"), F.col("score").alias("value"), F.expr(f"(score * {shares[0]} + 99) div 100").alias("low"), F.expr(f"(score * {shares[1]}) div 100").alias("high"))
    again = asking.select("key", "vec_id", "label", "vector").join(windows, "key")
    out = searched(tiles, chunks_of(again, kind, pivots), kind, negatives, side=2)
    return out.select(F.col("query_id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("value").alias("positive_score"), F.col("score").alias("negative_score"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """mine() of embeddings (vec_id, label, embedding): whole numbers, labels of every seventh id shifted, every hundredth id an anchor."""
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised("embedding", SCALE).alias("vector"))
    return mine(rows, rows.filter(F.col("vec_id") % EVERY == 0))
