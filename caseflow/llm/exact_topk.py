"""Exact top-k search by inner product with a pivot table.

Each row keeps its distances to many pivots. For a query the largest difference of two such distances is a lower bound
of the distance of query and row, so (|q|^2 + |v|^2 - bound^2) / 2 is an upper bound of their product. Rows are scored in the order of
their bounds until no bound reaches the k-th score. See vector_search for tables, rounds and scale.

Edge cases: rows with a null vec_id, and vectors null or holding null or non-finite components, take no part; rows with
the query's vec_id are its own; queries that repeat whole are one, candidates that repeat count each; ties go to the
smaller vec_id; vectors of different lengths do not meet, empty ones score 0 with each other; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import Distances, asked, quantised, search

SCALE, EVERY, K = 1024, 100, 10

SQL = f"""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}"""


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries among rows, both (vec_id long, vector array<long>)."""
    plain = lambda df: df.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", F.lit(0).cast("long").alias("label"), "vector")
    found = search(plain(rows), asked(rows.sparkSession, plain(queries)), Distances(), k)
    return found.select("query_id", "rank", "vec_id", "score")


def top_k_of(embeddings: DataFrame, scale: int = SCALE, every: int = EVERY, k: int = K) -> DataFrame:
    """top_k() of embeddings (vec_id, embedding), made whole numbers; every row whose id `every` divides is a query."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("vector"))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
