"""Vector search and clustering over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.base import Tables, query, r8
from tidewire.operators import vectors as vec


def _vectors(t: Tables):
    return t.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _first_vector(t: Tables):
    return t.table("embeddings").where("vec_id = 0").select("embedding").scalar()


def _centroids(t: Tables):
    """Mean vector per label: as many query vectors as labels, from all rows."""
    rows = t.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")
    )


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


_V = "SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"{_dot('e', 'q')} / (sqrt({_dot('e', 'e')}) * sqrt({_dot('q', 'q')}))"
_SCORED = f"(SELECT id, label, {_COS} AS s, {_dot('e', 'q')} AS d, 1 / (1 + sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - q[i]) ** 2)))) AS eu FROM ({_V}), (SELECT {_Q} AS q))"


@query(
    "vec01_similarity",
    f"SELECT id, round(s, 6) AS cosine, round(d, 6) AS dot, round(eu, 6) AS euclidean FROM {_SCORED}",
)
def _(t: Tables):
    e, q = F.col("embedding"), F.col("q")
    return _vectors(t).withColumn("q", _first_vector(t)).select(
        "id", F.round(vec.cosine(e, q), 6).alias("cosine"), F.round(vec.dot(e, q), 6).alias("dot"),
        F.round(vec.euclidean(e, q), 6).alias("euclidean"),
    )


@query(
    "vec02_most_similar",
    f"SELECT id, round(s, 6) AS score FROM {_SCORED} ORDER BY s DESC, id LIMIT 10",
)
def _(t: Tables):
    got = vec.most_similar(_vectors(t), _first_vector(t), 10)
    return got.select("id", F.round("score", 6).alias("score"))


@query(
    "srt05_top_euclidean",
    f"SELECT id, round(eu, 6) AS score FROM {_SCORED} ORDER BY eu DESC, id LIMIT 5",
)
def _(t: Tables):
    got = vec.most_similar(_vectors(t), _first_vector(t), 5, method="euclidean")
    return got.select("id", F.round("score", 6).alias("score"))


@query(
    "vec03_threshold_search",
    f"SELECT id, round(1 - s, 6) + 0.0 AS distance, round(s, 6) AS confidence FROM {_SCORED} WHERE 1 - s < 0.95 ORDER BY 1 - s, id LIMIT 40",
)
def _(t: Tables):
    got = vec.within_distance(_vectors(t), _first_vector(t), threshold=0.05, limit=40)
    return got.select("id", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


_CENT = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
  c AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY 1)"""


@query(
    "vec02_top_per_query",
    f"""WITH {_CENT} SELECT query_id, id, round(s, 6) AS score, r AS rank FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (
        SELECT c.query_id, v.id, {_COS} AS s FROM c, ({_V}) v)) WHERE r <= 5""",
)
def _(t: Tables):
    q = _centroids(t).withColumnRenamed("label", "query_id")
    got = vec.similar_per_query(q, _vectors(t), k=5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vec03_near_per_query")
def _(t: Tables):
    """Signs of random planes find the pairs, so SQL has no equal; its recall is tested against the exact form."""
    asked = _vectors(t).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vec.near_per_query(asked, _vectors(t), threshold=0.4, limit=10, bits=6)


@query(
    "vec07_cross_reference",
    f"""WITH {_CENT} SELECT query_id, count(*) FILTER (r <= 5 AND s > 0.3) AS similar_events FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (
        SELECT c.query_id, v.id, {_COS} AS s FROM c, ({_V}) v)) GROUP BY 1""",
)
def _(t: Tables):
    q = _centroids(t).withColumnRenamed("label", "query_id")
    return vec.cross_reference(q, _vectors(t), k=5, threshold=0.3)


@query("vec04_kmeans")
def _(t: Tables):
    """Labels depend on the library, so only the grouping is reported."""
    return vec.cluster(_vectors(t), 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query("vec05_hierarchical")
def _(t: Tables):
    return vec.cluster(_vectors(t), 5, "hierarchical").groupBy("cluster").agg(F.count("*").alias("n"))


@query("vec06_hashed_embedding")
def _(t: Tables):
    docs = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    got = vec.hashed_embedding(docs, dims=384)
    return got.select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("tokens"))
