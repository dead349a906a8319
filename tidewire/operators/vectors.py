"""Vector similarity, search and clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions.text import words_of
from tidewire.operators.scans import top_k

BLOCK_CELLS = 4_000_000  # numbers in a block of vectors, and scores held at once by a task


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return 1.0 / (1.0 + F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + d * d)))


METHODS = {"cosine": cosine, "euclidean": euclidean, "dot_product": dot}


def most_similar(
    candidates: DataFrame, query: Column, k: int = 5, method: str = "cosine",
    vector: str = "embedding", key: str = "id",
) -> DataFrame:
    """Top-k candidates for one query vector (a literal or a scalar subquery)."""
    scored = candidates.withColumn("_q", query).withColumn(
        "score", METHODS[method](F.col(vector), F.col("_q"))
    )
    return scored.drop("_q").orderBy(F.desc("score"), key).limit(k)


def within_distance(
    candidates: DataFrame, query: Column, threshold: float = 0.7, limit: int = 10,
    vector: str = "embedding", key: str = "id",
) -> DataFrame:
    """Candidates with cosine distance below ``1 - threshold``, nearest first."""
    distance = 1.0 - cosine(F.col(vector), F.col("_q"))
    return (
        candidates.where(F.col(vector).isNotNull())
        .withColumn("_q", query)
        .withColumn("distance", distance)
        .drop("_q")
        .where(F.col("distance") < 1.0 - threshold)
        .withColumn("confidence", 1.0 - F.col("distance"))
        .orderBy("distance", key)
        .limit(limit)
    )


def similar_per_query(
    queries: DataFrame, candidates: DataFrame, k: int = 5, threshold: float | None = None,
    query_key: str = "query_id", key: str = "id", vector: str = "embedding",
) -> DataFrame:
    """(query, candidate, score, rank): the k best candidates by cosine for every query.

    A product of blocks: queries and candidates are dealt to blocks of about ``BLOCK_CELLS`` numbers by a hash
    of their keys, each pair of blocks is one matrix product in one task, and it passes on at most k rows per
    query. Scores are rounded to 12 decimals, so that ties do not depend on the blocks; they go by key. Rows
    without a vector match nothing.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("_q"), F.col(vector).alias("_v"))
    known = candidates.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    asked_blocks, known_blocks = _blocks(asked), _blocks(known)
    left = asked.withColumn("_qb", _block("_q", asked_blocks)).withColumn("_kb", _every(known_blocks))
    right = known.withColumn("_kb", _block("_k", known_blocks)).withColumn("_qb", _every(asked_blocks))
    qt, kt = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (candidates, key)))

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"_q": [], "_k": [], "score": []})
        # Rows by key: a stable order by score then leaves ties in the order of the keys.
        known = known.sort_values("_k", kind="stable")
        keys, m = known["_k"].to_numpy(), _unit(np.stack(known["_v"].to_numpy()).astype(np.float64))
        parts = []
        step = max(1, BLOCK_CELLS // len(known))
        for at in range(0, len(asked), step):
            some = asked.iloc[at : at + step]
            scores = np.round(_unit(np.stack(some["_v"].to_numpy()).astype(np.float64)) @ m.T, 12)
            for qid, s in zip(some["_q"], scores):
                if threshold is not None:
                    pick = np.nonzero(s > threshold)[0]
                elif len(s) > k:
                    pick = np.nonzero(s >= np.partition(s, len(s) - k)[len(s) - k])[0]
                else:
                    pick = np.arange(len(s))
                pick = pick[np.argsort(-s[pick], kind="stable")][:k]
                parts.append(pd.DataFrame({"_q": [qid] * len(pick), "_k": keys[pick], "score": s[pick]}))
        return pd.concat(parts)

    hits = (
        left.groupBy("_qb", "_kb")
        .cogroup(right.groupBy("_qb", "_kb"))
        .applyInPandas(best, f"_q {qt}, _k {kt}, score double")
        .select(F.col("_q").alias(query_key), F.col("_k").alias(key), "score")
    )
    return top_k(hits, [query_key], k, F.desc("score"), F.col(key))


def _blocks(df: DataFrame) -> int:
    """Blocks of about ``BLOCK_CELLS`` numbers that hold the vectors."""
    cells = df.agg(F.sum(F.size("_v"))).first()[0] or 0
    return int(-(-cells // BLOCK_CELLS)) or 1


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def near_per_query(
    queries: DataFrame, candidates: DataFrame, threshold: float = 0.7, limit: int = 10, bits: int = 8,
    recall: float = 0.95, seed: int = 42, query_key: str = "query_id", key: str = "id", vector: str = "embedding",
) -> DataFrame:
    """(query, candidate, distance, confidence, rank): per query the nearest within 1 - ``threshold``, by signs.

    For many queries against many candidates, of which few are asked for. Every vector gets
    one key of ``bits`` signs for each of several sets of random planes; query and candidate meet where a key
    is equal, and each pair that meets is verified by its exact cosine. A pair at the threshold
    shares all signs of a set with p = (1 - angle / pi) ^ bits, and the number of sets is such that it meets
    with probability ``recall``; nearer pairs meet more often. More ``bits`` mean fewer pairs to verify and
    more sets. Vectors without length or null match nothing.

    Queries and candidates are dealt to blocks as in :func:`similar_per_query`. The keys are compared inside a pair
    of blocks, and a task passes on at most ``limit`` rows per query; neither keys nor pairs are shuffled.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold is between 0 and 1")
    p = (1 - math.acos(threshold) / math.pi) ** bits
    sets = math.ceil(math.log(1 - recall) / math.log(1 - p))

    def signs(vecs: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(seed).standard_normal((vecs.shape[1], sets * bits))
        keys = np.empty((sets, len(vecs)), np.min_scalar_type(2**bits - 1))
        for at in range(0, len(vecs), 1024):
            on = (vecs[at : at + 1024] @ planes > 0).reshape(-1, sets, bits)
            keys[:, at : at + 1024] = (on << np.arange(bits)).sum(axis=2).T
        return keys

    def near(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"_q": [], "_k": [], "distance": []})
        known = known.sort_values("_k", kind="stable")
        ids, m = known["_k"].to_numpy(), np.stack(known["_v"].to_numpy()).astype(np.float64)
        there, unit, sizes = signs(m), _unit(m), _norms(m)
        parts = []
        step = max(1, BLOCK_CELLS // len(known))
        for at in range(0, len(asked), step):
            some = asked.iloc[at : at + step]
            q = np.stack(some["_v"].to_numpy()).astype(np.float64)
            meets = np.zeros((len(q), len(m)), bool)
            for mine, others in zip(signs(q), there):
                meets |= mine[:, None] == others[None, :]
            scores = np.where(meets, _unit(q) @ unit.T, -2.0)
            # What rounding may have moved is kept for the exact cosine.
            least = np.full(len(q), threshold)
            if len(m) > limit:
                least = np.maximum(least, np.partition(scores, len(m) - limit, axis=1)[:, len(m) - limit])
            x, y = np.nonzero(scores >= least[:, None] - 1e-9)
            distance = 1.0 - _sum_of_products(q[x], m[y]) / (_norms(q)[x] * sizes[y])
            hit = distance < 1.0 - threshold
            x, y, distance = x[hit], y[hit], distance[hit]
            order = np.lexsort((y, distance, x))
            x, y, distance = x[order], y[order], distance[order]
            first = np.arange(len(x)) - np.searchsorted(x, x) < limit
            parts.append(pd.DataFrame({"_q": some["_q"].to_numpy()[x[first]], "_k": ids[y[first]], "distance": distance[first]}))
        return pd.concat(parts)

    def rows(df: DataFrame, name: str, as_: str) -> DataFrame:
        return df.where(norm(F.col(vector)) > 0).select(F.col(name).alias(as_), F.col(vector).alias("_v"))

    asked, known = rows(queries, query_key, "_q"), rows(candidates, key, "_k")
    asked_blocks, known_blocks = _blocks(asked), _blocks(known)
    left = asked.withColumn("_qb", _block("_q", asked_blocks)).withColumn("_kb", _every(known_blocks))
    right = known.withColumn("_kb", _block("_k", known_blocks)).withColumn("_qb", _every(asked_blocks))
    qt, kt = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (candidates, key)))
    hits = (
        left.groupBy("_qb", "_kb")
        .cogroup(right.groupBy("_qb", "_kb"))
        .applyInPandas(near, f"_q {qt}, _k {kt}, distance double")
        .select(F.col("_q").alias(query_key), F.col("_k").alias(key), "distance", (1.0 - F.col("distance")).alias("confidence"))
    )
    return top_k(hits, [query_key], limit, F.asc("distance"), F.col(key))


def _sum_of_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of each row of ``a`` with that of ``b``, added up in the order of :func:`dot`."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum_of_products(a, a))


def cluster(
    df: DataFrame, k: int = 5, method: str = "kmeans", seed: int = 42, vector: str = "embedding"
) -> DataFrame:
    """Add ``cluster``. "hierarchical" is divisive (bisecting), which scales, where an
    agglomerative method would need all pairs."""
    model = {"kmeans": KMeans, "hierarchical": BisectingKMeans}[method](
        k=k, seed=seed, featuresCol="_features", predictionCol="cluster"
    )
    features = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.fit(features.select("_features")).transform(features).drop("_features")


def hashed_embedding(df: DataFrame, text: str = "text", dims: int = 384) -> DataFrame:
    """Add ``embedding``: term counts hashed to ``dims`` slots, zero vector for NULL text."""
    words = df.withColumn("_words", F.coalesce(words_of(F.col(text)), F.array().cast("array<string>")))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims)
    return (
        tf.transform(words)
        .withColumn("embedding", vector_to_array("_tf", "float32"))
        .drop("_words", "_tf")
    )


def cross_reference(
    queries: DataFrame, history: DataFrame, k: int = 5, threshold: float = 0.7, query_key: str = "query_id",
) -> DataFrame:
    """Number of similar historical rows (at most k) per current row."""
    found = similar_per_query(queries, history, k, threshold, query_key)
    counts = found.groupBy(query_key).agg(F.count("*").alias("similar_events"))
    return queries.select(query_key).join(counts, query_key, "left").fillna({"similar_events": 0})
