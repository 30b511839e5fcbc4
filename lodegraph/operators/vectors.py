"""Vector and keyword search over small sets of queries, and centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .bounds import small

#: Most queries that go to every task.
QUERIES = 1_000


def unit(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with its vector and norm as doubles; vectors of norm 0 go."""
    return df.withColumn("v", F.transform(vector, lambda x: x.cast("double"))).withColumn("len", names.norm("v")).filter("len > 0")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, similarity: the exact k nearest of each query by cosine, ties to the lesser id.  For a few queries: they
    go to every task, the vectors are not shuffled, and each task keeps k rows a query.  More are an error; see knn_blocks."""
    if queries.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"more than {QUERIES} queries; knn_blocks takes any number")
    q = unit(queries).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("len").alias("ql"))
    both = unit(vectors).select("id", "v", "len").join(F.broadcast(q), F.col("id") != F.col("query_id"))
    scored = both.select("query_id", "id", (names.dot("qv", "v") / (F.col("ql") * F.col("len"))).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", names.similarity(F.col("cosine")).alias("similarity"))


def _blocks(vectors: DataFrame, prefix: str, rows: int = 2000) -> DataFrame:
    """A row for so many vectors: their ids, and their vectors scaled to length 1, as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                v = np.array(part.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, v)], [f"{prefix}_ids", f"{prefix}_v"])

    return unit(vectors).filter("id is not null").select("id", "v").mapInArrow(run, f"{prefix}_ids binary, {prefix}_v binary")


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """As knn, for any number of queries with vectors of one length and ids that are numbers: blocks of queries meet blocks of
    vectors, and only k rows a query and block are shuffled.  The work grows with queries times vectors."""

    def run(batches):
        for batch in batches:
            for q_ids, q, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                if not len(q_ids) or not len(ids):
                    continue
                cosine = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(v).reshape(len(ids), -1).T
                for query, own in zip(q_ids, np.round(cosine, 9), strict=True):
                    own[ids == query] = -np.inf
                    near = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
                    near = near[np.lexsort((ids[near], -own[near]))][:k]
                    near = near[ids[near] != query]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), query)), pa.array(ids[near]), pa.array(own[near])], ["query_id", "id", "cosine"])

    both = _blocks(queries, "q").crossJoin(_blocks(vectors, "b")).select("q_ids", "q_v", "b_ids", "b_v")
    scored = both.mapInArrow(run, "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", names.similarity(F.col("cosine")).alias("similarity"))


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """by, position, value: the mean vector of each group, scaled to length 1; partial sums before the shuffle."""
    means = vectors.select(by, F.posexplode("embedding").alias("position", "x")).groupBy(by, "position").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = means.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    return means.join(length, by).select(by, F.col("position").cast("long").alias("position"), (F.col("m") / F.col("len")).alias("value"))


def keyword_rank(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank: documents that hold all terms of a query, by their summed counts, ties to the lesser id.  queries:
    query_id, term.  Terms are a given, bounded set; the documents are read once and only hits are shuffled."""
    many = queries.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    words = docs.select("id", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("term"))
    tf = words.join(small(queries.select("term").distinct()), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(small(queries.distinct()), "term").groupBy("query_id", "id").agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("n")).join(small(many), "query_id").filter("n = n_terms")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "rank")


def fuse(first: DataFrame, second: DataFrame, k: int, c: int = 60) -> DataFrame:
    """query_id, id, score, rank: reciprocal rank fusion of two ranked lists."""
    a = first.select("query_id", "id", F.col("rank").alias("r1"))
    b = second.select("query_id", "id", F.col("rank").alias("r2"))
    score = F.coalesce(1.0 / (F.col("r1") + c), F.lit(0.0)) + F.coalesce(1.0 / (F.col("r2") + c), F.lit(0.0))
    own = a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(score, 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return own.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def semantic_check(snippets: DataFrame, examples: DataFrame, threshold: float = 0.75) -> DataFrame:
    """id, violation, compliance, violates: the greatest similarity to either kind of example; a violation is near a bad
    example and not near a good one.  examples: example_id, kind (violation, compliance), embedding; a bounded set."""
    e = unit(examples).select("kind", F.col("v").alias("ev"), F.col("len").alias("el"))
    both = unit(snippets).select("id", "v", "len").crossJoin(small(e))
    sim = names.similarity(names.dot("v", "ev") / (F.col("len") * F.col("el")))
    out = both.select("id", "kind", sim.alias("s")).groupBy("id").agg(F.max(F.when(F.col("kind") == "violation", F.col("s"))).alias("violation"), F.max(F.when(F.col("kind") == "compliance", F.col("s"))).alias("compliance"))
    return out.withColumn("violates", (F.coalesce("violation", F.lit(0.0)) >= threshold) & (F.coalesce("compliance", F.lit(0.0)) < threshold))


# The weights of the fields of a keyword match.
WEIGHTS = {"name": 1.0, "docstring": 0.4, "summary": 0.2}


def weighted_keywords(nodes: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, id, rank, score: nodes that hold all terms of a query in any field, by the sum of the weights of the fields' hits,
    ties to the lesser id.  queries: query_id, term (lower case); words are runs of letters and digits."""
    weights = weights or WEIGHTS
    words = None
    for field, weight in weights.items():
        own = nodes.select("id", F.explode(F.split(F.lower(field), "[^a-z0-9]+")).alias("term")).withColumn("w", F.lit(weight))
        words = own if words is None else words.unionByName(own)
    asked = queries.distinct()
    many = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    by_term = words.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("id", "term").agg(F.sum("w").alias("w"))
    hits = by_term.join(small(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("n")).join(small(many), "query_id").filter("n = n_terms")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def scoped_search(hits: DataFrame, owners: DataFrame, project: str | None, k: int) -> DataFrame:
    """query_id, rank, id, similarity: the best k of a project (owners: id, project_id); the project is picked before the k, so none is
    missed."""
    own = hits if project is None else hits.join(owners.filter(F.col("project_id") == project).select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    return own.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k).select("query_id", F.col("place").alias("rank"), "id", "similarity")


def cache_vectors(vectors: DataFrame, cache: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has to be embedded, and the cache's hits: wanted (id, body_hash) against the cache (body_hash, embedding); ids that have a
    vector already are left out."""
    missing = wanted.join(vectors.select("id"), "id", "left_anti")
    hits = missing.join(cache.select("body_hash", "embedding"), "body_hash").select("id", "body_hash", "embedding")
    return missing.join(cache.select("body_hash").distinct(), "body_hash", "left_anti").select("id", "body_hash"), hits


def route(nodes: DataFrame) -> DataFrame:
    """id, model: documented functions go to the small model, the others to the fallback."""
    documented = (F.coalesce("docstring", F.lit("")) != "") | (F.coalesce("summary", F.lit("")) != "")
    return nodes.select("id", F.when(documented, "small").otherwise("fallback").alias("model"))
