"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each its mean and deviation are kept.  By Cauchy-Schwarz on the centred segments, a
segment of length n adds at most n * (mean * mean + deviation * deviation) to an inner product, which bounds the squared
distance |q|^2 + |v|^2 - 2 q.v from below.  Bounds are computed coarse to fine (2, 4, 8, 16 segments); a pair goes on while
its bound reaches the query's k-th best exact score so far, and only survivors get exact integer scores.

The stated queries meet all rows in blocks: rows and queries are gathered to blocks of fixed size, of which the ranges of the
segment statistics are kept.  A first pass over a bounded sample of rows gives each query a score that its k-th best
reaches.  Pairs of blocks whose bound is below the least such score of the query block are dropped before any vector moves; each
other pair is one unit of work, which returns at most k rows a query.  A query's best scores are merged by a window whose input
is k rows a unit.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids or vectors whose
numbers exceed 2^52; vectors whose length differs from the query's are not compared; ties go to the smaller id; rows with a
query's id are no candidates for it; repeated rows are candidates each; equal queries are one, and queries that share an id but
not a vector share one list, of the best scores of any; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

SCALE = 256
ROWS, QUERIES = 32_768, 2_048
LEVELS = (2, 4, 8, 16)
#: Most rows of the sample that gives the first scores; it goes to every task.
SAMPLE = 4_096
#: Query blocks whose ranges meet row blocks in one task, and shares to which the partners of a query block are dealt.
TOGETHER, SALTS = 256, 16


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, scaled so that their products sum to the bound."""
    cut = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(cut)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / n
    square = np.add.reduceat(x * x, cut[:-1], axis=1) / n
    return mean * np.sqrt(n), np.sqrt(np.maximum(square - mean * mean, 0) * n)


def best(q_ids, q, v_ids, v, k: int, floors=None, levels=LEVELS):
    """The k best (query, id, score) of each query, ties to the smaller id, without those below the query's floor; vectors
    are whole numbers held as float64."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    mine = [statistics(q, s) for s in levels]
    theirs = [statistics(v, s) for s in levels]
    out = []
    size = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    slack = 1e-6 * (1 + size)
    exact = (v, q) if size < 2**52 else (v.astype(np.int64), q.astype(np.int64))
    if floors is not None:  # queries that nothing in the block can reach
        able = np.flatnonzero(_limit(ranges(q), ranges(v), each=True) + slack >= floors)
        q_ids, q, floors, mine = q_ids[able], q[able], floors[able], [(m[able], d[able]) for m, d in mine]
        exact = (v, q) if size < 2**52 else (v.astype(np.int64), q.astype(np.int64))
    for i in range(0, len(q), 64):
        part = slice(i, i + 64)
        bound = mine[0][0][part] @ theirs[0][0].T + mine[0][1][part] @ theirs[0][1].T + slack
        bound[q_ids[part][:, None] == v_ids[None, :]] = -np.inf
        for j, own in enumerate(bound):
            row = i + j
            able = np.flatnonzero(np.isfinite(own))
            if not len(able):
                continue
            probe = able if len(able) <= 4 * k else able[np.argpartition(-own[able], 4 * k)[: 4 * k]]
            scores = exact[0][probe] @ exact[1][row]
            floor = np.sort(scores)[-k] if len(scores) >= k else -np.inf
            floor = floor if floors is None else max(floor, floors[row])
            left = able[own[able] >= floor]
            for s in range(1, len(levels)):
                if len(left) <= 8 * k:
                    break
                finer = theirs[s][0][left] @ mine[s][0][row] + theirs[s][1][left] @ mine[s][1][row] + slack
                left = left[finer >= floor]
            scores = exact[0][left] @ exact[1][row]
            top = np.lexsort((v_ids[left], -scores))[:k]
            out += [(int(q_ids[row]), int(v_ids[left[t]]), int(scores[t])) for t in top]
    return out


def ranges(x: np.ndarray, segments: int = LEVELS[-1]) -> np.ndarray:
    """Vectors x (mean, mean, deviation) x segments: the ranges of each vector by itself."""
    mean, deviation = statistics(x, segments)
    return np.stack([mean, mean, deviation], axis=1)


def _block_range(x: np.ndarray) -> np.ndarray:
    """Least mean, greatest mean and greatest deviation of each segment."""
    own = ranges(x)
    return np.stack([own[:, 0].min(axis=0), own[:, 1].max(axis=0), own[:, 2].max(axis=0)])


def _limit(q: np.ndarray, v: np.ndarray, each: bool = False) -> np.ndarray:
    """Upper bounds of the inner products of members of range q and range v; each: q and v are ranges of single vectors, v's
    taken together."""
    if each:
        v = np.stack([v[:, 0].min(axis=0), v[:, 1].max(axis=0), v[:, 2].max(axis=0)])
    products = np.stack([q[..., a, :] * v[..., b, :] for a in (0, 1) for b in (0, 1)])
    return (products.max(axis=0) + q[..., 2, :] * v[..., 2, :]).sum(axis=-1)


def _numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE)


def _packed(x: np.ndarray) -> bytes:
    """The numbers in the smallest of three widths, which the length tells."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dim)]).reshape(n, dim).astype(np.float64)


def _block(kind: str, number, dim, ids: np.ndarray, x: np.ndarray, floors: np.ndarray | None = None) -> pa.RecordBatch:
    columns = {kind: pa.array([number], pa.int64()), "dim": pa.array([dim], pa.int32()), f"{kind}_ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary())}
    columns |= {f"{kind}_vectors": pa.array([_packed(x)], pa.binary()), f"{kind}_range": pa.array([_block_range(x).tobytes()], pa.binary()), f"{kind}_size": pa.array([float(np.abs(x).max())], pa.float64())}
    if floors is not None:
        columns |= {"q_floors": pa.array([floors.tobytes()], pa.binary()), "q_least": pa.array([float(floors.min())], pa.float64())}
    return pa.RecordBatch.from_pydict(columns)


def _row_blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row a block of about `size` vectors of one dimension.  A partition of the input makes its own blocks, so nothing is
    shuffled to gather them."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}

        def block(dim):
            nonlocal number
            ids, vectors = zip(*held.pop(dim), strict=True)
            number += 1
            return _block("v", number, dim, np.concatenate(ids), np.concatenate(vectors))

        for batch in batches:
            sizes, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "id"))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _numbers(batch.column("x").take(pa.array(at)), dim)
                for a in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[at[a : a + size]].astype(np.int64), x[a : a + size]))
                    if sum(len(i) for i, _ in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "v long, dim int, v_ids binary, v_vectors binary, v_range binary, v_size double")


def _query_blocks(rows: DataFrame, parts: int, sample: list, k: int) -> DataFrame:
    """One row a dimension and each of `parts` shares by hash, with a score for each query that its k-th best reaches."""
    known: dict[int, list] = {}
    for id_, x in sample:
        known.setdefault(len(x), []).append((id_, x))
    tables = {dim: (np.array([i for i, _ in own], np.int64), np.floor(np.array([x for _, x in own]) * SCALE)) for dim, own in known.items()}

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        x, ids = _numbers(table["x"].combine_chunks(), dim), table["id"].to_numpy().astype(np.int64)
        floors = np.full(len(ids), -np.inf)
        if dim in tables and len(tables[dim][0]) > k:
            for a in range(0, len(ids), 256):
                scores = x[a : a + 256] @ tables[dim][1].T
                scores[ids[a : a + 256, None] == tables[dim][0][None, :]] = -np.inf
                floors[a : a + 256] = np.partition(scores, -k, axis=1)[:, -k]
        floors = np.where(np.isfinite(floors), floors - 1e-6 * (1 + np.abs(floors)), -np.inf)
        return pa.Table.from_batches([_block("q", table["q"][0].as_py(), dim, ids, x, floors)])

    return rows.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("q", "dim").applyInArrow(run, "q long, dim int, q_ids binary, q_vectors binary, q_range binary, q_size double, q_floors binary, q_least double")


def _reachable(pairs: DataFrame) -> DataFrame:
    """q, dim, v of the pairs of blocks whose bound is not below the least score that a query of the block has."""

    def run(batches):
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                q, v = (np.frombuffer(row[f"{x}_range"], np.float64).reshape(3, -1) for x in "qv")
                slack = 1e-6 * (1 + row["q_size"] * row["v_size"] * row["dim"])
                keep.append(bool(_limit(q, v) + slack >= row["q_least"]))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["q", "dim", "v"])

    return pairs.select("q", "dim", "v", "q_range", "v_range", "q_size", "v_size", "q_least").mapInArrow(run, "q long, dim int, v long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS, block_queries: int = QUERIES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query by the inner product of the vectors'
    components turned to floor(256 * x)."""

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x")).filter("id is not null and x is not null and size(x) > 0")
        return own.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**52) / SCALE))).withColumn("dim", F.size("x"))

    asked, every = usable(queries).dropDuplicates(["id", "x"]), usable(vectors)
    parts = max(1, -(-asked.count() // block_queries))
    sample = [(r.id, r.x) for r in every.select("id", "x").limit(SAMPLE).collect()]
    q = saved(_query_blocks(asked, parts, sample, k))
    v = saved(_row_blocks(every, rows))
    # first the ranges of blocks meet, without vectors
    groups = -(-parts // TOGETHER)
    heads = q.select("q", "dim", "q_range", "q_size", "q_least", F.pmod("q", F.lit(groups)).alias("g"))
    tails = v.select("v", "dim", "v_range", "v_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    units = saved(_reachable(tails.join(heads, ["g", "dim"])))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = []
                for name in ("q", "v"):
                    ids = np.frombuffer(row[f"{name}_ids"], np.int64)
                    parts += [ids, _unpacked(row[f"{name}_vectors"], len(ids), row["dim"])]
                found = best(*parts, k, np.frombuffer(row["q_floors"], np.float64))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    share = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("share")
    asking = q.select("q", "dim", "q_ids", "q_vectors", "q_floors", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    met = units.select("q", "dim", "v", share).join(asking, ["q", "dim", "share"]).join(v.select("v", "dim", "v_ids", "v_vectors"), ["v", "dim"])
    found = met.select("dim", "q_ids", "q_vectors", "q_floors", "v_ids", "v_vectors").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
