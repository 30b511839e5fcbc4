"""Graph operators over nodes and edges.  Each answers for all keys at once."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..tables import saved


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """callee_id, caller_id, caller_name, module, is_external: each caller once a callee."""
    pairs = edges.select("callee_id", "caller_id").distinct()
    return pairs.join(nodes.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), "module", "is_external"), "caller_id").select("callee_id", "caller_id", "caller_name", "module", "is_external")


def callees(nodes: DataFrame, edges: DataFrame, include_external: bool = False) -> DataFrame:
    """caller_id, callee_id, callee_name: each callee once a caller; external ones if asked."""
    own = nodes if include_external else nodes.filter("is_external = 0")
    pairs = edges.select("caller_id", "callee_id").distinct()
    return pairs.join(own.select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name")), "callee_id").select("caller_id", "callee_id", "callee_name")


def caller_counts(edges: DataFrame) -> DataFrame:
    """callee_id, callers (distinct), call_sites."""
    return edges.groupBy("callee_id").agg(F.count_distinct("caller_id").alias("callers"), F.count(F.lit(1)).alias("call_sites"))


def chokepoints(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n internal nodes with most distinct callers, ties to the lesser id."""
    own = caller_counts(edges).join(nodes.filter("is_external = 0").select("id", "name", "module"), F.col("callee_id") == F.col("id"))
    return own.orderBy(F.desc("callers"), "id").limit(n).select("id", "name", "module", "callers")


def resolve_names(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: query.  query, id, match (0 exact id or name, 1 dotted suffix); a node once a query, by its best match."""
    keys = nodes.select("id", F.explode(F.array_distinct(F.concat(F.array(F.struct(F.col("id").alias("key"), F.lit(0).alias("match")), F.struct(F.col("name").alias("key"), F.lit(0).alias("match"))), F.transform(names.suffixes("id"), lambda s: F.struct(s.alias("key"), F.lit(1).alias("match")))))).alias("k"))
    return wanted.join(keys.select("id", "k.key", "k.match"), F.col("query") == F.col("key")).groupBy("query", "id").agg(F.min("match").alias("match"))


def resolve_callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with callee_id resolved: an exact id, else the one node that ends in .callee, else the bare name.  Suffixes are
    exploded, so both look-ups are equi-joins."""
    exact = nodes.select(F.col("id").alias("exact")).distinct()
    unique = nodes.select("id", F.explode(names.suffixes("id")).alias("suffix")).groupBy("suffix").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")).filter("n = 1").select("suffix", "only")
    return (
        edges.withColumnRenamed("callee_id", "bare").join(exact, F.col("bare") == F.col("exact"), "left").join(unique, F.col("bare") == F.col("suffix"), "left")
        .withColumn("callee_id", F.coalesce("exact", "only", "bare")).drop("exact", "only", "suffix", "bare")
    )


def impact_radius(edges: DataFrame, targets: DataFrame, depth: int = 2, nodes: DataFrame | None = None, forward: bool = False) -> DataFrame:
    """target, id, depth: all that reach a target (or are reached from it, forward) in at most `depth` steps, at their least
    depth; the target itself at 0.  Ids that are no nodes are gone through but not returned.  One join a level, whatever
    the number of nodes; distances only grow, so cycles end.  What a level reaches is saved, so no level is computed twice."""
    step = edges.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst")) if not forward else edges.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    step = saved(step.distinct())
    frontier = targets.select("target", F.col("target").alias("id")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        frontier = frontier.join(step, frontier["id"] == step["src"]).select("target", F.col("dst").alias("id")).distinct().join(seen.select("target", "id"), ["target", "id"], "left_anti")
        frontier = saved(frontier) if k < depth else frontier
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(k)))
    return seen.join(nodes.select("id").distinct(), "id", "left_semi").select("target", "id", "depth") if nodes is not None else seen


#: Most edges that a task holds at once (4 bytes each); a node takes as much as 8 and a quarter of the bytes of its id.
EDGES = 80_000_000

#: Most rows of a batch that a task gives back.
BATCH = 65_536


def reach(nodes: DataFrame, edges: DataFrame, depth: int, most: int = EDGES) -> DataFrame:
    """target, id, depth: every node that reaches each node in at most `depth` steps, at its least depth; the node itself at 0.
    nodes: k, id from numbered(); edges: caller_id, callee_id as numbers.  target and id are ids.

    The pairs can be the square of the nodes, so none is shuffled or saved on the way: each of a few tasks gets the name and the
    callers of every node, searches from its share of the nodes, one after another, and gives back what it finds.  A graph of more
    than `most` edges does not fit a task; its pairs are made level by level, which is exact but takes disk for each pair."""
    edges = saved(edges.select("caller_id", "callee_id").distinct())
    n, text, size = _sizes(nodes, edges)
    if size + 8 * n + text // 4 > most:
        found = impact_radius(edges, nodes.select(F.col("k").alias("target")), depth)
        for c in ("target", "id"):
            found = found.withColumnRenamed(c, "k").join(nodes.select("k", F.col("id").alias(c)), "k").drop("k")
        return found.select("target", "id", "depth")

    def pairs(names, levels):
        runs, fronts, rows = [], [], 0
        for target, k, front in levels:
            runs.append((target, k, len(front)))
            fronts.append(front)
            rows += len(front)
            if rows >= BATCH:
                yield from _batches(names, runs, fronts)
                runs, fronts, rows = [], [], 0
        yield from _batches(names, runs, fronts)

    return _searched(nodes, edges, (n, text, size), depth, pairs, "target string, id string, depth int")


def _batches(names: pa.Array, runs: list[tuple[int, int, int]], fronts: list[np.ndarray]):
    """target, id, depth of the nodes in fronts, whose target, depth and length are in runs."""
    if runs:
        (target, k, size), ids = np.array(runs, np.int64).T, np.concatenate(fronts)
        target, k = np.repeat(target, size), np.repeat(k.astype(np.int32), size)
        for at in range(0, len(ids), BATCH):
            own = slice(at, at + BATCH)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(target[own])).cast(pa.string()), names.take(pa.array(ids[own])).cast(pa.string()), pa.array(k[own])], ["target", "id", "depth"])


def reach_counts(nodes: DataFrame, edges: DataFrame, depth: int, most: int = EDGES) -> DataFrame:
    """target, depth, n: how many rows reach() has for each target and depth; counted where they are found."""
    edges = saved(edges.select("caller_id", "callee_id").distinct())
    n, text, size = _sizes(nodes, edges)
    if size + 8 * n + text // 4 > most:
        found = impact_radius(edges, nodes.select(F.col("k").alias("target")), depth).groupBy(F.col("target").alias("k"), "depth").agg(F.count(F.lit(1)).alias("n"))
        return found.join(nodes.select("k", F.col("id").alias("target")), "k").select("target", "depth", "n")

    def counts(names, levels):
        own = ((target, k, len(front)) for target, k, front in levels)
        while some := list(itertools.islice(own, BATCH)):
            target, k, found = np.array(some, np.int64).T
            yield pa.RecordBatch.from_arrays([names.take(pa.array(target)).cast(pa.string()), pa.array(k.astype(np.int32)), pa.array(found)], ["target", "depth", "n"])

    return _searched(nodes, edges, (n, text, size), depth, counts, "target string, depth int, n long")


def _sizes(nodes: DataFrame, edges: DataFrame) -> tuple[int, int, int]:
    """Nodes, bytes of their ids, edges."""
    n, text = nodes.agg(F.count(F.lit(1)), F.sum(F.octet_length("id"))).first()
    return n, text or 0, edges.count()


def _searched(nodes: DataFrame, edges: DataFrame, sizes: tuple[int, int, int], depth: int, answer, schema: str) -> DataFrame:
    """What answer(names, levels) makes of each task's share of the nodes; levels as from _levels(), with places in names for
    numbers.  edges are distinct; sizes as from _sizes()."""
    n, text, size = sizes
    tasks = max(1, min(nodes.sparkSession.sparkContext.defaultParallelism, n // 256))
    lists = edges.groupBy(F.col("callee_id").alias("k")).agg(F.collect_list("caller_id").alias("callers")).select("k", F.lit(None).cast("string").alias("id"), "callers")
    rows = lists.unionByName(nodes.select("k", "id", F.lit(None).cast("array<int>").alias("callers"))).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "k", "id", "callers")

    def run(batches):
        task, at, starts, counts, callers = None, 0, np.zeros(n, np.int64), np.zeros(n, np.int32), np.empty(size, np.int32)
        known, place, ends, names = 0, np.empty(n, np.int32), np.zeros(n + 1, np.int64), np.empty(text, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            task, k, listed = batch.column("task")[0].as_py(), batch.column("k").to_numpy(zero_copy_only=False), batch.column("callers").is_valid()
            lists = batch.column("callers").filter(listed)
            flat, own = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            listed = listed.to_numpy(zero_copy_only=False)
            callers[at : at + len(flat)], starts[k[listed]], counts[k[listed]] = flat, at + np.cumsum(own) - own, own
            at += len(flat)
            ids = batch.column("id").filter(pa.array(~listed))
            if len(ids):
                stops = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
                place[k[~listed]] = np.arange(known, known + len(ids))
                ends[known + 1 : known + len(ids) + 1] = ends[known] + stops[1:] - stops[0]
                if stops[-1] > stops[0]:
                    names[ends[known] : ends[known + len(ids)]] = np.frombuffer(ids.buffers()[2], np.uint8)[stops[0] : stops[-1]]
                known += len(ids)
        if task is not None:
            names = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(names)])
            levels = _levels(starts, counts, callers, range(task * n // tasks, (task + 1) * n // tasks), depth)
            yield from answer(names, ((place[target], k, place[front]) for target, k, front in levels))

    return rows.repartitionById(tasks, "task").mapInArrow(run, schema)


def _levels(starts: np.ndarray, sizes: np.ndarray, callers: np.ndarray, targets: range, depth: int):
    """Each target, depth and the nodes first reached there: a breadth-first search, a level at a time.  starts, sizes: of each
    node's callers."""
    last, place = np.full(len(starts), -1, np.int32), np.empty(len(starts), np.int32)
    for target in targets:
        last[target], front = target, np.array([target], np.int32)
        yield target, 0, front
        for k in range(1, depth + 1):
            size = sizes[front]
            total = int(size.sum())
            new = callers[np.repeat(starts[front] - (np.cumsum(size) - size), size) + np.arange(total)]
            new = new[last[new] != target]
            if not len(new):
                break
            last[new] = target
            order = np.arange(len(new), dtype=np.int32)
            place[new] = order  # of equal nodes one stays
            front = new[place[new] == order]
            yield target, k, front


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes and k: an int for each row, from 0 without a gap; saved, so a number stays.  Steps over ints move a tenth of what
    steps over names do."""
    own = saved(nodes.withColumn("k", F.monotonically_increasing_id()))
    sizes = sorted(own.groupBy(F.shiftright("k", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    if sum(n for _, n in sizes) >= 2**31:
        raise ValueError("more nodes than ints")
    before = [0] * (sizes[-1].part + 1 if sizes else 1)
    for (part, n), (following, _) in zip(sizes, sizes[1:], strict=False):
        before[following] = before[part] + n
    first = F.element_at(F.from_json(F.lit(str(before)), "array<bigint>"), (F.shiftright("k", 33) + 1).cast("int"))
    return own.withColumn("k", (F.col("k").bitwiseAND((1 << 33) - 1) + first).cast("int"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal nodes that nothing calls and that call nothing."""
    return nodes.filter("is_external = 0").join(edges.select(F.col("caller_id").alias("id")), "id", "left_anti").join(edges.select(F.col("callee_id").alias("id")), "id", "left_anti")


def missing_docstring(nodes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Internal nodes other than classes without a docstring, but for names whose last segment is excluded."""
    own = nodes.filter("type <> 'class' and is_external = 0 and (docstring is null or docstring = '')")
    return own.filter(~F.lower(names.last_segment("name")).isin([x.lower() for x in exclude])) if exclude else own
