"""MinHash near-dedup: a signature-coordinate inverted join with prefix and skip merging.

1. Each document becomes the set of its distinct five-word shingles, a digest of that set and a signature of `COORDINATES`
   least hashes.  Documents with equal sets are one class from here on.
2. A class is posted under each (coordinate, value) pair.  Pairs that one class holds cannot collide and go.  A class's
   pairs are ordered by the number of classes that hold them; two classes that agree in `MATCHES` coordinates share one of
   the first r - MATCHES + 1 of r, so only that prefix is posted: the long lists are skipped, and collisions are counted on
   the signatures.
3. Every list links its least class with the others.  Pairs with at least `MATCHES` collisions are confirmed on full sets.
4. Classes of lists that still hold several components meet in blocks of bounded size, with their texts: those of different
   components that collide often enough are confirmed on the spot, so that no link that joins components is lost and no
   pair leaves a task unless it is such a link.  Lists that share members meet as one where that makes no more than a block or
   no more pairs than list by list would (equal lists once).  Of the components of a list the largest is dealt out once, and
   the others go to each of its parts.
5. Components of the confirmed links name the smallest id that each document reaches.

At a similarity of 0.75 fewer than 28 of 64 coordinates agree with a probability of 2.5e-8.  Lists of any length are
handled: a class's leader pairs are split in chunks, and blocks of a long list meet pair by pair.  Nothing is collected; the
steps' tables are written to the shared folder.

Cases: no words or no text: an empty set, linked with nothing; fewer than five words: the whole sequence is one shingle;
rows that share an id are one node, which reaches what any of them reaches; rows without an id are kept and linked with
nothing; equal texts are linked; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import saved
from . import _text as T
from .components import SALTS, components

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 64, 28
#: Most members of a confirming chunk, of a block of a list, and rows of a comparing task.
CHUNK, BLOCK, TASK_ROWS = 128, 256, 1_000
_SEEDS = np.random.default_rng(5).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words lower-cased (A-Z)."""
    bounds, codes, vocabulary = T.words(T.lower(texts))
    x = T.hashes(vocabulary)[codes]
    h = T.window_hashes(x, size) if len(x) >= size else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            s = np.sort(h[a : b - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:  # the number of words goes in, so that it is no shingle of another length
            out.append(T.pair(T.window_hashes(x[a:b], int(b - a)), np.array([b - a], np.uint64)) if b > a else np.empty(0, np.uint64))
    return out


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    same = int(T.among(s, t).sum())
    return 100 * same >= PERCENT * (len(s) + len(t) - same)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """texts x COORDINATES of 32 bits; sets are not empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat ^ _SEEDS[0, k]) * _SEEDS[1, k], starts) >> np.uint64(32)
    return out


def sign(own: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and signature of each row; the last two are null for an empty set."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = shingle_sets(T.column(part, "text"))
                some = [i for i, s in enumerate(sets) if len(s)]
                signed: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, signatures([sets[i] for i in some]).view(np.int32), strict=True):
                        signed[i] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(signed, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "signature"]
                )

    return own.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<int>")


def _prefixes(classes: DataFrame) -> DataFrame:
    """token, node: the postings that are left by prefix and skip merging."""
    tokens = classes.select("node", F.posexplode("signature").alias("at", "value")).select("node", F.expr("shiftleft(cast(at as bigint), 32) | (cast(value as bigint) & 4294967295)").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held")).filter(F.size("held") >= MATCHES)
    return held.select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - MATCHES + 1)).alias("p")).select(F.col("p.token").alias("token"), "node")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures collide often enough and whose set sizes allow the similarity."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    collisions = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return both.filter(F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")).filter(collisions >= MATCHES).select("a", "b")


def _confirm(pairs: DataFrame, own: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar enough.  The members b of an a are dealt to chunks; each chunk gets the
    texts of its members and of a."""
    shared = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SALTS)))  # no task counts all members of an a
    shares = shared.groupBy("a", "share").agg(F.count(F.lit(1)).alias("n"))
    many = shares.select("a", "share").join(shares.groupBy("a").agg(F.sum("n").alias("n")), "a")
    dealt = shared.join(many, ["a", "share"]).select("a", "b", F.expr(f"cast(pmod(xxhash64(b), ceil(n / {CHUNK})) as int)").alias("chunk"))
    wanted = dealt.select("a", "chunk", F.col("b").alias("doc_id")).unionByName(dealt.select("a", "chunk", F.col("a").alias("doc_id")).distinct())
    known = classes.select(F.col("node").alias("doc_id"), "digest")
    rows = wanted.join(known, "doc_id").join(own, "doc_id").select("a", "chunk", "doc_id", "digest", "text")

    def run(table: pa.Table) -> pa.Table:
        ids, digests = table["doc_id"].to_numpy(), table["digest"].to_pylist()
        held: dict[int, dict] = {}  # several texts may share an id
        for i, d, s in zip(ids.tolist(), digests, shingle_sets(T.column(table, "text")), strict=True):
            if len(s) and _digest(s) == d:
                held.setdefault(i, {})[d] = s
        a = table["a"][0].as_py()
        found = [b for b, sets in held.items() if b != a and any(similar(s, t) for s in sets.values() for t in held.get(a, {}).values())]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("a", "chunk").applyInArrow(run, "a long, b long")


def _joining(blocks: DataFrame) -> DataFrame:
    """blocks: task, list, side, node, label, digest, n_shingles, signature, text.  Confirmed links a, b between the nodes of
    each list of a task, of sides 0 and 1 or both 2, that join labels which the task has not joined yet."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("list", "ascending"), ("node", "ascending")]))
        name, side, node, label, n = (table[c].to_numpy() for c in ("list", "side", "node", "label", "n_shingles"))
        signed = table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        sets = shingle_sets(T.column(table, "text"))
        for k, d in enumerate(table["digest"].to_pylist()):
            sets[k] = sets[k] if len(sets[k]) and _digest(sets[k]) == d else None  # the text of another row of that id
        cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
        found = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = label[lo:hi].copy()
            for i in range(lo, hi):
                if sets[i] is None:
                    continue
                j = np.arange(i + 1, hi)
                j = j[(own[j - lo] != own[i - lo]) & (100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i])) & ((side[j] != side[i]) | (side[j] == 2))]
                for k in j[(signed[j] == signed[i]).sum(axis=1) >= MATCHES].tolist():
                    if own[k - lo] != own[i - lo] and sets[k] is not None and similar(sets[i], sets[k]):
                        found.append((int(node[i]), int(node[k])))
                        own[own == own[k - lo]] = own[i - lo]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("task").applyInArrow(run, "a long, b long")


def _rest(postings: DataFrame, labels: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that join components, from the lists that still have several.  What meets goes along with its texts; only links
    come out."""
    named = postings.join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")
    )
    mixed = mixed.filter("low < high and n > 2").select("token", "leader", F.xxhash64("n", "x", "y").alias("unit"))
    rows = saved(named.join(mixed, "token").select("node", "label", "leader", "unit").distinct())  # equal lists are one from here
    clusters = saved(components(rows, "leader", "node").withColumnRenamed("component", "cluster"))
    placed = saved(rows.join(clusters, "node").select("node", "label", "unit", "cluster"))
    units = placed.groupBy("cluster", "unit").agg(F.count(F.lit(1)).alias("n"))
    costs = units.groupBy("cluster").agg(F.sum(F.expr("cast(n as double) * n")).alias("cost")).join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    meeting = units.join(costs, "cluster").select("unit", F.expr(f"case when size <= {BLOCK} or cast(size as double) * size <= cost then xxhash64('cluster', cluster) else unit end").alias("meeting"))
    members = placed.join(meeting, "unit").select("node", "label", F.col("meeting").alias("unit")).distinct()
    shares = members.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = shares.groupBy("unit").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("n_largest"), F.sum("n").alias("n"))
    dealt = members.join(sizes, "unit").selectExpr(
        "node", "label", "unit", "label = largest as first", f"cast(ceil(n_largest / {BLOCK}) as int) as parts", f"cast(ceil((n - n_largest) / {BLOCK}) as int) as others", "xxhash64(node) as h"
    )
    first = "array(named_struct('kind', 0, 'a', cast(pmod(h, parts) as int), 'b', 0, 'side', 0))"
    meets = "transform(sequence(0, parts - 1), p -> named_struct('kind', 0, 'a', p, 'b', 0, 'side', 1))"
    own = "cast(pmod(h, others) as int)"
    among = f"transform(sequence(0, others - 1), p -> named_struct('kind', 1, 'a', least({own}, p), 'b', greatest({own}, p), 'side', case when {own} = p then 2 when {own} < p then 0 else 1 end))"
    members = dealt.select("node", "label", "unit", F.explode(F.expr(f"case when first then {first} else concat({meets}, {among}) end")).alias("p"))
    members = saved(members.select("node", "label", F.xxhash64("unit", "p.kind", "p.a", "p.b").alias("list"), "p.side"))
    tasks = max(1, -(-members.count() // TASK_ROWS))
    blocks = members.join(classes, "node").join(texts, "node").withColumn("task", F.pmod("list", F.lit(tasks)))
    return _joining(blocks)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more links."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    every = saved(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))))
    named = lambda x: every.select(F.col("node").alias(x), F.col("component").alias(f"l_{x}"))
    bridges = links.join(named("a"), "a").join(named("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))
    joined = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return saved(every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = saved(sign(own))
    classes = saved(signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature"), "doc_id").alias("c")).select("digest", F.col("c.doc_id").alias("node"), "c.n_shingles", "c.signature"))
    postings = saved(_prefixes(classes))
    leaders = postings.groupBy("token").agg(F.min("node").alias("a"))
    stars = postings.join(leaders, "token").filter("a < node").select("a", F.col("node").alias("b")).distinct()
    first = _confirm(saved(_agreeing(stars, classes)), own, classes)
    labels = saved(components(saved(first.unionByName(_same_id(signed, classes)))))
    labels = _merged(labels, saved(_rest(postings, labels, own.withColumnRenamed("doc_id", "node"), classes)))
    ends = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.filter("digest is not null").join(ends, "digest", "left").select("doc_id", "n_shingles", "component")
    empty = signed.filter("digest is null").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.unionByName(empty).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links a, b between each id whose rows have different sets and the classes of those sets."""
    digest = F.coalesce("digest", F.lit(b""))
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("doc_id")
    return signed.join(several, "doc_id").join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive w as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select distinct rid, array_to_string(list_slice(ws, i, i + 4), ' ') as sh from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all
  select rid, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
), n as (
  select rid, count(*) as n from s group by rid
), k as (
  select sh from s group by sh having count(*) > 1
), p as (
  select a.rid as a, b.rid as b, count(*) as c from s a join k using (sh) join s b using (sh) where a.rid < b.rid group by all
), l as (
  select distinct v.doc_id as a, z.doc_id as b
  from p join n x on x.rid = a join n y on y.rid = b join w v on v.rid = a join w z on z.rid = b
  where 100 * c >= 75 * (x.n + y.n - c) and v.doc_id <> z.doc_id
), e as (
  select a, b from l union all select b, a from l
), r(node, low) as (
  select a, b from e
  union
  select r.node, e.b from r join e on e.a = r.low
), m as (
  select node, min(low) as low from r group by node
)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(least(w.doc_id, coalesce(m.low, w.doc_id)) as bigint) as component_id,
  w.doc_id is not distinct from least(w.doc_id, coalesce(m.low, w.doc_id)) as kept
from w left join n on n.rid = w.rid left join m on m.node = w.doc_id
"""
