"""Incremental index: micro-batches of changed files rewrite the rows of those files.

A batch is (path, content), null content for a deleted file.  The tables lie in buckets by file; a batch writes the buckets of
its files as a new version, and then a manifest that says which version of each bucket counts.  The newest manifest is the state,
so a failure before it leaves the old state whole, and a new process goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs, graph
from ..sources import python_source as P

BUCKETS = 64


def apply_changes(nodes: DataFrame, edges: DataFrame, files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and delta (id, status, to_embed, to_delete) after the files' new contents: rows of touched files are
    replaced, summaries stay where the body has not changed.  A file that cannot be parsed keeps its old rows."""
    parsed = P.parse_sources(files, root)
    new, calls = P.split_rows(parsed)
    touched = files.select(F.col("path").alias("file")).distinct().join(P.failed_files(parsed), "file", "left_anti")
    old = nodes.join(touched, "file", "left_semi")
    delta = diffs.reconcile(old, new, "id", "body_hash")
    summaries = old.select("id", F.col("body_hash").alias("old_hash"), "summary")
    rewritten = new.join(summaries, "id", "left").withColumn("summary", F.when(F.col("body_hash") == F.col("old_hash"), F.col("summary"))).select(*nodes.columns)
    kept = nodes.join(touched, "file", "left_anti").select(*nodes.columns)
    return kept.unionByName(rewritten), edges.join(touched, "file", "left_anti").select(*edges.columns).unionByName(calls.select(*edges.columns)), delta


def full_index(files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (without summaries), edges with callees resolved, and the files that could not be parsed, of a whole project."""
    parsed = P.parse_sources(files, root)
    nodes, calls = P.split_rows(parsed)
    return nodes.withColumn("summary", F.lit(None).cast("string")), graph.resolve_callees(calls, nodes), P.failed_files(parsed)


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class Store:
    """Versions of the buckets of nodes and edges in a shared folder; the newest complete manifest names those that count."""

    TABLES = ("nodes", "edges")

    def __init__(self, spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame):
        self.spark, self.path, self.schemas = spark, path, {"nodes": nodes.schema, "edges": edges.schema}

    @property
    def version(self) -> int:
        """The number of the newest manifest that was written whole, 0 without one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        whole = [int(n) for n in names if n.isdigit() and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/manifest/_SUCCESS"))]
        return max(whole, default=0)

    def _manifest(self) -> list:
        """table, bucket, version (at most two rows a bucket), and the batch that wrote it."""
        return self.spark.read.parquet(f"{self.path}/{v}/manifest").collect() if (v := self.version) else []

    def read(self, buckets: list[int] | None = None) -> tuple[DataFrame, ...]:
        """nodes, edges, of some buckets if asked."""
        rows, out = self._manifest(), []
        for name in self.TABLES:
            paths = [f"{self.path}/{r.version}/{name}/bucket={r.bucket}" for r in rows if r.table == name and (buckets is None or r.bucket in buckets)]
            out.append(self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name]))
        return tuple(out)

    def write(self, nodes: DataFrame, edges: DataFrame, buckets: list[int], batch: str) -> None:
        """The new rows of the given buckets; others stay as they are."""
        before, version = self._manifest(), self.version + 1
        rows = [(r.table, r.bucket, r.version, batch) for r in before if r.bucket not in buckets]
        for name, table in zip(self.TABLES, (nodes, edges), strict=True):
            at = f"{self.path}/{version}/{name}"
            table.withColumn("bucket", _bucket("file")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            names = [s.getPath().getName() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
            rows += [(name, int(n[7:]), version, batch) for n in names if n.startswith("bucket=")]
        rows.append(("", -1, version, batch))
        self.spark.createDataFrame(rows, "table string, bucket int, version int, batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{version}/manifest")

    @property
    def batch(self) -> str | None:
        """The batch that wrote the state."""
        return next((r.batch for r in self._manifest()), None)


def run_stream(changes: DataFrame, store: Store, checkpoint: str, root: str = "", order: str | None = None):
    """A streaming query over (path, content) rows that keeps the store current.  Of several rows of a path in a batch the last by
    `order` counts, a deletion too; without an order the one with content that sorts last.  A batch that was written before the
    query stopped is not applied again."""

    def batch(df: DataFrame, number: int) -> None:
        mark = f"{checkpoint}#{number}"
        if store.batch == mark:
            return
        newest = F.max_by(F.struct("content"), order)["content"] if order else F.max("content")
        files = df.groupBy("path").agg(newest.alias("content"))
        buckets = [r[0] for r in files.select(_bucket("path")).distinct().collect()]  # at most BUCKETS
        if buckets:
            nodes, edges, _delta = apply_changes(*store.read(buckets), files, root)
            store.write(nodes, edges, buckets, mark)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
