"""Keyed differences of snapshots, and writes that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(old: DataFrame, new: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """id, status (added, changed, removed, unchanged), to_embed, to_delete of two snapshots, null-safe on the value."""
    o = old.select(F.col(key).alias("id"), F.col(value).alias("old"), F.lit(1).alias("has_old"))
    n = new.select(F.col(key).alias("id"), F.col(value).alias("new"), F.lit(1).alias("has_new"))
    status = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    out = o.join(n, "id", "full_outer").select("id", status.alias("status"), "old", "new")
    return out.withColumn("to_embed", F.col("status").isin("added", "changed")).withColumn("to_delete", F.col("status").isin("removed", "changed"))


def fingerprint(symbols: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, n_symbols, hash: the first 16 hex digits of sha256 over the sorted hashes of a group's rows.  Rows are hashed first, so
    what a group gathers is 16 digits a row."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    own = symbols.select(by, F.substring(F.sha2(line, 256), 1, 16).alias("line"))
    return own.groupBy(by).agg(F.count(F.lit(1)).alias("n_symbols"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256), 1, 16).alias("hash"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after new rows overwrite old ones of their key; columns in `keep` stay as they were where the old row has
    them.  The last of equal new keys is not defined, so they must be unique."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("n"))
    both = o.join(n, keys, "full_outer")
    pick = [F.when(F.col("n").isNull() | (F.col(f"o.{c}").isNotNull() if c in keep else F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c not in keys]
    return both.select(*keys, *pick).select(*old.columns)


def delete_where(table: DataFrame, condition: str) -> DataFrame:
    """The table without the rows that meet the condition; an empty condition is an error."""
    if not condition or not condition.strip():
        raise ValueError("delete_where needs a condition")
    return table.filter(f"not coalesce({condition}, false)")


def fork(table: DataFrame, project: str, name: str) -> DataFrame:
    """The rows of a project under another project's id."""
    return table.filter(F.col("project_id") == project).withColumn("project_id", F.lit(name))


def newest(table: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The newest n rows: a partial top n in each task, merged once."""
    return table.orderBy(F.desc(order), F.desc(tie)).limit(n)
