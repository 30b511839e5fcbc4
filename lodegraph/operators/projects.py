"""Projects as partitions of tables: registration, forks, renames, retirement.

Every operator takes tables and gives the tables after it; all of a project's rows have its id in `project_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diffs
from .bounds import small

# What a fork does not copy, how many characters a folder's name may have.
NOT_FORKED, NAME_LENGTH = ("decisions", "decision_functions", "decision_embeddings", "contracts", "contract_examples", "contract_violations"), 63


def upsert_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """projects after new rows: created_at stays, counts change only if a row has both."""
    both = F.col("node_count").isNotNull() & F.col("edge_count").isNotNull()
    own = new.withColumns({c: F.when(both, F.col(c)) for c in ("node_count", "edge_count")})
    out = diffs.upsert(projects, own, ["id"], keep=("created_at",))
    old = projects.select("id", F.col("node_count").alias("n0"), F.col("edge_count").alias("e0"))
    return out.join(old, "id", "left").withColumns({"node_count": F.coalesce("node_count", "n0"), "edge_count": F.coalesce("edge_count", "e0")}).select(*projects.columns)


def delete_project(tables: dict[str, DataFrame], contracts: DataFrame, project: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables and contracts (project_ids) without a project, and a row a table of what it had: table, n."""
    counts = None
    for name, table in sorted(tables.items()):
        own = table.filter(F.col("project_id") == project).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        counts = own if counts is None else counts.unionByName(own)
    kept = {name: table.filter(~F.col("project_id").eqNullSafe(project)) for name, table in tables.items()}
    return kept, contracts.withColumn("project_ids", F.array_remove("project_ids", project)), counts


def rename_project(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumn("project_id", F.when(F.col("project_id") == old, F.lit(new)).otherwise(F.col("project_id")))


def fork_tables(tables: dict[str, DataFrame], project: str, fork: str) -> dict[str, DataFrame]:
    """Each table with the project's rows once more under the fork's id; decisions and contracts are not forked.  A fork that has
    rows already is left as it is."""
    out = {}
    for name, table in tables.items():
        if name in NOT_FORKED:
            out[name] = table
            continue
        there = table.filter(F.col("project_id") == fork).select("project_id").limit(1)
        out[name] = table.unionByName(diffs.fork(table, project, fork).join(there, "project_id", "left_anti").select(*table.columns))
    return out


def fork_name(project: str, commit: str) -> str:
    return f"{project}_fork_{commit[:7]}"


def fork_delta(nodes: DataFrame, parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fork's nodes after files (file) were parsed again, and id, status (updated, deleted, unchanged): new hashes overwrite, nodes of
    those files that are parsed no more go, other files' stay."""
    touched = nodes.join(files.select("file").distinct(), "file", "left_semi")
    plan = diffs.reconcile(touched, parsed, "id", "body_hash")
    status = plan.select("id", F.when(F.col("status") == "removed", "deleted").when(F.col("status") == "unchanged", "unchanged").otherwise("updated").alias("status"))
    left = nodes.join(status.filter("status = 'deleted'"), "id", "left_anti").select(*nodes.columns)
    return diffs.upsert(left, parsed.join(status.filter("status = 'updated'"), "id", "left_semi").select(*nodes.columns), ["id"]), status


def folder_name(name) -> Column:
    """A project's folder: lower case, other than letters and digits as _, p before a digit, 63 characters at most."""
    c = F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), "[^a-z0-9]", "_")
    return F.substring(F.when(c.rlike("^[0-9]"), F.concat(F.lit("p"), c)).otherwise(c), 1, NAME_LENGTH)


def by_project(table: DataFrame, path: str) -> None:
    """Writes a table with a folder a project, so that one can be replaced or dropped by itself."""
    table.repartition("project_id").write.mode("overwrite").partitionBy("project_id").parquet(path)


def common_columns(table: DataFrame, target: list[str]) -> DataFrame:
    """The columns of a copied table that its target has too, in the target's order."""
    return table.select(*[c for c in target if c in table.columns])


def user_projects(projects: DataFrame, grants: DataFrame, demos: DataFrame) -> DataFrame:
    """user_id, id, role: the projects of each user's grants, and every demo for every user as a demo; both are listed."""
    own = grants.join(projects.select(F.col("id").alias("project_id")), "project_id").select("user_id", F.col("project_id").alias("id"), "role")
    shown = grants.select("user_id").distinct().crossJoin(small(demos.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("project_id").distinct()))
    return own.unionByName(shown.select("user_id", F.col("project_id").alias("id"), F.lit("demo").alias("role")))


def key_owners(keys: DataFrame, users: DataFrame, members: DataFrame) -> DataFrame:
    """key_id, user_id, email, org_id: keys with their users, and the organisations that these belong to, if any."""
    return keys.join(users, "user_id").join(members.select("user_id", "org_id"), "user_id", "left").select("key_id", "user_id", "email", "org_id")
