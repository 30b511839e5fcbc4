"""Change logs: co-change, latest touches, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

#: Items of a key in a block.
BLOCK = 512


def co_occurrence(log: DataFrame, key: str, item: str = "function_id", least: int = 3, ordered: bool = True) -> DataFrame:
    """a, b, n: items that share at least `least` keys, both orders.  Pairs are made once (a < b) and counted before the other
    order is added, which halves the rows between the join and the aggregate.  The items of a key are dealt to blocks that
    meet two by two, so that a key with very many items is many tasks' work."""
    own = log.select(F.col(key).alias("k"), F.col(item).alias("a")).distinct()
    sizes = own.groupBy("k").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("parts"))
    dealt = own.join(sizes, "k").withColumn("part", F.expr("cast(pmod(xxhash64(a), parts) as int)"))
    left = dealt.select("k", "a", F.col("part").alias("low"), F.explode(F.expr("sequence(part, parts - 1)")).alias("high"))
    right = dealt.select("k", F.col("a").alias("b"), F.col("part").alias("high"), F.explode(F.expr("sequence(0, part)")).alias("low"))
    met = left.join(right, ["k", "low", "high"]).filter("low < high or a < b")
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")) if ordered else pairs


def merge_evidence(first: DataFrame, second: DataFrame) -> DataFrame:
    """a, b, n, source: the union of two co-occurrence tables; the first wins where both have a pair."""
    f = first.select("a", "b", F.col("n").alias("n1"))
    s = second.select("a", "b", F.col("n").alias("n2"))
    both = f.join(s, ["a", "b"], "full_outer")
    return both.select("a", "b", F.coalesce("n1", "n2").alias("n"), F.when(F.col("n1").isNotNull(), "git").otherwise("decision").alias("source"))


def latest(log: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row a key, ties to the greater `tie`.  max_by combines on the map side, so a hot key moves a row a task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it has not; of equal new keys one stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def branch_conflicts(touches: DataFrame, current: str, trunk: tuple[str, ...] = ("main", "master")) -> DataFrame:
    """function_id, branches (sorted, joined), n_branches, drift: other branches that touch what the current one touches."""
    mine = touches.filter(F.col("branch") == current).select("function_id").distinct()
    others = touches.filter(F.col("branch") != current).join(mine, "function_id", "left_semi")
    return others.groupBy("function_id").agg(F.array_join(F.sort_array(F.collect_set("branch")), ",").alias("branches"), F.count_distinct("branch").alias("n_branches"), F.bool_or(F.col("branch").isin(*trunk)).alias("drift"))


def commit_summary(log: DataFrame) -> DataFrame:
    """rows, commits, functions of a change log."""
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("commit_hash").alias("n_commits"), F.count_distinct("function_id").alias("n_functions"))


def match_paths(files: DataFrame, paths: DataFrame, longest: int = 3) -> DataFrame:
    """path, file, n: the file that shares the longest suffix of at most `longest` components with a path, ties to the lesser
    name.  Both sides explode their suffixes, so it is an equi-join."""

    def keys(df: DataFrame, c: str) -> DataFrame:
        parts = F.split(F.regexp_replace(c, "^/+", ""), "/")
        ns = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts)))
        return df.select(c, F.explode(F.transform(ns, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("key")))).alias("k")).select(c, "k.n", "k.key")

    both = keys(paths.select("path").distinct(), "path").join(keys(files.select("file").distinct(), "file"), ["n", "key"])
    return both.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("m"), "file")).alias("b")).select("path", F.col("b.file").alias("file"), (-F.col("b.m")).alias("n"))


def classify_commits(log: DataFrame, subject: str = "subject") -> DataFrame:
    return log.withColumn("type", names.decision_type(subject))


def top_commits(log: DataFrame, n: int = 5) -> DataFrame:
    """commit_hash, n_functions: the commits that touch most functions, ties to the lesser commit."""
    by = log.groupBy("commit_hash").agg(F.count_distinct("function_id").alias("n_functions"))
    return by.orderBy(F.desc("n_functions"), "commit_hash").limit(n)
