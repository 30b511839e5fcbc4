"""Decisions, contracts and their violations as tables: what writes do to them, and what is asked of them.

Each write takes the table as it is and gives the table as it is after; saving it is the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import diffs, rules
from .bounds import small

# Fixed value: vectors that are fetched before a project's are picked would miss some, so the project comes first here.
SNIPPET_BODY = 600


def insert_decisions(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """decisions after new ones: of those that are there only type, description and rejected_alternatives change."""
    rest = tuple(c for c in decisions.columns if c not in ("decision_id", "type", "description", "rejected_alternatives"))
    return diffs.upsert(decisions, new, ["decision_id"], keep=rest)


def decision_history(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """function_id, decision_id, description, created_at, position: a function's decisions in time, each once."""
    own = links.select("decision_id", "function_id").distinct().join(decisions, "decision_id")
    w = Window.partitionBy("function_id").orderBy("created_at", "decision_id")
    return own.withColumn("position", F.row_number().over(w)).select("function_id", "decision_id", "description", "created_at", "position")


def reasoning_text(decisions: DataFrame) -> DataFrame:
    """decision_id, text: what is embedded of a decision."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    return decisions.select("decision_id", F.concat_ws("\n", part("Type", "type"), part("Decision", "description"), part("Rejected", "rejected_alternatives"), part("Trigger", "trigger")).alias("text"))


def lineage(decisions: DataFrame, depth: int = 8) -> DataFrame:
    """decision_id, ancestor, depth: parents of parents, up to `depth` steps; cycles end."""
    step = decisions.select(F.col("decision_id").alias("child"), F.col("parent_decision_id").alias("parent")).filter("parent is not null")
    front = step.select(F.col("child").alias("decision_id"), F.col("parent").alias("ancestor"))
    out = front.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        front = front.join(step, F.col("ancestor") == F.col("child")).select("decision_id", F.col("parent").alias("ancestor")).filter("decision_id <> ancestor")
        out = out.unionByName(front.withColumn("depth", F.lit(k)))
    return out.groupBy("decision_id", "ancestor").agg(F.min("depth").alias("depth"))


def replace_examples(examples: DataFrame, new: DataFrame, key: str = "contract_id") -> DataFrame:
    """examples after those of the contracts in `new` are replaced as a whole."""
    return examples.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*examples.columns))


def set_fields(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the fields of `changes` (key and some of its columns) where a change has the key and a value."""
    fields = [c for c in changes.columns if c != key]
    own = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return table.join(own, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def log_violations(log: DataFrame, found: DataFrame, run: str) -> DataFrame:
    """log with the violations found by a run; an id follows from run, contract, function and kind, so a repeated write of the
    same run adds nothing, while another run's accumulates."""
    new = found.withColumn("violation_id", F.sha2(F.concat_ws("|", F.lit(run), "contract_id", "function_id", "violation_type"), 256))
    return log.unionByName(new.select(*log.columns).join(log.select("violation_id"), "violation_id", "left_anti").select(*log.columns))


def recent_violations(violations: DataFrame, contracts: DataFrame, now, days: int = 7) -> DataFrame:
    """contract_id, title, n, n_recent: violations of each contract, and those of the last days before `now`."""
    by = violations.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detected_at") > now - F.expr(f"interval {days} days")).alias("n_recent"))
    return by.join(contracts.select("contract_id", "title"), "contract_id").select("contract_id", "title", "n", "n_recent")


def check_contracts(contracts: DataFrame, functions: DataFrame, reach: DataFrame, scope: DataFrame) -> DataFrame:
    """contract_id, function_id, violation_type: active contracts against the functions in their scope (contract_id, id): structural,
    what a function reaches against the rule; presence, a docstring where the rule asks for one.  contracts: contract_id, status,
    pattern, required, exclusions, presence."""
    active = contracts.filter("status = 'active'")
    structural = rules.contract_violations(active.filter("pattern is not null").select("contract_id", "pattern", "required", "exclusions"), reach).select("contract_id", "id").distinct()
    structural = structural.join(scope, ["contract_id", "id"], "left_semi").select("contract_id", F.col("id").alias("function_id"), F.lit("structural").alias("violation_type"))
    asks = active.filter("presence = 'docstring'").select("contract_id", "exclusions")
    bare = functions.filter("is_external = 0 and type <> 'class' and coalesce(docstring, '') = ''").select("id")
    presence = scope.join(small(asks), "contract_id").filter(~F.exists("exclusions", lambda p: F.startswith(F.lower("id"), F.lower(p)))).join(bare, "id", "left_semi")
    return structural.unionByName(presence.select("contract_id", F.col("id").alias("function_id"), F.lit("presence").alias("violation_type")))


def snippet(nodes: DataFrame) -> DataFrame:
    """id, text: what a semantic check embeds of a function; functions without any are left out."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", some("signature"), some("docstring"), F.nullif(F.substring("body", 1, SNIPPET_BODY), F.lit("")))
    return nodes.filter("is_external = 0").select("id", text.alias("text")).filter(F.trim("text") != "")


def schema_objects(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """name, id, cardinality, methods: classes with the names of their methods, and the cardinality of known types, else MEDIUM.
    nodes: id, name, type; known: name, cardinality."""
    methods = nodes.filter("type in ('function', 'method')").select(names.parent("id").alias("id"), names.last_segment("name").alias("m")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("m")), ",").alias("methods"))
    own = nodes.filter("type = 'class'").select("id", names.last_segment("name").alias("name")).join(methods, "id", "left")
    return own.join(known, "name", "left").select("name", "id", F.coalesce("cardinality", F.lit("MEDIUM")).alias("cardinality"), F.coalesce("methods", F.lit("")).alias("methods"))
