"""Look-ups on nodes and edges, for all keys of a table at once.

nodes: id, name, module, file, type, is_external and what a look-up names; edges: caller_id, callee_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .bounds import small

# The model of the fallback vectors, and how many same-named nodes are shown.
FALLBACK, SAME_NAME = "text-embedding-3-large", 10
CLASS_TYPES = ("class", "ClassDef")


def by_key(nodes: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The nodes whose `column` (id, file, module) is among those of `wanted`."""
    return nodes.join(wanted.select(column).distinct(), column, "left_semi")


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """ancestor, id: the nodes at any depth below each id of `of`.  Prefixes are exploded, so it is an equi-join."""
    below = nodes.select("id", F.explode(names.ancestors("id")).alias("ancestor"))
    return below.join(of.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select("ancestor", "id")


def sibling_counts(nodes: DataFrame) -> DataFrame:
    """id, n_siblings: the other nodes at any depth below a node's parent, counted a parent and not pair by pair."""
    below = nodes.select(F.explode(names.ancestors("id")).alias("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    own = nodes.select("id", names.parent("id").alias("parent")).filter("parent is not null")
    return own.join(below, "parent").select("id", (F.col("n") - 1).alias("n_siblings")).filter("n_siblings > 0")


def class_members(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """ancestor, id: internal functions and methods with a body below each class."""
    own = nodes.filter("is_external = 0 and type in ('function', 'method') and body is not null and body <> ''")
    return descendants(own, classes)


def same_name(nodes: DataFrame, n: int = SAME_NAME) -> DataFrame:
    """id, other, rank: up to n other internal nodes of a node's name, by id."""
    own = nodes.filter("is_external = 0").select("name", "id")
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("k") <= n + 1).drop("k").withColumnRenamed("id", "other")
    pairs = nodes.select("id", "name").join(first, "name").filter("id <> other")
    w = Window.partitionBy("id").orderBy("other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("id", "other", "rank")


def dispatch_handlers(nodes: DataFrame, verbs: DataFrame) -> DataFrame:
    """verb, id: internal nodes named _verb_something."""
    own = nodes.filter("is_external = 0").select("id", F.regexp_extract(names.last_segment("name"), r"^_([a-z][a-z0-9]*)_.", 1).alias("verb"))
    return own.join(verbs.select("verb").distinct(), "verb", "left_semi").select("verb", "id")


def embedded_from_nothing(nodes: DataFrame) -> DataFrame:
    """Internal nodes other than classes that have a vector, but neither summary nor docstring."""
    return nodes.filter("is_external = 0 and embedding_model <> '' and summary = '' and docstring = ''").filter(~F.col("type").isin(*CLASS_TYPES))


def needs_enrichment(nodes: DataFrame, n: int = 500, force: bool = False) -> DataFrame:
    """The first n internal nodes, by id, on the fallback model or none, without a summary unless forced."""
    own = nodes.filter((F.col("is_external") == 0) & (F.col("embedding_model").isNull() | (F.col("embedding_model") == FALLBACK)))
    own = own if force else own.filter("summary is null or summary = ''")
    return own.orderBy("id").limit(n)


def callers_and_callees(edges: DataFrame) -> DataFrame:
    """id, role: the distinct ids of either end."""
    return edges.select(F.col("caller_id").alias("id"), F.lit("caller").alias("role")).unionByName(edges.select(F.col("callee_id").alias("id"), F.lit("callee").alias("role"))).distinct()


def filtered(table: DataFrame, order: list, n: int | None = None, **wanted) -> DataFrame:
    """Rows that meet the conditions given (column = value or list; None: no condition), in an order, the first n."""
    for column, value in wanted.items():
        if value is not None:
            table = table.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    table = table.orderBy(*order)
    return table.limit(n) if n else table


def applicable(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """contract_id, id: the functions that a contract covers: all without function_ids, those below x for x.*, else the id
    itself.  contracts: contract_id, function_ids (array)."""
    rules = contracts.select("contract_id", F.explode("function_ids").alias("f"))
    under = rules.filter(F.endswith("f", F.lit(".*"))).select("contract_id", F.regexp_replace("f", r"\.\*$", "").alias("ancestor"))
    below = functions.select("id", F.explode(names.ancestors("id")).alias("ancestor")).join(under, "ancestor").select("contract_id", "id")
    exact = functions.select("id").join(rules.select("contract_id", F.col("f").alias("id")), "id").select("contract_id", "id")
    every = functions.select("id").crossJoin(small(contracts.filter("function_ids is null or size(function_ids) = 0").select("contract_id"))).select("contract_id", "id")
    return below.unionByName(exact).unionByName(every).distinct()


def inheritance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, relative, relation (base or subclass): one step of inheritance either way.  edges: caller_id, callee_id, edge_type;
    a base that is a bare name is the least id of that name or of that end."""
    own = edges.filter("edge_type = 'inherits'").select(F.col("caller_id").alias("id"), F.col("callee_id").alias("bare")).distinct()
    keys = nodes.select("id", F.explode(F.array_distinct(F.concat(F.array("id", "name"), names.suffixes("id")))).alias("key")).select("key", "id", F.when((F.col("key") == F.col("id")) | (F.col("key") == names.last_segment("id")), 0).otherwise(1).alias("k"))
    found = own.join(keys.select(F.col("key").alias("bare"), F.col("id").alias("base"), "k"), "bare").groupBy("id", "bare").agg(F.min(F.struct("k", "base")).alias("b"))
    resolved = own.join(found, ["id", "bare"], "left").select("id", F.coalesce("b.base", "bare").alias("relative")).distinct()
    return resolved.withColumn("relation", F.lit("base")).unionByName(resolved.select(F.col("relative").alias("id"), F.col("id").alias("relative"), F.lit("subclass").alias("relation")))


def sibling_callers(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """id, caller: methods of the same class that call a method, by its id or its bare name.  Two equi-joins."""
    inside = calls.join(methods.select(F.col("id").alias("caller_id"), F.col("class_id").alias("caller_class")), "caller_id")
    by_id = methods.select("id", "class_id", F.col("id").alias("callee_id"))
    by_name = methods.select("id", "class_id", F.col("method").alias("callee_id"))
    both = by_id.unionByName(by_name).join(inside, "callee_id").filter("class_id = caller_class and id <> caller_id")
    return both.select("id", F.col("caller_id").alias("caller")).distinct()


def self_delegating(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """id, callee_id: calls of a method to something that ends in its own name."""
    own = calls.distinct().join(methods.select(F.col("id").alias("caller_id"), "method"), "caller_id")
    return own.filter(F.endswith("callee_id", F.concat(F.lit("."), "method"))).select(F.col("caller_id").alias("id"), "callee_id")


def slim(results: DataFrame, full: int = 3) -> DataFrame:
    """query_id, rank, id, detail: what comes after rank `full` keeps only its id."""
    return results.select("query_id", "rank", "id", F.when(F.col("rank") <= full, F.col("detail")).alias("detail"))


def with_overflow(rows: DataFrame, order: list, n: int = 30) -> DataFrame:
    """The first n rows with `overflow`, how many more there are (0 if none): an aggregate beside a top n, not one window."""
    total = rows.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("overflow"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # one row


def library_dependents(nodes: DataFrame, edges: DataFrame, libraries: DataFrame) -> DataFrame:
    """library, id, name, call_count: who calls what lies below external.<library>., counted by call sites."""
    own = edges.select("caller_id", F.regexp_extract("callee_id", r"^external\.([^.]+)\.", 1).alias("library")).join(libraries.select("library").distinct(), "library", "left_semi")
    return own.groupBy("library", F.col("caller_id").alias("id")).agg(F.count(F.lit(1)).alias("call_count")).join(nodes.select("id", "name"), "id").select("library", "id", "name", "call_count")
