"""Detectors over the bodies of functions and their calls: performance, principles, and what suppresses findings.

Bodies are tables with id, name, module, file, is_external, is_async, body; calls have caller_id and callee_id.  Every detector
judges all functions in one plan.  A null body has no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, word lists, weights and thresholds that decide what is found.
LOOP = r"\bfor\s+[\w,\s(]+\s+in\b"
COMPREHENSION = r"(?s)(?<!\w)\[.+?\bfor\b.+?\bin\b"
DB_SINK = r"(?i)\b(?:_db\.execute|_pool\.acquire|conn\.fetch|conn\.execute|asyncpg\.connect|aiosqlite\.connect)\b"
RAW_ACCESS = r"(?i)\b(?:_db\.execute|_db\._db|_pool\.acquire|conn\.fetch|conn\.execute|asyncpg\.connect|aiosqlite\.connect)\b"
BATCH = r"(?i)\bexecutemany\b"
INFRASTRUCTURE = r"(?i)\b(storage|repository|database|embedder|embed|cache|queue|redis|smtp|email_sender)\b"
HIGH_LATENCY = r"(?i)openai|anthropic|httpx|aiohttp|requests\.|boto|stripe|twilio|sendgrid|resend|urllib\.request|aiofiles"
AWAIT = r"(\w+)\s*=\s*await\s+([\w.]+\s*\()"
CONCURRENT = r"\basyncio\.gather\b|\bcreate_task\b|\bTaskGroup\b"
SQL_WORDS = r"(?i)\b(?:SELECT|FROM|WHERE|JOIN|GROUP\s+BY|ORDER\s+BY|INSERT|UPDATE|DELETE)\b"
SQL_JOIN = r"(?i)\b(?:LEFT\s+|INNER\s+|RIGHT\s+|FULL\s+)?JOIN\s+(\w+)\s+\w*\s+ON\s+([^,\n]+)"
SQL_GROUP, SQL_DISTINCT = r"(?i)\bGROUP\s+BY\b", r"(?i)COUNT\s*\(\s*DISTINCT\b"
SQL_EQUAL = r"(\w+\.\w+)\s*=\s*(\w+\.\w+)"
ISINSTANCE = r"\bisinstance\s*\(\s*\w[\w.]*\s*,\s*([\w.]+)"
ISINSTANCE_TUPLE = r"\bisinstance\s*\(\s*\w[\w.]*\s*,\s*\(([^)]+)\)"
TYPE_IS = r"\btype\s*\(\s*\w[\w.]*\s*\)\s*(?:==|is)\s*([\w.]+)"
VALIDATION_TYPES = ("str", "int", "float", "bool", "list", "dict", "tuple", "bytes", "set", "None", "NoneType", "type")
CARDINALITY = {"UNBOUNDED": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "SCALAR": 0}
SEVERITIES = ("high", "medium", "low")
OCP = {"high": 5, "medium": 3}

#: String literals; the inner loops give nothing back, so long texts need no deep recursion.
LITERAL = r'(?s)"""(?:.*?)"""|' + r"'''(?:.*?)'''|" + r'"(?:[^"\\]*+(?:\\.[^"\\]*+)*+)"|' + r"'(?:[^'\\]*+(?:\\.[^'\\]*+)*+)'"


def has_loop(body="body") -> Column:
    c = F.col(body)
    return F.coalesce(c.rlike(LOOP) | c.rlike(COMPREHENSION), F.lit(False))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def correlated_sql(bodies: DataFrame) -> DataFrame:
    """id, severity: string literals with two joins or more, a GROUP BY and a COUNT(DISTINCT; high if two of the joins name
    the same column, one row a literal."""
    own = bodies.filter(F.col("body").rlike(SQL_GROUP) & F.col("body").rlike(SQL_DISTINCT)).select("id", F.explode(_all(F.col("body"), LITERAL, 0)).alias("q"))
    q = F.col("q")
    own = own.filter((F.regexp_count(q, F.lit(SQL_WORDS)) >= 2) & q.rlike(SQL_GROUP) & q.rlike(SQL_DISTINCT)).withColumn("ons", _all(q, SQL_JOIN, 2)).filter(F.size("ons") >= 2)
    part = lambda p: F.when(p.rlike(SQL_EQUAL), F.array(F.lower(F.regexp_extract(p, SQL_EQUAL, 1)), F.lower(F.regexp_extract(p, SQL_EQUAL, 2)))).otherwise(F.array().cast("array<string>"))
    columns = F.flatten(F.transform("ons", lambda on: F.array_distinct(F.flatten(F.transform(F.split(on, "AND"), part)))))
    return own.select("id", F.when(F.size(columns) > F.size(F.array_distinct(columns)), "high").otherwise("medium").alias("severity"))


def n_plus_one(bodies: DataFrame, edges: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """id, severity: functions with a loop that call a database access, or a function that calls one.  low: the body has
    executemany; with objects (name, cardinality) the greatest weight of those that the body or a callee names decides (3 up:
    high, 1 down: low); else medium."""
    step = edges.select("caller_id", "callee_id").distinct()
    sinks = bodies.filter(F.col("body").rlike(DB_SINK)).select("id")
    near = step.join(sinks.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct()
    reach = sinks.unionByName(near).distinct().withColumnRenamed("id", "callee_id")
    loops = bodies.filter(has_loop()).select("id", "body")
    found = loops.join(step.join(reach, "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct(), "id", "left_semi")
    if objects is None:
        return found.select("id", F.when(F.col("body").rlike(BATCH), "low").otherwise("medium").alias("severity"))
    weight = F.coalesce(*[F.when(F.col("cardinality") == k, F.lit(w)) for k, w in CARDINALITY.items()], F.lit(2))
    names = step.join(found.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").join(bodies.select(F.col("id").alias("callee_id"), F.lower("name").alias("word")), "callee_id").select(F.col("caller_id").alias("id"), "word").distinct()
    known = objects.select(F.lower("name").alias("object"), weight.alias("weight")).distinct()
    by_name = names.join(known, F.contains("word", "object") | F.contains("object", "word")).select("id", "weight")
    by_body = found.select("id", F.lower("body").alias("text")).join(known, F.contains("text", "object")).select("id", "weight")
    most = by_name.unionByName(by_body).groupBy("id").agg(F.max("weight").alias("weight"))
    severity = F.when(F.col("body").rlike(BATCH), "low").when(F.col("weight") >= 3, "high").when(F.col("weight") <= 1, "low").otherwise("medium")
    return found.join(most, "id", "left").select("id", severity.alias("severity"))


def expansion_class(hits: DataFrame, least: float = 0.70) -> DataFrame:
    """id: what is near an expanding seed (kinds expand, pairwise) and not near a reducing one.  hits: kind, id, similarity."""
    near = hits.filter(F.col("similarity") >= least)
    return near.groupBy("id").agg(F.bool_or(F.col("kind").isin("expand", "pairwise")).alias("grows"), F.bool_or(F.col("kind") == "reduce").alias("shrinks")).filter("grows and not shrinks").select("id")


def quadratic(bodies: DataFrame, edges: DataFrame, expand: DataFrame) -> DataFrame:
    """id, severity: callers of expanding functions (other than themselves): high if they expand too, medium if they loop."""
    grows = expand.select("id").distinct()
    callers = edges.filter("caller_id <> callee_id").join(grows.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct()
    own = bodies.join(callers, "id", "left_semi").join(grows.withColumn("grows", F.lit(True)), "id", "left")
    return own.select("id", F.when(F.col("grows"), "high").when(has_loop(), "medium").otherwise("low").alias("severity"))


def external_in_loop(bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callee, severity: internal functions with a loop and the external ones that they call; high for names of slow services."""
    loops = bodies.filter("is_external = 0").filter(has_loop()).select(F.col("id").alias("caller_id"))
    outside = bodies.filter("is_external <> 0").select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    calls = edges.select("caller_id", "callee_id").distinct().join(loops, "caller_id", "left_semi").join(outside, "callee_id")
    return calls.select(F.col("caller_id").alias("id"), "callee", F.when(F.col("callee").rlike(HIGH_LATENCY) | F.col("callee_id").rlike(HIGH_LATENCY), "high").otherwise("medium").alias("severity"))


def sequential_awaits(bodies: DataFrame) -> DataFrame:
    """id, n_pairs: neighbouring awaits of which the second call, up to its closing bracket, and what lies between do not
    name the first one's variable, in bodies without concurrent calls."""
    text = F.col("body")
    own = bodies.filter(text.rlike(AWAIT) & ~text.rlike(CONCURRENT)).select("id", _all(text, AWAIT, 0).alias("found"), _all(text, AWAIT, 1).alias("names"), F.split(text, AWAIT).alias("between")).filter(F.size("found") >= 2)

    def call_rest(i):
        """What follows the second call's opening bracket, up to the closing one."""
        pieces = F.transform(F.sequence(i + 2, F.size("found")), lambda j: F.concat(F.get("between", j), F.coalesce(F.get("found", j), F.lit(""))))
        step = lambda s, c: F.when(s["depth"] == 0, s).otherwise(
            F.struct((s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).cast("int").alias("depth"), (s["n"] + 1).cast("int").alias("n"))
        )
        rest = F.array_join(pieces, "")
        return F.aggregate(F.split(rest, ""), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step, lambda s: F.substring(rest, F.lit(1), s["n"]))

    def free(i):
        window = F.concat(F.get("between", i + 1), F.get("found", i + 1), call_rest(i))
        return (F.get("names", i) != "self") & ~F.regexp_like(window, F.concat(F.lit(r"\b"), F.get("names", i), F.lit(r"\b")))

    return own.select("id", F.size(F.filter(F.sequence(F.lit(0), F.size("found") - 2), free)).cast("long").alias("n_pairs")).filter("n_pairs > 0")


def open_closed(bodies: DataFrame) -> DataFrame:
    """id, n_types, severity: bodies that tell three or more types of their own apart."""
    text = F.col("body")
    tuples = F.flatten(F.transform(_all(text, ISINSTANCE_TUPLE, 1), lambda t: F.filter(F.split(t, r"[\s,]+"), lambda x: x != "")))
    types = F.array_except(F.array_distinct(F.concat(_all(text, ISINSTANCE, 1), _all(text, TYPE_IS, 1), tuples)), F.array(*map(F.lit, VALIDATION_TYPES)))
    out = bodies.select("id", F.size(types).cast("long").alias("n_types")).filter(F.col("n_types") >= OCP["medium"])
    return out.withColumn("severity", F.when(F.col("n_types") >= OCP["high"], "high").otherwise("medium"))


def dependency_inversion(bodies: DataFrame) -> DataFrame:
    """id, n_accesses, severity: raw access to infrastructure by functions whose id does not name infrastructure."""
    own = bodies.filter(~F.col("id").rlike(INFRASTRUCTURE))
    out = own.select("id", F.size(F.array_distinct(_all(F.col("body"), RAW_ACCESS, 0))).cast("long").alias("n_accesses")).filter("n_accesses >= 1")
    return out.withColumn("severity", F.when(F.col("n_accesses") >= 2, "high").otherwise("medium"))


def acknowledged(decisions: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """id, reason: the newest decision of a type a function (ties to the greater decision).  decisions: decision_id, type,
    description, created_at; links: decision_id, function_id."""
    own = links.join(decisions.filter(F.col("type") == kind), "decision_id")
    return own.groupBy(F.col("function_id").alias("id")).agg(F.max_by("description", F.struct("created_at", "decision_id")).alias("reason"))


def performance(bodies: DataFrame, edges: DataFrame, suppressions: DataFrame, objects: DataFrame | None = None, expand: DataFrame | None = None, tests: Column | None = None) -> DataFrame:
    """id, pattern, severity, suppressed, reason, rank: the findings of all performance detectors, without test files if `tests`
    tells them.  An acknowledged function's are suppressed with its reason, and low ones of the first and third rule by
    themselves; rank orders by suppression and severity."""
    own = bodies.filter(~tests) if tests is not None else bodies
    found = [
        correlated_sql(own).withColumn("pattern", F.lit("correlated_join_aggregate")),
        n_plus_one(own, edges, objects).withColumn("pattern", F.lit("n_plus_one")),
        external_in_loop(own, edges).select("id", "severity").withColumn("pattern", F.lit("external_call_in_loop")),
        sequential_awaits(own.filter("is_external = 0 and is_async = 1")).select("id", F.lit("medium").alias("severity"), F.lit("sequential_awaits").alias("pattern")),
    ]
    if expand is not None:
        found.append(quadratic(own, edges, expand).withColumn("pattern", F.lit("quadratic_expansion")))
    return rank_findings(found, suppressions, ("n_plus_one", "quadratic_expansion"))


def rank_findings(found: list[DataFrame], suppressions: DataFrame, low: tuple[str, ...] = ()) -> DataFrame:
    out = found[0].select("id", "pattern", "severity")
    for x in found[1:]:
        out = out.unionByName(x.select("id", "pattern", "severity"))
    out = out.join(suppressions, "id", "left")
    by_itself = F.col("pattern").isin(*low) & (F.col("severity") == "low") if low else F.lit(False)
    out = out.withColumn("suppressed", F.col("reason").isNotNull() | by_itself).withColumn("reason", F.coalesce("reason", F.when(by_itself, "auto"), F.lit("")))
    severity = F.coalesce(*[F.when(F.col("severity") == s, F.lit(k)) for k, s in enumerate(SEVERITIES)], F.lit(9))
    return out.withColumn("rank", F.when(F.col("suppressed"), 10).otherwise(0) + severity)


def principles(bodies: DataFrame, responsibilities: DataFrame, suppressions: DataFrame) -> DataFrame:
    """id, pattern, severity, suppressed, reason, rank: the findings on single responsibility (given), open-closed and dependency
    inversion, for internal functions."""
    own = bodies.filter("is_external = 0")
    found = [x.withColumn("pattern", F.lit(name)) for x, name in ((responsibilities, "srp"), (open_closed(own), "ocp"), (dependency_inversion(own), "dip"))]
    return rank_findings(found, suppressions)
