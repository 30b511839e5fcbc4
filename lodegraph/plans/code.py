"""The documents seen as the functions of a code base, as DataFrames and as SQL.

A document is a function whose body is its whole text and, below it, one of a few pieces of code (the texts hold none); which
one, and module and calls, follow from its number.  Every eleventh is external.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V

PACKAGES = ("app.web", "app.storage", "app.core", "lib.cache", "lib.jobs", "app.tests")
LIBRARIES = ("httpx", "numpy", "stripe", "attrs")
SNIPPETS = (
    "def f(self, rows):\n    for x in rows:\n        conn.fetch(x)",
    'def f(self):\n    q = """SELECT a.id, COUNT(DISTINCT b.id) FROM a JOIN b bb ON b.a_id = a.id\n LEFT JOIN c cc ON c.a_id = a.id\n GROUP BY a.id"""\n    return q',
    "def f(self):\n    q = 'SELECT COUNT(DISTINCT y) FROM t JOIN u uu ON uu.x = t.x\n JOIN w ww ON ww.z = uu.z AND ww.k = 1\n GROUP BY t.y'\n    return _db.execute(q)",
    "def f(self, x):\n    isinstance(x, Alpha) or isinstance(x, (Beta, Gamma, str)) or type(x) is Delta or type(x) == Omega",
    "def f(self, x):\n    return isinstance(x, Alpha) or isinstance(x.y, pkg.Beta) or type(x) == Gamma",
    "async def f(self):\n    a = await g(1, h(2))\n    b = await k(3)\n    return a + b",
    "async def f(self):\n    a = await g(1)\n    b = await k(h(a))\n    c = await k(2)\n    self = await m(1)\n    e = await m(2)",
    "async def f(self):\n    a = await g(1)\n    b = await k(3)\n    await asyncio.gather(a, b)",
    "def f(self, rows):\n    for r, s in rows:\n        conn.executemany(r)\n    return [k for k in rows]",
    "def f(self, xs):\n    return [g(x) for x in xs]",
    "def f(self):\n    asyncpg.connect()\n    self._pool.acquire()\n    self._db.execute('x')",
    "def f(self):\n    pass",
    "def f(self):\n    raise NotImplementedError",
)


def functions(spark: SparkSession, d: str) -> DataFrame:
    """id, n, name, module, file, type, is_external, is_async, signature, docstring, body of each document."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    n = F.col("n")
    own = V.table(spark, d, "documents").select(F.col("doc_id").alias("n"), "text")
    own = own.withColumn("is_external", (n % 11 == 0).cast("int")).withColumn("module", F.when(n % 11 == 0, pick(LIBRARIES, n % 4)).otherwise(F.concat(pick(PACKAGES, n % 6), F.lit(".m"), (n % 40).cast("string"))))
    name = F.concat(F.lit("f"), n.cast("string"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(SNIPPETS, n % len(SNIPPETS)))
    return own.select(
        F.concat(F.when(F.col("is_external") == 1, "external.").otherwise(""), "module", F.lit("."), name).alias("id"), "n", name.alias("name"), "module", F.concat(F.lit("/"), F.translate("module", ".", "/"), F.lit(".py")).alias("file"),
        F.lit("function").alias("type"), "is_external", (n % 2).cast("int").alias("is_async"), F.concat(F.when(n % 2 == 1, "async def ").otherwise("def "), name, F.lit("(self)")).alias("signature"), F.when(n % 3 == 0, F.substring("text", 1, 80)).otherwise("").alias("docstring"), body.alias("body"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, callee_id: from function n to n + 1, 2n + 1 and 3n + 1."""
    ids = functions(spark, d).select("n", "id")
    steps = V.table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.explode(F.array(F.col("doc_id") + 1, 2 * F.col("doc_id") + 1, 3 * F.col("doc_id") + 1)).alias("to"))
    return steps.join(ids.withColumnRenamed("id", "caller_id"), "n").join(ids.select(F.col("n").alias("to"), F.col("id").alias("callee_id")), "to").select("caller_id", "callee_id")


def choices(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, type, description, created_at, n: orders as decisions on functions."""
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderpriority").alias("type"), F.concat_ws(" ", F.lit("because"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("description"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("n"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """name, cardinality: the nations' names as schema objects."""
    kinds = F.array(*map(F.lit, ("UNBOUNDED", "HIGH", "MEDIUM", "LOW", "SCALAR")))
    return V.table(spark, d, "nation").select(F.concat(F.lit("f"), (F.col("n_nationkey") + 1).cast("string"), F.lit("7")).alias("name"), F.element_at(kinds, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("cardinality"))


METHODS = ("visit_Circle", "visit_Square", "accept", "get_instance", "_render_Alpha", "_render_Beta", "notify", "attach", "detach", "create_shape", "make_part", "execute", "run", "handle", "build_view", "__new__", "on_update")
BODIES = ("def m(self):\n    raise NotImplementedError", 'def m(self):\n    """Says\n    nothing."""\n    # yet\n    pass', "def m(self):\n    return self._x", "def m(self):\n    ...")


def methods(spark: SparkSession, d: str) -> DataFrame:
    """k, id, class_id, method, body, decorators: the parts as methods, six a class."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    k, c = F.col("k"), F.col("c")
    own = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 6").alias("c"))
    own = own.withColumn("class_id", F.concat(F.lit("app.shapes.C"), c.cast("string"))).withColumn("method", pick(METHODS, (k * 5 + c) % len(METHODS)))
    decorators = F.when(k % 10 == 0, F.array(F.lit("abstractmethod"))).otherwise(F.array().cast("array<string>"))
    return own.select("k", "c", F.concat("class_id", F.lit("."), "method").alias("id"), "class_id", "method", pick(BODIES, (F.expr("k div 2") + c) % len(BODIES)).alias("body"), decorators.alias("decorators"))


def inherits(spark: SparkSession, d: str) -> DataFrame:
    """sub, base: class c derives from class c div 3."""
    own = methods(spark, d).select("c").distinct().filter("c > 0")
    return own.select(F.concat(F.lit("app.shapes.C"), F.col("c").cast("string")).alias("sub"), F.concat(F.lit("app.shapes.C"), F.expr("c div 3").cast("string")).alias("base"))


def method_calls(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, callee_id: through a field, to the base, to a neighbour in the class or to the next class."""
    own = methods(spark, d)
    ids = own.select((F.col("k") - 1).alias("k"), F.col("id").alias("next_id"))
    kind = F.col("k") % 5
    of = lambda c: F.concat(F.lit("app.shapes.C"), c.cast("string"), F.lit("."), "method")
    callee = F.when(kind == 0, F.concat(F.lit("self._next."), "method")).when(kind == 1, F.concat(F.lit("self.children."), "method")).when(kind == 2, of(F.expr("c div 3"))).when(kind == 3, F.col("next_id")).otherwise(of(F.col("c") + 1))
    return own.join(ids, "k", "left").select(F.col("id").alias("caller_id"), callee.alias("callee_id")).filter("callee_id is not null")


def fields(spark: SparkSession, d: str) -> DataFrame:
    """id: a class-level field of every second class."""
    return methods(spark, d).filter("c % 2 = 0").select(F.concat("class_id", F.lit("._instance")).alias("id")).distinct()


def text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


SQL = f"""
functions as (
  select case when external then 'external.' else '' end || module || '.' || name as id, n, name, module, '/' || replace(module, '.', '/') || '.py' as file, 'function' as type, cast(external as int) as is_external, cast(n % 2 as int) as is_async,
    case when n % 2 = 1 then 'async def ' else 'def ' end || name || '(self)' as signature, case when n % 3 = 0 then substr(t, 1, 80) else '' end as docstring, coalesce(t, '') || chr(10) || ({_list(SNIPPETS)})[n % {len(SNIPPETS)} + 1] as body
  from (select doc_id as n, 'f' || doc_id as name, doc_id % 11 = 0 as external, case when doc_id % 11 = 0 then ({_list(LIBRARIES)})[doc_id % 4 + 1] else ({_list(PACKAGES)})[doc_id % 6 + 1] || '.m' || doc_id % 40 end as module, text as t from documents)
),
calls as (
  select a.id as caller_id, b.id as callee_id from (select n, unnest([n + 1, 2 * n + 1, 3 * n + 1]) as k from functions) s join functions a on a.n = s.n join functions b on b.n = s.k
),
choices as (select o_orderkey as decision_id, o_orderpriority as type, 'because ' || o_orderstatus || ' ' || o_orderkey as description, o_orderdate as created_at, o_custkey as n from orders),
objects as (select 'f' || (n_nationkey + 1) || '7' as name, (['UNBOUNDED', 'HIGH', 'MEDIUM', 'LOW', 'SCALAR'])[n_nationkey % 5 + 1] as cardinality from nation)
"""


METHODS_SQL = f"""
methods as (
  select k, c, class_id || '.' || method as id, class_id, method, body, case when k % 10 = 0 then true else starts_with(body, {text(BODIES[0])}) end as abs, body in ({text(BODIES[1])}, {text(BODIES[3])}) as pas
  from (select p_partkey as k, p_partkey // 6 as c, 'app.shapes.C' || (p_partkey // 6) as class_id, ({_list(METHODS)})[(p_partkey * 5 + p_partkey // 6) % {len(METHODS)} + 1] as method,
    ({_list(BODIES)})[(p_partkey // 2 + p_partkey // 6) % {len(BODIES)} + 1] as body from part)
),
inh as (select distinct 'app.shapes.C' || c as sub, 'app.shapes.C' || (c // 3) as base from methods where c > 0),
pc as (
  select * from (select a.id as caller_id, a.class_id as caller_class, a.method as caller, case a.k % 5 when 0 then 'self._next.' || a.method when 1 then 'self.children.' || a.method when 2 then 'app.shapes.C' || (a.c // 3) || '.' || a.method
    when 3 then b.id else 'app.shapes.C' || (a.c + 1) || '.' || a.method end as callee_id from methods a left join methods b on b.k = a.k + 1) where callee_id is not null
)
"""


def with_code(sql: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{SQL}{sql}"
