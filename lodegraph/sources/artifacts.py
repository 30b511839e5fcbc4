"""Readers of files that other tools leave: symbol indexes, lockfiles, git logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

_SYMBOLS = "documents array<struct<relativePath: string, symbols: array<struct<symbol: string, documentation: array<string>, relationships: array<struct<symbol: string, isReference: boolean>>>>>>"
# Separators of an exported log (git log --name-only with these formats).
FIELD, RECORD = "\x1f", "\x1e"


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """file, symbol, signature, docs, library, name of a symbol index in JSON."""
    docs = spark.read.schema(_SYMBOLS).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    rows = docs.select(F.col("d.relativePath").alias("file"), F.explode("d.symbols").alias("s"))
    return rows.select("file", F.col("s.symbol").alias("symbol"), F.array_join("s.documentation", "\n").alias("docs"), library("s.symbol").alias("library"), symbol_name("s.symbol").alias("name"), F.col("s.relationships").alias("relationships"))


def library(symbol):
    """Package of a symbol: the third word of `scheme manager package version descriptor`."""
    return names.package_name(F.when(F.size(F.split(symbol, " ")) >= 5, F.split(symbol, " ")[2]))


def symbol_name(symbol):
    """Dotted name of a symbol's descriptor, without marks."""
    last = F.element_at(F.split(symbol, " "), -1)
    return F.regexp_replace(F.translate(F.regexp_replace(last, r"\(\)\.?$|[#.:]$", ""), "`", ""), r"[/#]+", ".")


def read_requirements(lines: DataFrame) -> DataFrame:
    """library, version of pinned lines (name==version); lines: value."""
    m = F.regexp_extract("value", r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 1)
    v = F.regexp_extract("value", r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 2)
    return lines.select(names.package_name(m).alias("library"), v.alias("version")).filter("library <> ''")


def read_toml_lock(text: DataFrame) -> DataFrame:
    """library, version of [[package]] tables; text: value, a whole file a row."""
    part = text.select(F.explode(F.split("value", r"\[\[package\]\]")).alias("p"))
    return part.select(names.package_name(F.regexp_extract("p", r'(?m)^name\s*=\s*"([^"]+)"', 1)).alias("library"), F.regexp_extract("p", r'(?m)^version\s*=\s*"([^"]+)"', 1).alias("version")).filter("library <> '' and version <> ''")


def read_package_lock(spark: SparkSession, path: str) -> DataFrame:
    """library, version of a package-lock.json, root package left out."""
    packages = spark.read.schema("packages map<string, struct<version: string>>").option("multiLine", True).json(path)
    rows = packages.select(F.explode("packages").alias("k", "v")).filter("k <> ''")
    return rows.select(F.regexp_replace("k", r"^(.*/)?node_modules/", "").alias("library"), F.col("v.version").alias("version"))


def read_pipfile_lock(spark: SparkSession, path: str) -> DataFrame:
    """library, version of a Pipfile.lock: pinned versions of the default packages and of those for development."""
    packages = "map<string, struct<version: string>>"
    own = spark.read.schema(f"default {packages}, develop {packages}").option("multiLine", True).json(path)
    rows = own.select(F.explode(F.map_concat(F.coalesce("develop", F.create_map().cast(packages)), F.coalesce(F.map_filter("default", lambda k, v: ~F.coalesce(F.map_contains_key("develop", k), F.lit(False))), F.create_map().cast(packages)))).alias("k", "v"))
    return rows.select(names.package_name(F.col("k")).alias("library"), F.regexp_replace(F.col("v.version"), "^==", "").alias("version")).filter("version <> ''")


def split_symbols(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a symbol index in two steps: symbols that a document defines are internal, those that are only referred to
    external, as external.<library>.<name>.  symbols: file, symbol, docs, library, name, relationships; edges: caller_id, callee_id."""
    defined = symbols.select("symbol").distinct()
    calls = symbols.select(F.col("symbol").alias("caller"), "name", "file", F.explode("relationships").alias("r")).filter("r.isReference").select("caller", "name", "file", F.col("r.symbol").alias("symbol"))
    outside = calls.select("symbol").distinct().join(defined, "symbol", "left_anti")
    external = outside.select("symbol", F.concat_ws(".", F.lit("external"), library("symbol"), symbol_name("symbol")).alias("id"), symbol_name("symbol").alias("name"), F.lit(1).alias("is_external"))
    nodes = symbols.select("symbol", F.col("name").alias("id"), "name", F.lit(0).alias("is_external")).dropDuplicates(["symbol"]).unionByName(external)
    edges = calls.select(F.col("name").alias("caller_id"), "symbol").join(nodes.select("symbol", F.col("id").alias("callee_id")), "symbol").select("caller_id", "callee_id")
    return nodes.drop("symbol"), edges


# The roles of an occurrence in a binary index.
DEFINITION, READ_ACCESS = 1, 8


def attribute_reads(occurrences: DataFrame) -> DataFrame:
    """caller, callee: each read is of the latest definition of a function before it in its document.  occurrences: document, line,
    symbol, roles, is_function.  A running last value by line, then each pair once."""
    definition = F.when((F.col("roles").bitwiseAND(DEFINITION) != 0) & F.col("is_function"), F.col("symbol"))
    within = Window.partitionBy("document").orderBy("line", F.col("roles").bitwiseAND(DEFINITION).desc(), "symbol").rowsBetween(Window.unboundedPreceding, 0)
    own = occurrences.withColumn("caller", F.last(definition, ignorenulls=True).over(within)).filter((F.col("roles").bitwiseAND(READ_ACCESS) != 0) & F.col("caller").isNotNull())
    return own.filter("caller <> symbol").select("caller", F.col("symbol").alias("callee")).distinct()


def read_binary_symbols(spark: SparkSession, path: str) -> DataFrame:
    """document, line, symbol, roles, is_function of an index in its binary form, decoded field by field: documents are field 2 of the
    index; of a document field 1 is the path and field 2 an occurrence: 1 the range (packed), 2 the symbol, 3 the roles."""
    import pandas as pd

    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number()
            elif kind == 2:
                size = number()
                yield key >> 3, data[at : at + size]
                at += size
            else:
                at += 8 if kind == 1 else 4

    def first_number(data: bytes) -> int:
        value = shift = 0
        for byte in data:
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        return value

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                for field, document in fields(bytes(content)):
                    if field != 2:
                        continue
                    name, found = "", []
                    for f, value in fields(document):
                        if f == 1:
                            name = value.decode()
                        elif f == 2:
                            own = dict(fields(value))
                            found.append((first_number(own.get(1, b"\0")), own.get(2, b"").decode(), own.get(3, 0)))
                    rows += [(name, line, symbol, roles, symbol.endswith("().")) for line, symbol, roles in found]
            yield pd.DataFrame(rows, columns=["document", "line", "symbol", "roles", "is_function"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "document string, line int, symbol string, roles int, is_function boolean")


def first_source(sources: list[DataFrame]) -> DataFrame:
    """library, version by priority: the first source that has any row wins as a whole."""
    tagged = None
    for k, s in enumerate(sources):
        own = s.select("library", "version").withColumn("k", F.lit(k))
        tagged = own if tagged is None else tagged.unionByName(own)
    first = tagged.agg(F.min("k").alias("k"))
    return tagged.join(F.broadcast(first), "k").select("library", "version").distinct()


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit_hash, changed_at, subject, file: one row a changed file; merges (two parents) are left out."""
    records = spark.read.option("lineSep", RECORD).text(path).filter(F.length(F.trim("value")) > 0)
    f = F.split("value", FIELD)
    rows = records.select(F.trim(f[0]).alias("commit_hash"), f[1].alias("parents"), f[2].alias("changed_at"), f[3].alias("subject"), F.split(F.trim(f[4]), "\n").alias("files"))
    return rows.filter(F.size(F.split(F.trim("parents"), " ")) < 2).select("commit_hash", "changed_at", "subject", F.explode("files").alias("file")).filter("file <> ''")
