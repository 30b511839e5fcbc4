"""Source files to nodes and call edges.

Python goes through the standard library's parser; other languages by their scopes (scoped_source), marked structural_layer =
'scoped'.  One narrow pass over (path, content) rows; a file that cannot be parsed gives one row of kind
`failed`.
"""

from __future__ import annotations

import ast
import hashlib
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoped_source

# Extensions, directories that are not walked, body limit, the order in which a project's language is decided, and what
# an index run takes.
EXTENSIONS = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".swift": "swift", ".kt": "kotlin", ".php": "php"}
SKIPPED = r"/(\.git|\.venv|venv|node_modules|__pycache__|\.mypy_cache|dist|build|\.next|\.nuxt|\.svelte-kit|\.turbo|out|\.output)/"
BODY = 2000
PRIORITY = ("python", "typescript", "javascript", "java", "rust", "go", "csharp", "cpp", "ruby", "swift", "kotlin", "php")
FUNCTION_FACTOR, SECONDS_LOW, SECONDS_HIGH, SECONDS_CLASS, SECONDS_LEAST = 1.3, 0.025, 0.085, 0.005, 5
SCHEMA = "kind string, id string, name string, module string, file string, type string, signature string, docstring string, body string, body_hash string, decorators array<string>, is_async int, parameter_names array<string>, enclosing_class string, start_line int, end_line int, structural_layer string, callee_id string, edge_type string"
_COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(", ")]


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the files below root whose extension is known, without those of build and version folders."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    known = "|".join(e[1:] for e in EXTENSIONS)
    return files.filter(F.col("path").rlike(rf"\.({known})$") & ~F.col("path").rlike(SKIPPED))


def dominant_language(files: DataFrame) -> DataFrame:
    """language: the first of the priority list that any file has."""
    ranks = F.coalesce(*[F.when(F.lower("path").endswith(e), F.lit(PRIORITY.index(lang))) for e, lang in EXTENSIONS.items()])
    best = files.agg(F.min(ranks).alias("k"))
    return best.select(F.get(F.array(*map(F.lit, PRIORITY)), "k").alias("language"))


def estimate(files: DataFrame) -> DataFrame:
    """files, functions, classes (both counted by pattern), seconds_low and seconds_high of an index run, cut to whole seconds: so
    many a function, after a factor for what patterns miss, and at least five for the classes."""
    count = lambda pattern: F.coalesce(F.sum(F.regexp_count("content", F.lit(pattern))), F.lit(0))
    own = files.agg(F.count(F.lit(1)).alias("files"), count(r"(?m)^\s*(?:async\s+)?(?:def|function|func|fn)\s+\w+").alias("functions"), count(r"(?m)^\s*(?:export\s+|public\s+|abstract\s+)*class\s+\w+").alias("classes"))
    corrected, classes = F.floor(F.col("functions") * FUNCTION_FACTOR), F.greatest(F.lit(SECONDS_LEAST), F.floor(F.col("classes") * SECONDS_CLASS))
    seconds = lambda each: (F.floor(corrected * each) + classes).cast("long")
    return own.select("files", "functions", "classes", seconds(SECONDS_LOW).alias("seconds_low"), seconds(SECONDS_HIGH).alias("seconds_high"))


def module_name(path: str, root: str = "") -> str:
    rel = path[len(root.rstrip("/")) + 1 :] if root and path.startswith(root.rstrip("/") + "/") else path.lstrip("/")
    name = os.path.splitext(rel)[0].replace("/", ".")
    return name[: -len(".__init__")] if name.endswith(".__init__") else name


def _row(**values) -> dict:
    return {c: values.get(c) for c in _COLUMNS}


def parse_python(path: str, content: str, root: str = "") -> list[dict]:
    """Node and edge rows of a Python file."""
    tree, lines, module = ast.parse(content), content.split("\n"), module_name(path, root)
    out: list[dict] = []

    def called(node) -> str | None:
        return node.id if isinstance(node, ast.Name) else f"{called(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) and called(node.value) else node.attr if isinstance(node, ast.Attribute) else None

    def own_calls(node):
        todo = list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop(0)
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call) and (name := called(x.func)):
                yield name
            todo[:0] = ast.iter_child_nodes(x)

    def visit(body, scope: str, cls: str | None):
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                id_ = f"{scope}.{x.name}"
                text = "\n".join(lines[x.lineno - 1 : x.end_lineno])
                args = [a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs)]
                head = f"{'async ' * isinstance(x, ast.AsyncFunctionDef)}def {x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")
                out.append(
                    _row(kind="node", id=id_, name=f"{cls}.{x.name}" if cls else x.name, module=module, file=path, type="method" if cls else "function", signature=head, docstring=ast.get_docstring(x) or "", body=text[:BODY],
                         body_hash=hashlib.sha256(text.encode()).hexdigest()[:16], decorators=[ast.unparse(d) for d in x.decorator_list], is_async=int(isinstance(x, ast.AsyncFunctionDef)), parameter_names=args,
                         enclosing_class=cls or "", start_line=x.lineno, end_line=x.end_lineno, structural_layer="precise")
                )
                out.extend(_row(kind="edge", id=id_, file=path, callee_id=c[5:] if c.startswith("self.") else c, edge_type="calls") for c in own_calls(x))
                visit(x.body, f"{id_}.<locals>", None)
            elif isinstance(x, ast.ClassDef):
                id_ = f"{scope}.{x.name}"
                out.append(_row(kind="node", id=id_, name=x.name, module=module, file=path, type="class", signature=f"class {x.name}", docstring=ast.get_docstring(x) or "", body="", body_hash="", decorators=[ast.unparse(d) for d in x.decorator_list], is_async=0, parameter_names=[], enclosing_class=cls or "", start_line=x.lineno, end_line=x.end_lineno, structural_layer="precise"))
                out.extend(_row(kind="edge", id=id_, file=path, callee_id=ast.unparse(b), edge_type="inherits") for b in x.bases)
                visit(x.body, id_, x.name)
            elif isinstance(x, ast.Import):
                out.extend(_row(kind="edge", id=module, file=path, callee_id=a.name, edge_type="imports") for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.extend(_row(kind="edge", id=module, file=path, callee_id=f"{x.module or ''}.{a.name}".lstrip("."), edge_type="imports") for a in x.names)
            elif hasattr(x, "body") and isinstance(x.body, list):
                visit(x.body + getattr(x, "orelse", []), scope, cls)

    visit(tree.body, module, None)
    return out


def parse_scoped(path: str, content: str, root: str = "") -> list[dict]:
    """Node and edge rows of a file in a language of braces, or Ruby: methods with their class, bases, imports, comments before a
    declaration as docstrings; structural_layer = 'scoped'."""
    language = EXTENSIONS[os.path.splitext(path)[1].lower()]
    module, found = module_name(path, root), scoped_source.scopes(content, language)
    out = [_row(kind="edge", id=module, file=path, callee_id=name, edge_type="imports") for name in scoped_source.imports(content, language)]
    for x in found:
        id_ = ".".join([module, *x["outer"], x["name"]])
        cls = x["outer"][-1] if x["method"] and x["outer"] else ""
        text, kind = content[x["start"] : x["end"]], "class" if x["kind"] == "class" else "method" if x["method"] else "function"
        own = kind != "class"
        out.append(
            _row(kind="node", id=id_, name=f"{cls}.{x['name']}" if cls else x["name"], module=module, file=path, type=kind, signature=" ".join(x["header"].split())[:200], docstring=scoped_source._doc(content, x["start"]),
                 body=text[:BODY] if own else "", body_hash=hashlib.sha256(text.encode()).hexdigest()[:16] if own else "", decorators=re.findall(r"@([\w.]+)", x["header"]), is_async=int(bool(re.search(r"\b(?:async|suspend)\b", x["header"]))), parameter_names=x["parameters"],
                 enclosing_class=cls, start_line=content.count("\n", 0, x["start"]) + 1, end_line=content.count("\n", 0, x["end"]) + 1, structural_layer="scoped")
        )
        out.extend(_row(kind="edge", id=id_, file=path, callee_id=b, edge_type="inherits") for b in x["bases"])
        if own:
            out.extend(_row(kind="edge", id=id_, file=path, callee_id=c, edge_type="calls") for c in scoped_source.called(content, x, found, language))
    return out


def parse_sources(files: DataFrame, root: str = "") -> DataFrame:
    """Tagged rows (kind node or edge) of all files; null contents (deleted files) give none."""

    def run(batches):
        for pdf in batches:
            out: list[dict] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if content is None:
                    continue
                try:
                    out += parse_python(path, content, root) if path.endswith(".py") else parse_scoped(path, content, root)
                except (SyntaxError, ValueError, RecursionError):
                    out.append(_row(kind="failed", file=path))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def split_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed rows."""
    nodes = parsed.filter("kind = 'node'").drop("kind", "callee_id", "edge_type")
    edges = parsed.filter("kind = 'edge'").select(F.col("id").alias("caller_id"), "callee_id", "edge_type", "file")
    return nodes, edges




def failed_files(parsed: DataFrame) -> DataFrame:
    """file: those that could not be parsed."""
    return parsed.filter("kind = 'failed'").select("file").distinct()
