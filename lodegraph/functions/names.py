"""Column expressions on dotted ids, hashes and vectors.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(col, n: int) -> Column:
    """The first n segments of a dotted name, all of a shorter one."""
    return F.substring_index(col, ".", n)


def last_segment(col) -> Column:
    return F.substring_index(col, ".", -1)


def parent(col) -> Column:
    """The name without its last segment; null at top level."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(c, r"\.?[^.]*$", ""), F.lit(""))


def suffixes(col) -> Column:
    """Every proper dotted suffix: a.b.c has b.c and c.  An equi-join on them replaces LIKE '%.x'."""
    parts = F.split(col, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))


def ancestors(col) -> Column:
    """Every proper dotted prefix: a.b.c has a and a.b."""
    parts = F.split(col, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def short_hash(col, n: int = 16) -> Column:
    """The first n hex digits of sha256."""
    return F.substring(F.sha2(col, 256), 1, n)


def module_of(path, root: str = "") -> Column:
    """Path to dotted module: root, extension and a closing __init__ go."""
    c = F.col(path) if isinstance(path, str) else path
    if root:
        c = F.regexp_replace(c, "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace(c, r"^/+", ""), r"\.[A-Za-z0-9]+$", ""), "/", "."), r"\.__init__$", "")


def package_name(col) -> Column:
    """Normalised distribution name: lower case, runs of - _ . as one dash."""
    return F.lower(F.regexp_replace(col, r"[-_.]+", "-"))


def is_test_file(col) -> Column:
    return F.rlike(col, F.lit(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[A-Za-z]+$"))


def dot(a, b) -> Column:
    """Inner product in index order, as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def similarity(cosine) -> Column:
    """round(1 - d / 2, 4) of the cosine distance d = 1 - cosine."""
    return F.round(1 - (1 - cosine) / 2, 4)


# The leading words of a commit's subject by the type of decision that it stands for.
DECISION_TYPES = (
    ("Patch", "fix|bug|patch|hotfix|revert"),
    ("Implementation", "add|feat|impl|build|create|new|support"),
    ("Design", "refactor|redesign|move|extract|restructure|rename|clean|drop|remove"),
    ("Architectural", "arch"),
)


def decision_type(subject) -> Column:
    """Type of decision of a commit, by how its subject begins; Patch if nothing fits."""
    s = F.lower(F.col(subject) if isinstance(subject, str) else subject)
    return F.coalesce(*[F.when(s.rlike(f"^({words})"), kind) for kind, words in DECISION_TYPES], F.lit("Patch"))
