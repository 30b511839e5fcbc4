"""Design patterns from the structure of classes, for all methods at once.

methods: id, class_id, method, body, decorators (array); inherits: sub, base (class ids); calls: caller_id, callee_id; fields: id of
class-level fields.  Each pattern is a few joins on the class or the inheritance; a method may have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..tables import saved

# Names that tell the parts of a pattern, and how sure a finding is.
VISITOR_VERBS = ("print", "visit", "render", "handle", "encode", "decode", "write", "emit")
DISPATCH, VISIT = r"^_?([a-z][a-z0-9]*)_([A-Za-z]\w*)$", r"^visit_([A-Za-z]\w*)$"
FACTORY = r"(?i)^_?(?:create|make|build|factory|produce|spawn|manufacture|new_instance|create_instance|get_or_create)(?:_|$)"
NOTIFY = ("notify", "notify_observers", "notify_all", "emit", "fire", "trigger", "dispatch", "publish")
ATTACH = ("attach", "subscribe", "register", "add_listener", "add_observer", "on")
DETACH = ("detach", "unsubscribe", "deregister", "remove_listener", "remove_observer", "off")
UPDATE = ("on_update", "on_change", "on_event", "on_notify", "receive", "notify_of")
ACCESS = ("get_instance", "getInstance", "instance", "shared_instance", "get_singleton", "singleton", "get_shared_instance")
GUARDS = ("__new__", "__init__")
FIELDS = ("_instance", "__instance", "_singleton")
STRATEGY = (
    "execute", "run", "apply", "sort", "compress", "encode", "process", "compute", "calculate", "perform", "evaluate", "compare", "select",
    "format", "transform", "serialize", "validate", "render", "emit",
)
SUCCESSORS = ("_next", "next", "_successor", "successor", "next_handler", "_next_handler", "next_link", "_chain")
CHILDREN = ("child", "children", "item", "items", "element", "elements", "node", "nodes", "component", "components", "part", "parts", "member", "members", "leaf", "subtree")
ABSTRACT = r"(?m)^\s*raise\s+NotImplementedError\b"
CONFIDENCE = {
    "dispatch": 0.92, "visitor": 0.90, "accept": 0.75, "hook": 0.85, "pass_hook": 0.75, "template": 0.88, "creator": 0.90, "concrete_creator": 0.88, "overridden": 0.72, "observer": 0.65, "singleton": 0.80,
    "strategy": 0.78, "concrete_strategy": 0.82, "chain": 0.85, "composite": 0.80, "abstract_factory": 0.88, "concrete_factory": 0.85, "decorator": 0.82, "proxy": 0.65,
}


#: Patterns that are told by calls.
CALLING = {"template_method", "chain_of_responsibility", "composite", "decorator_or_proxy"}


def is_abstract(decorators="decorators", body="body") -> Column:
    return F.coalesce(F.array_contains(decorators, "abstractmethod"), F.lit(False)) | F.coalesce(F.col(body).rlike(ABSTRACT), F.lit(False))


def is_pass_only(body="body") -> Column:
    """Whether a body has nothing but `pass` or `...` below its signature, docstrings, comments and empty lines."""
    text = F.regexp_replace(F.col(body), r"(?s)^\s*(?:async\s+)?def [^\n]*?(?:\n[^\n]*?){0,5}:[ \t]*(?:\n|$)", "")
    for quote in ('"""', "'''"):
        text = F.regexp_replace(text, rf"(?sm)^[ \t]*{quote}.*?(?:{quote}[^\n]*|\z)", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*#.*$", ""), r"\s+", " "))
    return F.coalesce((F.col(body) != "") & text.isin("", "pass", "..."), F.lit(False))


def _row(df: DataFrame, pattern: str, role, kind: str | Column, missing=None) -> DataFrame:
    sure = F.lit(CONFIDENCE[kind]) if isinstance(kind, str) else kind
    return df.select("id", "class_id", F.lit(pattern).alias("pattern"), (F.lit(role) if isinstance(role, str) else role).alias("role"), sure.alias("confidence"), (F.lit("") if missing is None else missing).alias("missing"))


def _with_missing(df: DataFrame, gaps: DataFrame) -> DataFrame:
    """df and `missing`: the gaps (id, gap) of each row, sorted and joined."""
    return df.join(gaps.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("gap")), ",").alias("missing")), "id", "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def detect(methods: DataFrame, inherits: DataFrame, calls: DataFrame, fields: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """id, class_id, pattern, role, confidence, missing (what the pattern lacks, joined by commas); only: the patterns that are asked.

    What all patterns read is saved once, and what each finds as it is found: one plan of all of them has more than a hundred
    joins, and the driver would hold the stages and broadcasts of all at once."""
    m = saved(methods.select("id", "class_id", "method", is_abstract().alias("abstract"), is_pass_only().alias("passes")))
    up = saved(inherits.select(F.col("sub").alias("class_id"), "base").distinct())
    down = up.select(F.col("class_id").alias("sub"), F.col("base").alias("class_id"))
    theirs = m.select(F.col("class_id").alias("sub"), "method", F.col("abstract").alias("sub_abstract"), F.col("passes").alias("sub_passes"))
    of_base = m.select(F.col("class_id").alias("base"), "method", "abstract").filter("abstract").drop("abstract")

    def lacking(own: DataFrame, done: str = "true") -> DataFrame:
        """id, gap: subclasses without a method of that name (that is done)."""
        return own.select("id", "class_id", "method").join(down, "class_id").join(theirs.filter(done), ["sub", "method"], "left_anti").select("id", names.last_segment("sub").alias("gap"))

    def overrides(own: DataFrame) -> DataFrame:
        """own and the base whose abstract method it implements."""
        return own.join(up, "class_id").join(of_base, ["base", "method"], "left_semi").select(*own.columns).distinct()

    out = []

    def row(df: DataFrame, pattern: str, *rest) -> None:
        if only is None or pattern in only:
            out.append(saved(_row(df, pattern, *rest)))

    # visitor
    verb, element = F.regexp_extract("method", DISPATCH, 1), F.regexp_extract("method", DISPATCH, 2)
    named = m.withColumn("verb", verb).filter(F.col("verb").isin(*VISITOR_VERBS))
    handlers = m.filter(F.startswith("method", F.lit("_"))).withColumn("verb", verb).withColumn("element", element).filter("verb <> ''").select("verb", "class_id", "element").distinct()
    several = handlers.groupBy("verb").agg(F.count_distinct("class_id").alias("n")).filter("n >= 2").select("verb")
    concrete = named.join(several, "verb", "left_semi").join(handlers, ["verb", "class_id"], "left_semi")
    gaps = concrete.select("id", "class_id", "verb").join(handlers.select("verb", "element").distinct(), "verb").join(handlers, ["verb", "class_id", "element"], "left_anti")
    row(_with_missing(concrete, gaps.select("id", F.concat(F.lit("_"), "verb", F.lit("_"), "element").alias("gap"))), "visitor", "concrete_visitor", "dispatch", F.col("missing"))
    visits = m.withColumn("element", F.regexp_extract("method", VISIT, 1)).filter("element <> ''").join(concrete.select("id"), "id", "left_anti")
    wanted = visits.filter("abstract").select(F.col("class_id").alias("base"), "element").distinct()
    of = visits.join(up.join(wanted.select("base").distinct(), "base", "left_semi").groupBy("class_id").agg(F.min("base").alias("base")), "class_id")
    done = visits.filter("not abstract").select("class_id", "element")
    gaps = of.select("id", "class_id", "base").join(wanted, "base").join(done, ["class_id", "element"], "left_anti").select("id", F.concat(F.lit("visit_"), "element").alias("gap"))
    row(_with_missing(of, gaps), "visitor", F.when(F.col("abstract"), "abstract_visitor").otherwise("concrete_visitor"), "visitor", F.col("missing"))
    accepts = m.filter("method = 'accept'")
    row(_with_missing(accepts, lacking(accepts.filter("abstract"))), "visitor", F.when(F.col("abstract"), "abstract_element").otherwise("concrete_element"), "accept", F.col("missing"))
    # template method
    hooks = m.filter("abstract")
    row(_with_missing(hooks, lacking(hooks, "not sub_abstract")), "template_method", "abstract_hook", "hook", F.col("missing"))
    inside = calls.join(m.select(F.col("id").alias("caller_id"), F.col("class_id").alias("caller_class"), F.col("method").alias("caller")), "caller_id")
    inside = saved(inside) if only is None or not CALLING.isdisjoint(only) else inside
    called = inside.select("callee_id", "caller_class", "caller_id").distinct()
    passing = m.filter("passes and not abstract")
    by_id = passing.join(called, (F.col("id") == F.col("callee_id")) & (F.col("class_id") == F.col("caller_class")) & (F.col("id") != F.col("caller_id"))).select("id")
    by_name = passing.join(called, (F.col("method") == F.col("callee_id")) & (F.col("class_id") == F.col("caller_class")) & (F.col("id") != F.col("caller_id"))).select("id")
    soft = passing.join(by_id.unionByName(by_name).distinct(), "id", "left_semi")
    row(_with_missing(soft, lacking(soft, "not sub_passes")), "template_method", "abstract_hook", "pass_hook", F.col("missing"))
    open_ = m.filter("abstract or passes").select(F.col("id").alias("callee_id"), F.col("class_id").alias("hook_class"), F.col("method").alias("hook"))
    uses = inside.join(open_, "callee_id").filter("caller_class = hook_class").select(F.col("caller_id").alias("id"), "hook").distinct()
    templates = m.filter("not abstract").join(soft.select("id"), "id", "left_anti").join(uses.select("id").distinct(), "id", "left_semi")
    gaps = templates.select("id", "class_id").join(uses, "id").join(down, "class_id").join(theirs.select("sub", F.col("method").alias("hook")), ["sub", "hook"], "left_anti").select("id", names.last_segment("sub").alias("gap"))
    row(_with_missing(templates, gaps), "template_method", "template_method", "template", F.col("missing"))
    # factories
    makers = m.filter(F.col("method").rlike(FACTORY))
    abstract_makers = makers.filter("abstract")
    row(_with_missing(abstract_makers, lacking(abstract_makers, "not sub_abstract")), "factory_method", "abstract_creator", "creator", F.col("missing"))
    made = overrides(makers.filter("not abstract"))
    row(made, "factory_method", "concrete_creator", "concrete_creator")
    plain = makers.filter("not abstract").join(made.select("id"), "id", "left_anti")
    overridden = plain.join(plain.select("id", "class_id", "method").join(down, "class_id").join(theirs, ["sub", "method"], "left_semi").select("id").distinct(), "id", "left_semi")
    row(_with_missing(overridden, lacking(overridden)), "factory_method", "creator", "overridden", F.col("missing"))
    whole = abstract_makers.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("class_id")
    abstract_factories = abstract_makers.join(whole, "class_id", "left_semi")
    every = abstract_factories.select("id", "class_id").join(abstract_factories.select("class_id", "method"), "class_id")
    row(_with_missing(abstract_factories, lacking(every)), "abstract_factory", "abstract_factory", "abstract_factory", F.col("missing"))
    concrete = makers.filter("not abstract").join(up.join(whole.withColumnRenamed("class_id", "base"), "base", "left_semi").select("class_id").distinct(), "class_id", "left_semi")
    row(concrete, "abstract_factory", "concrete_factory", "concrete_factory")
    # observer, singleton
    part = F.when(F.col("method").isin(*NOTIFY), "notify").when(F.col("method").isin(*ATTACH), "attach").when(F.col("method").isin(*DETACH), "detach")
    subjects = m.withColumn("part", part).filter("part is not null")
    has = subjects.groupBy("class_id").agg(F.sort_array(F.collect_set("part")).alias("has")).filter("size(has) >= 2")
    lacks = F.array_join(F.array_except(F.array(F.lit("attach"), F.lit("detach"), F.lit("notify")), F.col("has")), ",")
    row(subjects.join(has, "class_id"), "observer", "subject", F.round(0.75 + 0.08 * F.size("has"), 2), lacks)
    row(m.filter(F.col("method").isin(*UPDATE)), "observer", "observer", "observer")
    single = m.filter(F.col("method").isin(*ACCESS)).select("class_id").distinct()
    kept = fields.select(names.parent("id").alias("class_id"), names.last_segment("id").alias("f")).filter(F.col("f").isin(*FIELDS)).select("class_id").distinct().withColumn("kept", F.lit(True))
    guards = m.filter(F.col("method").isin(*ACCESS, *GUARDS)).join(single, "class_id", "left_semi").join(kept, "class_id", "left")
    row(guards, "singleton", F.when(F.col("method").isin(*ACCESS), "accessor").otherwise("guard"), "singleton", F.when(F.col("kept"), "").otherwise("field"))
    # strategy
    acts = m.filter(F.col("method").isin(*STRATEGY))
    few = m.groupBy("class_id").agg(F.count_if("abstract").alias("n")).filter("n <= 3").select("class_id")
    abstract_acts = acts.filter("abstract").join(few, "class_id", "left_semi")
    row(_with_missing(abstract_acts, lacking(abstract_acts)), "strategy", "abstract_strategy", "strategy", F.col("missing"))
    row(overrides(acts.filter("not abstract")), "strategy", "concrete_strategy", "concrete_strategy")
    # chain, composite: calls of the method's own name through a field
    through = inside.filter(F.endswith("callee_id", F.concat(F.lit("."), "caller"))).withColumn("path", F.split(F.regexp_replace("callee_id", r"self\.", ""), r"\."))
    has_part = lambda words: through.filter(F.arrays_overlap("path", F.array(*map(F.lit, words)))).select(F.col("caller_id").alias("id")).distinct()
    bases = up.select("class_id").distinct().withColumn("derived", F.lit(True))
    chain = m.join(has_part(SUCCESSORS), "id", "left_semi").join(bases, "class_id", "left")
    row(chain, "chain_of_responsibility", F.when(F.col("abstract") | F.col("passes") | F.col("derived").isNotNull(), "handler").otherwise("concrete_handler"), "chain")
    row(m.join(has_part(CHILDREN), "id", "left_semi"), "composite", "composite", "composite")
    # decorator, proxy: calls of the same method of another class
    other = inside.join(m.select(F.col("id").alias("callee_id"), F.col("class_id").alias("other"), F.col("method").alias("same")), "callee_id").filter("same = caller and other <> caller_class")
    other = other.select(F.col("caller_id").alias("id"), F.col("caller_class").alias("class_id"), "other").distinct()
    shared = other.join(up, "class_id").join(up.select(F.col("class_id").alias("other"), "base"), ["other", "base"], "left_semi").select("id").distinct().withColumn("shared", F.lit(True))
    wraps = other.select("id", "class_id").distinct().join(shared, "id", "left")
    row(wraps, "decorator_or_proxy", F.when(F.col("shared"), "decorator").otherwise("proxy"), F.when(F.col("shared"), CONFIDENCE["decorator"]).otherwise(CONFIDENCE["proxy"]))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
