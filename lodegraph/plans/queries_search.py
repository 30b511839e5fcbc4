"""Queries on vectors and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import architecture as A
from ..operators import vectors as S
from . import views as V

#: The stated keyword pairs; the vectors asked are all whose id is divisible by 20.
TERMS = ((0, "the"), (0, "of"), (1, "that"), (1, "with"), (2, "le"), (2, "de"))


def _vectors(s, d):
    return V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(s, d):
    """Every row whose id is divisible by 20."""
    return V.table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")


def _terms(s):
    return s.createDataFrame(TERMS, "query_id long, term string")


_COS = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))"
_VEC = "with v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e, label from embeddings)"
_KNN = f"""{_VEC}, sem as (select * from (select a.id as query_id, b.id, {_COS} as c, row_number() over (partition by a.id order by round({_COS}, 9) desc, b.id) as rank from v a, v b where a.id % 20 = 0 and a.id <> b.id) where rank <= {{k}})"""
_KW = f"""words as (select doc_id as id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as term from documents), terms(query_id, term) as (values {", ".join(map(repr, TERMS))}),
kw as (select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by sum(tf) desc, id) as rank, count(*) as n
  from (select id, term, count(*) as tf from words where term in (select term from terms) group by all) join terms using (term) group by query_id, id having count(*) = 2) where rank <= {{k}})"""


def _hybrid(s, d):
    semantic = S.knn_blocks(_vectors(s, d), _asked(s, d), 40)
    keyword = S.keyword_rank(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _terms(s), 40)
    return S.fuse(semantic, keyword, 10)


def _concentration(s, d, near):
    return A.concentration(near.join(V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("module")), "id"), 0.3)


def _examples(s, d):
    return V.table(s, d, "embeddings").filter("vec_id between 100 and 107").select(F.when(F.col("vec_id") % 2 == 0, "violation").otherwise("compliance").alias("kind"), "embedding")


QUERIES = {
    "keyword_search": (lambda s, d: S.keyword_rank(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _terms(s), 20), "with " + _KW.format(k=20) + " select query_id, id, rank from kw"),
    "centroids": (
        lambda s, d: S.centroids(_vectors(s, d)).select("label", "position", F.round("value", 6).alias("value")),
        f"""{_VEC}, m as (select label, i - 1 as position, avg(e[i]) as m from v, range(1, 65) t(i) group by all), l as (select label, sqrt(sum(m * m)) as len from m group by 1)
select label, position, round(m / len, 6) as value from m join l using (label)""",
    ),
    "prototype_scan": (
        lambda s, d: S.semantic_check(_vectors(s, d), _examples(s, d), 0.55),
        f"""{_VEC}, b0 as (select *, case when id % 2 = 0 then 'violation' else 'compliance' end as kind from v where id between 100 and 107),
m as (select a.id, max(case when kind = 'violation' then round(1 - (1 - {_COS}) / 2, 4) end) as violation, max(case when kind = 'compliance' then round(1 - (1 - {_COS}) / 2, 4) end) as compliance from v a, b0 b group by a.id)
select id, violation, compliance, violation >= 0.55 and compliance < 0.55 as violates from m""",
    ),
    "embedding_cache": (
        lambda s, d: V.table(s, d, "documents").select("doc_id", names.short_hash("text").alias("body_hash")).join(
            V.table(s, d, "documents").filter("doc_id % 2 = 0").select(names.short_hash("text").alias("body_hash")).distinct().withColumn("hit", F.lit(True)), "body_hash", "left"
        ).groupBy(F.coalesce("hit", F.lit(False)).alias("cached")).agg(F.count(F.lit(1)).alias("n")),
        "select sha256(text) in (select sha256(text) from documents where doc_id % 2 = 0) as cached, count(*) as n from documents group by 1",
    ),
    "embed_text": (
        lambda s, d: V.nodes(s, d).select("id", names.short_hash(F.concat_ws("\n", F.concat(F.lit("def "), "name"), F.nullif(F.col("docstring"), F.lit("")), F.substring("module", 1, 2000))).alias("text_hash")),
        V.with_views("select id, substr(sha256('def ' || name || case when docstring <> '' then chr(10) || docstring else '' end || chr(10) || module), 1, 16) as text_hash from nodes"),
    ),
    "knn": (lambda s, d: S.knn_blocks(_vectors(s, d), _asked(s, d), 10), _KNN.format(k=10) + " select query_id, rank, id, round(1 - (1 - c) / 2, 4) as similarity from sem"),
    "hybrid_search": (
        _hybrid,
        _KNN.format(k=40) + ", " + _KW.format(k=40) + """ select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (
  select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.id, b.id) as id, round(coalesce(1.0 / (60 + a.rank), cast(0 as double)) + coalesce(1.0 / (60 + b.rank), cast(0 as double)), 8) as score
  from sem a full join kw b on a.query_id = b.query_id and a.id = b.id)) where rank <= 10""",
    ),
    "concentration": (
        lambda s, d: _concentration(s, d, S.knn_blocks(_vectors(s, d), _asked(s, d), 10)),
        _KNN.format(k=10)
        + """ select query_id, module, round(n / total, 4) as share, round(n / total, 4) >= 0.3 as fires from (select query_id, cast(label as varchar) as module, count(*) as n, sum(count(*)) over (partition by query_id) as total,
  row_number() over (partition by query_id order by count(*) desc, cast(label as varchar)) as k from sem join embeddings on vec_id = id group by query_id, label) where k = 1""",
    ),
}
