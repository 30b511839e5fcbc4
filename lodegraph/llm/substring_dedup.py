"""Substring dedup: level-wise doubling of repeated windows.

Windows of a few words that occur once cannot lie in a longer repeat, so a short level settles most of the corpus; only
positions whose short window is repeated are extended to twice the length, until the wanted length is reached or none
survive.  Below the wanted length a window of `window` words is stood for by the leftmost least of its sub-windows, which
equal windows share; that leaves about a tenth of the positions to be counted.

Data move by blocks of documents (about `block_bytes` of text each, spread by a hash of row and input partition).  A block sends each of its distinct
window names once, with a mark if it holds it twice; names that are repeated anywhere go back to the blocks that hold them.
So a passage in a third of all documents costs one row a block, whatever the number of its occurrences, and no task ever
gathers the occurrences of a passage.

Cases: null or empty text: no words, nothing removed.  A null id is kept as null.  Equal rows are separate documents, so
they remove each other's windows.  A document below `window` words keeps all.  Only the id and text columns are read; others
may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T

BLOCK_BYTES = 12 << 20
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def ladder(window: int, base: int = 9) -> list[int]:
    """The lengths of the levels: each next one is at most twice the last."""
    out = [window]
    while (out[0] + 1) // 2 >= base:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Block:
    def __init__(self, table: pa.Table, window: int):
        self.texts, self.window = T.column(table, "text"), window
        self.bounds, self.codes, self.vocabulary = T.words(self.texts)
        self.known: dict[int, np.ndarray] = {}
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.starts = np.flatnonzero(np.arange(len(ends)) + window <= ends)

    def names(self, length: int, seed: int = 0) -> np.ndarray:
        found = T.window_hashes(T.hashes(self.vocabulary, seed)[self.codes], length, None if seed else self.known)
        if not seed:
            self.known = {length: found}
        return found

    def stands(self, names: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
        """For each window start the position whose shorter window stands for it."""
        return starts if length == self.window else T.leftmost_min(names, self.window - length + 1)[starts]

    def extra(self) -> np.ndarray:
        return self.names(self.window, 1) >> np.uint64(32)


def _send(block: _Block, number: int, names: np.ndarray, at: np.ndarray, extra: np.ndarray | None) -> pa.Table:
    chosen = np.zeros(len(names), bool)
    chosen[at] = True
    at = np.flatnonzero(chosen)
    at = at[np.argsort(names[at]) if extra is None else np.lexsort((extra[at], names[at]))]
    keys = names[at]
    new = keys[1:] != keys[:-1]
    if extra is not None:
        new |= extra[at[1:]] != extra[at[:-1]]
    first = np.flatnonzero(np.r_[True, new]) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.r_[first, len(keys)])
    keys, tag = keys[first], np.uint64(number << 1) | (n > 1).astype(np.uint64)
    if extra is not None:
        tag |= extra[at[first]] << np.uint64(32)
    return pa.table({"h": keys.view(np.int64), "tag": tag.view(np.int64)})


def _level(levels: list[int], k: int):
    """Sends the names of level k for the windows that level k - 1 left."""
    window = levels[-1]

    def run(docs: pa.Table, known: pa.Table | None = None) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "tag": pa.array([], pa.int64())})
        b = _Block(docs, window)
        starts = b.starts
        if k and len(starts):
            before = b.names(levels[k - 1])
            starts = starts[T.among(before[b.stands(before, levels[k - 1], starts)], np.sort(known["h"].to_numpy().view(np.uint64)))]
        names = b.names(levels[k])
        return _send(b, docs["block"][0].as_py(), names, b.stands(names, levels[k], starts) if len(starts) else starts, b.extra() if levels[k] == window and len(starts) else None)

    return (lambda left, right: run(left, right)) if k else (lambda table: run(table))


def _cut(window: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        b = _Block(docs, window)
        gone = np.zeros(len(b.codes) + 1, np.int64)
        if len(b.starts) and known.num_rows:
            h, x = known["h"].to_numpy().view(np.uint64), known["extra"].to_numpy().astype(np.uint64)
            order = np.lexsort((x, h))
            h, x = h[order], x[order]
            keys, extra = b.names(window)[b.starts], b.extra()[b.starts]
            i = np.searchsorted(h, keys)
            hit = np.zeros(len(keys), bool)
            for step in (0, 1):  # two names that agree in 64 bits differ in the other 32
                j = np.minimum(i + step, len(h) - 1)
                hit |= (h[j] == keys) & (x[j] == extra)
            gone[b.starts[hit]] += 1  # starts are distinct
            gone[b.starts[hit] + window] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        removed = np.diff(np.r_[0, np.cumsum(covered)][b.bounds])
        own, kept = T.raw(b.vocabulary), []
        for i, n in enumerate(removed):
            codes = b.codes[b.bounds[i] : b.bounds[i + 1]]
            kept.append(b" ".join(map(own.__getitem__, (codes[~covered[b.bounds[i] : b.bounds[i + 1]]] if n else codes).tolist())))
        return pa.table({"doc_id": docs["doc_id"].combine_chunks(), "n_words": np.diff(b.bounds), "n_removed": removed.astype(np.int64), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return lambda left, right: run(left, right)


def substring_dedup(docs: DataFrame, window: int = 35, base: int = 9, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text per row: words covered by a window of `window` words that starts elsewhere too
    are removed; windows are judged on the input.  The rest is joined by one space."""
    levels = ladder(window, base)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # equal rows go apart too; a row's partition is the same whenever it is computed again
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    grouped = own.groupBy("block")
    sent = grouped.applyInArrow(_level(levels, 0), "h long, tag long")
    for k in range(len(levels)):
        same = Window.partitionBy("h", F.shiftrightunsigned("tag", 32))
        known = (
            sent.select("h", "tag", F.count(F.lit(1)).over(same).alias("n"), F.max(F.col("tag").bitwiseAND(1)).over(same).alias("twice"))
            .filter("n > 1 or twice = 1")
            .select(F.expr("cast((tag & 4294967295) >> 1 as int)").alias("block"), "h", F.shiftrightunsigned("tag", 32).alias("extra"))
        )
        both = grouped.cogroup(known.groupBy("block"))
        if k + 1 < len(levels):
            sent = both.applyInArrow(_level(levels, k + 1), "h long, tag long")
    return both.applyInArrow(_cut(window), _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), p as (
  select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35
), g as (
  select doc_id, i, hash(array_to_string(list_slice(ws, i, i + 34), ' ')) as h, array_to_string(list_slice(ws, i, i + 34), ' ') as win from p
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by h, win) as n from g) where n > 1
), c as (
  select distinct doc_id, unnest(range(i, i + 35)) as j from r
), t as (
  select w.doc_id, u.j, u.word from w, lateral (select unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j) u
), k as (
  select t.doc_id, count(c.j) as n_removed, string_agg(case when c.j is null then t.word end, ' ' order by t.j) as kept
  from t left join c on t.doc_id = c.doc_id and t.j = c.j group by t.doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
