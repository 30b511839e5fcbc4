"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours and pairs with one word between, hashed to 2^`bits` coordinates; words are
lower-cased (A-Z) and lose punctuation at their ends.  FTRL-proximal gives each coordinate its own rate and, with L1, zeroes
most weights, so the model is a short list of coordinates that goes to every task whatever the corpus.

The model is fitted on a bounded sample: at most about `max_rows` labelled rows, chosen by a hash of their id, and of the
documents that they name about `max_bytes` of text, chosen by a hash of the row before it is moved.  The rows meet the documents
in a join whose small side has that bound.  Scoring is one narrow pass over whole texts.

Cases: null text is empty; a text without words scores by the bias alone; without any usable label every score is 0.5;
null labels and labels of unknown documents are left out; equal texts count once in the fit, with the label 0 if they or their
ids have both; ids may be null or repeat; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _text as T

BITS = 20
MAX_ROWS, MAX_BYTES, EPOCHS = 12_000, 96 << 20, 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.0
REJECT = 0.7
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """bounds, coordinates: those of text i, with repeats, are coordinates[bounds[i]:bounds[i + 1]].  Pairs do not cross
    texts; a text of n words has n + (n - 1) + (n - 2) features."""
    bounds, codes, vocabulary = T.words(T.lower(texts))
    x = T.hash_bytes([w.strip(_PUNCTUATION) for w in T.raw(vocabulary)])[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    parts, rows = [T.mix(x)], [row]
    for gap in (1, 2):
        if len(x) > gap:
            inside = row[gap:] == row[:-gap]
            parts.append(T.pair(x[:-gap], x[gap:] + np.uint64(gap))[inside])
            rows.append(row[gap:][inside])
    at, of = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(of, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))], (at[order] >> np.uint64(64 - bits)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias; an example is its distinct coordinates and its label."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(z_, n_, l1_):
        return np.where(np.abs(z_) <= l1_, 0.0, -(z_ - np.sign(z_) * l1_) / ((beta + np.sqrt(n_)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, label = examples[k]
            w = weights(z[at], n[at], l1)
            b = float(weights(zb, nb, 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = weights(z, n, l1)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(weights(zb, nb, 0.0))


def _trainer(bits: int, max_bytes: int, epochs: int):
    def run(batches):
        examples, seen, size = [], set(), 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                texts = T.column(part, "text")
                bounds, at = features(texts, bits)
                for i, (text, label) in enumerate(zip(texts.to_pylist(), part.column("label").to_pylist(), strict=True)):
                    key = hash(text)
                    if key not in seen and size < max_bytes:
                        seen.add(key)
                        size += len(text)
                        examples.append((np.unique(at[bounds[i] : bounds[i + 1]]).astype(np.int32), label))
        kept, w, bias = fit(examples, bits, epochs) if examples else (np.empty(0, np.int64), np.empty(0), 0.0)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"at": [kept.astype(np.int32).tobytes()], "w": [w.astype(np.float32).tobytes()], "bias": [bias]}), preserve_index=False)

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"):
    """(coordinates, weights, bias) from the labelled rows, a bounded sample of them.  The fit runs in one task on an
    executor; at most 2^bits weights come to the driver."""
    usable = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    share = min(1.0, max_rows / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * max_rows)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = own.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(1 << 30)) < int(max_bytes / size * (1 << 30)))
    one = rows.repartition(1).sortWithinPartitions("doc_id", "label", F.xxhash64("text")).select("text", "label")
    row = one.mapInArrow(_trainer(bits, max_bytes, epochs), "at binary, w binary, bias double").first()
    return (np.frombuffer(row.at, np.int32).astype(np.int64), np.frombuffer(row.w, np.float32).astype(np.float64), row.bias) if row else (np.empty(0, np.int64), np.empty(0), 0.0)


def scorer(model, bits: int = BITS):
    """texts -> scores."""
    at, w, bias = model

    def run(texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << bits, np.float64)
        dense[at] = w
        bounds, x = features(texts, bits)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        hit = dense[x] != 0  # a feature counts once a text, as in the fit
        one = np.unique(row[hit] * (1 << bits) + x[hit])
        total = np.bincount(one >> bits, weights=dense[one & ((1 << bits) - 1)], minlength=len(texts)) + bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return run


def score_toxicity(docs: DataFrame, model, bits: int = BITS, text_column: str = "text", name: str = "score") -> DataFrame:
    """The table with a score from 0 to 1 a row; all rows and columns stay (a column of that name is replaced)."""
    score = scorer(model, bits)
    own = docs.drop(name)
    schema = StructType([*own.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, text_column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(T.column(part, text_column)))], [*part.schema.names, name])

    return own.mapInArrow(run, schema)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def model_for(spark, docs: DataFrame, sf_dir: str):
    """The model of the labels table without the held-out rows."""
    return train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), model_for(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
