"""Quality classifier: hashed word n-gram logistic regression, fitted with
follow-the-regularised-leader updates, scored as sparse dot products.

A word gives two features, its lower-case form and its shape (runs of letters, digits and signs),
and so do pairs of neighbours; all are hashed into one table of 2^HASH_BITS weights. A feature's
value is its share of the text's features, so long and short texts are treated alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandloom.llm.common import WORD, text_of

HASH_BITS = 18
SCALE = 24.0  # a text whose features all weigh w has the logit SCALE * w
REMEMBERED = 300_000
SAMPLE_ROWS = 8_000  # labelled rows that the fit reads at most, chosen by hash
THRESHOLD = 0.3

_WORDS = re.compile(WORD)
_RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+|.", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_seen: dict[str, int] = {}


def _shape(word: str) -> str:
    out = []
    for run in _RUNS.findall(word):
        if run[0].isalpha():
            out.append("A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a")
        else:
            out.append("0" if run[0].isdigit() else run[:3])
    return "".join(out[:6])


def _ids(word: str) -> int:
    """Hash of the lower-case word and, in the upper half, of its shape."""
    found = zlib.crc32(word.translate(_LOWER).encode("utf-8", "replace")) | zlib.crc32(b"s" + _shape(word).encode("utf-8", "replace")) << 32
    if len(word) <= 40:
        if len(_seen) >= REMEMBERED:
            _seen.clear()
        _seen[word] = found
    return found


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Buckets of all features of a text, repeats included; empty for a text without words."""
    words = _WORDS.findall(text)
    if not words:
        return np.empty(0, np.int64)
    both = np.array([_seen.get(w) or _ids(w) for w in words], np.uint64)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    k = np.uint64(0x100000001B3)
    same = (word[1:] == word[:-1]).astype(np.uint64)
    return _bucket(
        np.concatenate([word, shape + (np.uint64(1) << np.uint64(33)), word[1:] * k + word[:-1] + (np.uint64(1) << np.uint64(62)), (shape[1:] * k + shape[:-1]) * np.uint64(2) + same + (np.uint64(1) << np.uint64(61))])
    )


def fit(texts: Iterator[tuple[str, int]], alpha: float = 0.6, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """One pass of FTRL-proximal updates; returns the weights, the bias last."""
    z, n = np.zeros((1 << HASH_BITS) + 1), np.zeros((1 << HASH_BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for text, label in texts:
        f = features(text)
        at, count = np.unique(f, return_counts=True)
        at, x = np.append(at, 1 << HASH_BITS), np.append(count * (SCALE / max(1, len(f))), 1.0)
        w = weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
        n[at] += g * g
    return weights(slice(None))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether the crc32 of the id as text is divisible by parts (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fit on at most sample_rows labelled documents that are not held out, chosen by hash.

    The sample is the documented bound of the fit: it is read by one task, in hash order. Labels
    of one document that differ count as their majority (1 in a draw); null labels are left out.
    Without labelled rows all weights are 0 and each score is 0.5.
    """
    own = (
        labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample_rows)
    )
    # bounded by sample_rows, so it may be broadcast
    picked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(own), "doc_id").select("_order", "text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column(1), b.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    one = picked.repartition(1).sortWithinPartitions("_order", "text")
    found = one.mapInArrow(run, "weights binary").first()
    return np.frombuffer(found["weights"], "<f4") if found else np.zeros((1 << HASH_BITS) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of docs and the score (0 to 1) in one more column of the given name."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    col = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for t in b.column(col):
                f = features(t.as_py() or "")
                logit = w[-1] + (SCALE * float(w[f].mean()) if len(f) else 0.0)
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, logit)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text).

    A null text counts as empty; an empty one gets the score of the bias. Rows that repeat get
    the same score. Only the text decides: no other column is read for a score.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    return scored(rows, train(docs, labels, **how)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    name = "_score"
    while name in docs.columns:
        name = "_" + name
    return scored(docs, train(docs, labels, **how), name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)
