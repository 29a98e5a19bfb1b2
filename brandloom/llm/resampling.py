"""Target-distribution importance resampling over hashed n-grams, by prefix CRCs.

A text is brought to words after one separator each, and scanned once; the running CRC-32 after
each word is kept, and the buckets that follow are stored for the passes that count and weigh. The CRC of any run of words follows from two of them: shifting the CRC of what
precedes the run by the run's length, a linear map over GF(2), and adding it to the CRC of the
text up to the run's end cancels what precedes. The map of each length is a table of 4 x 256
words, longer runs take several. Bucket counts are summed in the tasks; only the counts of the
buckets, whose number is a parameter, reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brandloom.llm.common import bounded, stored, text_of
from brandloom.llm.packing import slices

# The reflected CRC-32 polynomial; bytes that are no part of a word, after A-Z are lower.
POLYNOMIAL = 0xEDB88320
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

SLICE_BYTES = 4 << 20
SHORT = 64  # runs of fewer bytes have a table of their own
MAX_PARTS = 1_000_000  # partitions whose first ranks are sent to all tasks


def _normal() -> bytes:
    table = bytearray(range(256))
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    for b in SEPARATORS:
        if not 0x41 <= b <= 0x5A:
            table[b] = 0x20
    return bytes(table)


NORMAL = _normal()
_WORD = re.compile(rb" [^ ]+")


def _tables(unit: np.ndarray) -> np.ndarray:
    """4 x 256 words of a linear map from the images of the 32 unit vectors."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            on = np.arange(256) >> bit & 1 == 1
            out[byte, on] ^= unit[8 * byte + bit]
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


class Shift:
    """CRC-32 values moved on by a number of zero bytes."""

    def __init__(self) -> None:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            unit = np.where(unit & 1, unit >> 1 ^ np.uint32(POLYNOMIAL), unit >> 1)
        one = _tables(unit)
        powers, self.short = [np.uint32(1) << np.arange(32, dtype=np.uint32)], []
        for _ in range(SHORT):
            self.short.append(_tables(powers[-1]))
            powers.append(_apply(one, powers[-1]))
        self.short = np.stack(self.short)  # by length, byte of the value, its value
        self.doubled = [_tables(powers[SHORT])]  # SHORT bytes, twice as many, and so on
        self.one = one

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        t, low = self.short, length % SHORT
        out = t[low, 0, crc & 255] ^ t[low, 1, crc >> 8 & 255] ^ t[low, 2, crc >> 16 & 255] ^ t[low, 3, crc >> 24]
        high, k = length // SHORT, 0
        while high.any():
            if k == len(self.doubled):
                unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
                self.doubled.append(_tables(_apply(self.doubled[-1], _apply(self.doubled[-1], unit))))
            on = high & 1 == 1
            out[on] = _apply(self.doubled[k], out[on])
            high, k = high >> 1, k + 1
        return out

    def separated(self, crc: np.ndarray) -> np.ndarray:
        """After one more separator."""
        return _apply(self.one, crc) ^ np.uint32(zlib.crc32(b" "))


_SHIFT: list[Shift] = []


def features(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words, text by text, and the number of them and of words by text."""
    if not _SHIFT:
        _SHIFT.append(Shift())
    shift, after, size, words = _SHIFT[0], [], [], []
    for text in texts:
        found = _WORD.findall(b" " + text.translate(NORMAL))
        words.append(len(found))
        size += map(len, found)
        after += accumulate(found, lambda crc, word: zlib.crc32(word, crc), initial=0)
    words = np.array(words, np.int64)
    n, of, first_word = int(words.sum()), np.repeat(np.arange(len(texts)), words), np.cumsum(words) - words
    place = np.arange(n) + of  # of the value before each word: a text has one value more than words
    after = np.array(after, np.uint32)
    begin, end, upto = shift.separated(after[place]), after[place + 1], np.cumsum(size, dtype=np.int64)
    begun = upto - np.array(size, np.int64) + 1  # bytes before the word, with its separator
    left = (first_word + words)[of] - np.arange(n)  # words of the text from this one on
    counts = sum(np.maximum(words - k, 0) for k in range(longest))
    at, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
    for k in range(longest):
        first = np.flatnonzero(left > k)
        crc = end[first + k] ^ shift(begin[first], upto[first + k] - begun[first])
        out[at[of[first]] + first - first_word[of[first]]] = crc.astype(np.int64) % buckets
        at = at + np.maximum(words - k, 0)
    return out, counts, words


def hashed(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """doc_id, n_words and the buckets of all features, as integers in bytes, of each row; stored."""
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (c for b in batches for c in slices(b, 1, SLICE_BYTES)):
            bucket, counts, words = features(c.column(1).cast(pa.binary()).to_pylist(), buckets, longest)
            bucket = bucket.astype(dtype)
            ends = np.concatenate([[0], np.cumsum(counts)]) * bucket.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bucket)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(words), data], names=["doc_id", "n_words", "features"])

    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, features binary"))


def _buckets(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of hashed(), on the driver: `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for c in (c for b in batches for c in slices(b, 0, SLICE_BYTES)):
            total += np.bincount(_buckets(c.column(0), buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean of the gains; 0 without features) of rows of hashed()."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(gain), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        width = 2 if len(gain) <= 1 << 16 else 4
        for c in (c for b in batches for c in slices(b, 2, SLICE_BYTES)):
            n = pc.binary_length(c.column(2)).to_numpy(zero_copy_only=False) // width
            upto = np.concatenate([[0], np.cumsum(gain[_buckets(c.column(2), len(gain))])])
            end = np.cumsum(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(n, pa.int64()), pa.array((upto[end] - upto[end - n]) // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = "7:") -> Column:
    """floor(-1000 ln(-ln u)) of a hash of the id (a null id counts as empty): the same each time."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], drawn: int) -> DataFrame:
    """rows in order with rank 1, 2, 3 ... up to `drawn`, null after it.

    Dealt by ranges of the order and sorted within; the first rank of a part follows from the
    sizes of the parts before it, so no task sees all rows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, pos = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = stored(sizes.select("_p", before.alias("_first")))
    rank = F.col("_first") + pos + 1
    return dealt.join(bounded(first, MAX_PARTS), part == F.col("_p")).withColumn("rank", F.when(rank <= drawn, rank)).drop("_at", "_p", "_first")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of docs (doc_id, text).

    Of the documents with `least_words` words, the given per cent with the highest scores are
    drawn and ranked from 1; others have a null rank. target (text) sets the distribution. A null
    text has no words; rows with the same or no doc_id are drawn each for itself, in any order
    among equals; empty tables give empty results or gains of an empty target. Other columns are
    not read.
    """
    rows = hashed(docs, buckets, longest)
    aim = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    rows = weights(rows, gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets)))
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("_row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    found = ranked(able, [F.desc("score"), F.asc("doc_id"), F.asc("_row")], able.count() * percent // 100)
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return found.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
