"""Removal of strings that occur twice or more, found with suffix arrays over shards.

A string of LENGTH bytes has an anchor: the place with the least hash of GRAM bytes in it, which
is the same wherever the string occurs. So the strings of one anchor hash meet in one shard, each
occurrence of the anchor bringing the window of bytes that such strings can cover. Anchors that
occur once are left out first. Occurrences with the same window are counted and brought once; a
hash whose occurrences all have one window needs no array, as all its strings repeat.
In a shard the windows are put in a row, a suffix array and its permuted common prefixes are
computed, and a string repeats where suffixes of one anchor hash share LENGTH bytes or more.
Equal texts are one text with a count, so groups of copies bring their bytes once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import bounded, small_batches, stored, text_of
from brandloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 200
SLICE = 500  # rows of a batch that are worked on together
GRAM = 32
SHARD_BYTES = 1 << 20  # bytes of windows that one suffix array takes, about
LARGE_BYTES = 1 << 21  # an anchor hash with more is searched begin by begin, in its windows' memory
MAX_HASHES = 2_000_000  # repeated anchor hashes, or texts with copies, that may be broadcast
MAX_ENTRIES = 500_000  # texts with lists, and all that the lists hold, that may be broadcast (100 bytes each, about)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))


_POWERS = _powers(1 << 16)


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of gram bytes."""
    global _POWERS
    n = len(t) - gram + 1
    if len(t) >= len(_POWERS[0]):
        _POWERS = _powers(2 * len(t))
    up, down = _POWERS
    sums = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)])])
    h = (sums[gram:] - sums[:-gram]) * down[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of the given length."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    w, n = length - gram + 1, len(h)
    # the least of each w neighbours, from the least to either side inside blocks of w
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    # a place has the least hash of some string if the greatest of the leasts around it is its own
    m = len(least)
    blocks = np.zeros(-(-(m + 2 * w - 2) // w) * w, np.uint64)
    blocks[w - 1 : w - 1 + m] = least
    blocks = blocks.reshape(-1, w)
    left = np.maximum.accumulate(blocks, axis=1).ravel()
    right = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.flatnonzero(np.maximum(right[:n], left[w - 1 : w - 1 + n]) == h)
    return at, h[at]


def window(n: int, at: int, length: int, gram: int) -> tuple[int, int]:
    """Begin and end of the bytes that strings with this anchor can cover in a text of n bytes."""
    return max(0, at - (length - gram)), min(n, at + length)


def repeated_starts(anchor: np.ndarray, place: np.ndarray, windows: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """For each window (its anchor's hash and place in it) the begins of its strings that occur twice or
    more in windows of the same hash. Only strings whose anchor this is are looked at, so a string in
    overlapping windows of one text counts once."""
    t = np.frombuffer(b"".join(windows), np.uint8)
    sizes = np.array([len(x) for x in windows], np.int64)
    own = np.repeat(np.arange(len(windows)), sizes)
    at = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    least = anchor[own]
    h = np.concatenate([gram_hashes(t, gram), np.full(gram - 1, np.iinfo(np.uint64).max, np.uint64)])
    other = ((h < least) | ((h == least) & (at > place[own]))) & (at + gram <= sizes[own])
    others = np.concatenate([[0], np.cumsum(other)])
    whole = (at + length <= sizes[own]) & (at <= place[own]) & (at + length - gram >= place[own])
    whole &= others[np.minimum(np.arange(len(t)) + length - gram + 1, len(t))] == others[:-1]
    sa = suffix_array(t)
    run = np.cumsum(permuted_prefixes(t, sa)[sa] < length)
    sa, run = sa[whole[sa]], run[whole[sa]]
    group = np.unique(anchor, return_inverse=True)[1]
    _, kind, count = np.unique(run * np.int64(len(windows) + 1) + group[own[sa]], return_inverse=True, return_counts=True)
    hit = np.sort(sa[count[kind] > 1])
    cuts = np.searchsorted(hit, np.cumsum(sizes))
    return [at[x] for x in np.split(hit, cuts)[:-1]]


def repeated_by_begin(place: list[int], windows: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """The same for the windows of one hash that are too many for an array: strings of one anchor are equal
    only if they begin equally far before it, so each distance is counted on its own."""
    starts: list[list[int]] = [[] for _ in windows]
    for back in range(length - gram, -1, -1):
        own = [k for k, (p, w) in enumerate(zip(place, windows)) if p >= back and p - back + length <= len(w)]
        if len(own) > 1:
            names = np.array([xxhash.xxh3_128_digest(windows[k][place[k] - back : place[k] - back + length]) for k in own], "S16")
            # a trailing zero byte is not told from none, so the names are compared as numbers
            names = np.frombuffer(names.tobytes(), "<u8").reshape(-1, 2)
            _, kind, count = np.unique(names, axis=0, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(count[kind.ravel()] > 1).tolist():
                starts[own[k]].append(place[own[k]] - back)
    return [np.array(s, np.int64) for s in starts]


def _spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Begins and ends, in turn, of the runs that strings with these ascending begins cover."""
    if not len(starts):
        return np.empty(0, np.int64)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return np.stack([starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length], 1).ravel()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE))


def few(df: DataFrame, entries: str, most: int = MAX_ENTRIES) -> DataFrame:
    """Mark a stored side for broadcast if its rows and the entries of their lists are few: lists grow with the texts, so a count of rows bounds nothing."""
    held = df.agg(F.coalesce(F.sum(F.size(entries) + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


def repeated_spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """key, spans: the merged runs of removed bytes of each text that has some (rows: key, text)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            hs, ps = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, h = anchors(text, length, gram)
                hs.append(h.view(np.int64))
                ps.append(np.array([xxhash.xxh3_64_intdigest(key, seed=int(a)) for a in at], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *hs])), pa.array(np.concatenate([np.empty(0, np.int64), *ps]))], names=["h", "place"])

    twice = rows.mapInArrow(places, "h long, place long").groupBy("h").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).filter("lo < hi")
    twice = stored(twice.select("h"))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            hs, ks, ps, fs = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, h = anchors(text, length, gram)
                hs.append(h.view(np.int64))
                ks += [key] * len(at)
                ps.append(at)
                for a in at.tolist():
                    x, y = window(len(text), a, length, gram)
                    fs.append(xxhash.xxh3_128_digest(text[x:y], seed=a - x))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *hs])), pa.array(ks, pa.binary()), pa.array(np.concatenate([np.empty(0, np.int64), *ps]).astype(np.int32)), pa.array(fs, pa.binary())], names=["h", "key", "at", "form"])

    occurrences = rows.mapInArrow(forms, "h long, key binary, at int, form binary")
    found = stored(occurrences.join(bounded(twice, MAX_HASHES), "h", "left_semi").distinct())
    form = stored(found.groupBy("h", "form").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("ref")))
    several = form.groupBy("h").agg(F.count("*").alias("forms")).filter("forms > 1").select("h")
    open_ = form.join(several, "h", "left_semi").select("h", "form", "ref.key", "ref.at")

    wanted = stored(open_.groupBy("key").agg(F.collect_list(F.struct("h", "form", "at")).alias("wanted")).withColumnRenamed("key", "_k"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            h, f, at, data = [], [], [], []
            for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in asked:
                    lo, hi = window(len(text), x["at"], length, gram)
                    h.append(x["h"])
                    f.append(x["form"])
                    at.append(x["at"] - lo)
                    data.append(text[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(f, pa.binary()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["h", "form", "at", "window"])

    windows = rows.filter("first").join(few(wanted, "wanted"), F.col("key") == F.col("_k")).select("text", "wanted").mapInArrow(cut, "h long, form binary, at int, window binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[int] = []
        names: list[bytes] = []
        data: list[bytes] = []
        places: list[int] = []
        held, mark, last, seen = 0, 0, None, set()

        def answer() -> pa.RecordBatch:
            if len(data) > 1 and group[0] == group[-1] and held > LARGE_BYTES:
                starts = repeated_by_begin(places, data, length, gram)
            else:
                starts = repeated_starts(np.array(group, np.int64).view(np.uint64), np.array(places, np.int64), data, length, gram)
            out = pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(names, pa.binary()), pa.array([_spans(s, length).tolist() for s in starts], pa.list_(pa.int32()))], names=["h", "form", "inside"])
            group.clear(), names.clear(), data.clear(), places.clear()
            return out

        for b in batches:
            for h, f, at, w in zip(*(c.to_pylist() for c in b.columns)):
                if h != last:
                    # a hash is never cut: it joins what is held, or stands alone if it is large
                    if group and (held >= SHARD_BYTES or group[0] == group[-1] and held > LARGE_BYTES):
                        yield answer()
                        held = 0
                    mark, last, seen = len(group), h, set()
                elif mark and held > LARGE_BYTES:
                    rest = group[mark:], names[mark:], data[mark:], places[mark:]
                    for x in (group, names, data, places):
                        del x[mark:]
                    yield answer()
                    for x, y in zip((group, names, data, places), rest):
                        x.extend(y)
                    held, mark = sum(map(len, data)), 0
                if f not in seen:
                    seen.add(f)
                    group.append(h)
                    names.append(f)
                    places.append(at)
                    data.append(w)
                    held += len(w)
        if group:
            yield answer()

    inside = stored(windows.repartition("h").sortWithinPartitions("h").mapInArrow(search, "h long, form binary, inside array<int>").filter("size(inside) > 0"))
    both = form.select("h", "form", "n").join(inside, ["h", "form"], "left").filter("n > 1 OR inside IS NOT NULL")
    hits = found.join(both, ["h", "form"]).groupBy("key").agg(F.collect_list(F.struct("at", "n", "inside")).alias("hits"))
    kept = rows.filter("first").select(F.col("key").alias("_k"), F.octet_length("text").alias("bytes"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                pairs = []
                for x in hits:
                    lo, hi = window(n, x["at"], length, gram)
                    # a window that occurs twice repeats as a whole, and so do all its strings
                    pairs += [(lo, hi)] if x["n"] > 1 else [(lo + x["inside"][k], lo + x["inside"][k + 1]) for k in range(0, len(x["inside"]), 2)]
                spans: list[int] = []
                for lo, hi in sorted(pairs):
                    if spans and lo <= spans[-1]:
                        spans[-1] = max(spans[-1], hi)
                    else:
                        spans += [lo, hi]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["key", "spans"])

    return stored(hits.join(kept, F.col("key") == F.col("_k")).select("key", "bytes", "hits").mapInArrow(merge, "key binary, spans array<int>"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id, text); with
    with_text also the text that is left, as bytes.

    Every byte goes that lies in a string of length bytes that begins at two places or more, in one
    text or in several. A null text is empty. Rows with equal texts, repeated rows among them, repeat
    each other. Null ids keep their rows apart like any others. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), b.column(1)], names=["doc_id", "key", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", text_of().cast("binary").alias("text"))
    rows = base.mapInArrow(keyed, f"doc_id {kind}, key binary, text binary")
    sizes = base.withColumn("n", F.octet_length("text")).filter(F.col("n") >= length).drop("n").mapInArrow(keyed, f"doc_id {kind}, key binary, text binary")
    copies = stored(sizes.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).filter("copies > 1").withColumnRenamed("key", "_c"))
    marked = sizes.join(bounded(copies, MAX_HASHES), F.col("key") == F.col("_c"), "left").select("key", "text", (F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).alias("first"))
    spans = repeated_spans(marked, length, gram)
    whole = copies.select(F.col("_c").alias("_k"), F.array().cast("array<int>").alias("spans"))
    removed = stored(spans.join(copies, F.col("key") == F.col("_c"), "left_anti").select(F.col("key").alias("_k"), "spans").unionByName(whole))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out, texts = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [0, len(text)] if spans == [] else spans or []
                bounds = [0, *spans, len(text)]
                left = b"".join(text[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2))
                out.append((len(text), len(text) - len(left), len(spans) // 2, hashlib.sha256(left).hexdigest()))
                texts.append(left)
            columns = [b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())] if with_text else columns, names=[*names, "kept"] if with_text else names)

    joined = rows.join(few(removed, "spans"), F.col("key") == F.col("_k"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
