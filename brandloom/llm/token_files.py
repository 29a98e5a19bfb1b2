"""Token-id files: documents encoded, compressed one by one with a shared dictionary, and indexed.

Format. A folder has two Parquet tables. dictionary: one row, hash (sha-256, hex) and bytes of a
zstandard dictionary trained on serialized id arrays. blocks: rows of up to BLOCK_DOCS documents
in ascending doc_id order, block (part, seq) by block:
  part, seq     place of the block in the whole order
  dictionary    hash of the dictionary its frames need
  doc_ids       the documents, in order
  n_tokens      number of ids of each, with the end id
  ends          offset index: end of each document's frame in payload
  payload       one zstandard frame a document: its ids as little-endian integers of `width` bytes
So one short document is read with its own frame and the dictionary alone. Spark writes the
files, with its commit protocol, to any store; nothing is left on an executor.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from brandloom.llm.common import bounded, text_of

BLOCK_DOCS = 256
BLOCK_IDS = 1 << 20  # a block ends after so many ids
DICTIONARY_BYTES = 32 << 10
SAMPLE_DOCS = 2_000  # documents whose ids train the dictionary, about
SAMPLE_BYTES = 8 << 10  # of each
MAX_BLOCKS = 1_000_000
REMEMBERED, REMEMBERED_IDS = 500_000, 4_000_000  # parts in a worker's table, and their ids, about
SLICE_BYTES = 4 << 20  # of text encoded together

# Kinds of bytes. Lead bytes under which white space outside ASCII lies do not surely begin a visible character.
_OTHER, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _HIGH, _BLANK, _BREAK = range(8)
_KIND, _BEGINS = np.zeros(256, np.uint8), np.zeros(256, bool)
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SIGN if chr(_c) != "'" else _APOSTROPHE
_KIND[0x80:], _KIND[0x20], _KIND[0x09:0x0E] = _HIGH, _BLANK, _BREAK
_BEGINS[0x21:0x7F] = _BEGINS[0xC3:0xF5] = True
_BEGINS[0xE1:0xE4] = False
# By kind of a byte and of the next one: 1 where a token always ends between, 2 where it does unless the first ends white space.
_PAIR = np.zeros(64, np.uint8)
for _x in (_LETTER, _DIGIT, _SIGN):
    _PAIR[[_x * 8 + _y for _y in (_LETTER, _DIGIT, _SIGN) if _y != _x]] = 1
for _x in (_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _HIGH):
    _PAIR[[_x * 8 + _BLANK, _x * 8 + _BREAK]] = 2 if _x == _HIGH else 1


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts (one after the other, between offsets) are cut into parts that are encoded alone.

    A byte-level pre-tokenizer ends a token at each stretch of white space that follows a visible
    character, and looks ahead no further than the character after the stretch; a single line
    break or tab between visible characters is a token of its own, and no token holds both letters
    and digits, or one of these before another sign. Other white space than that of
    ASCII is never cut at, nor what follows it.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, np.uint8)
    cut[1:-1] = _PAIR[kind[:-1] * 8 + kind[1:]]
    at = np.flatnonzero(cut == 2)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    cut[at[blank]] = 0
    after = np.flatnonzero((kind == _BREAK) & (cut[:-1] > 0)) + 1
    after = after[after < len(data)]
    cut[after[_BEGINS[data[after]]]] = 1
    cut[offsets] = 1
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizers library behind a bounded table of what stands between white space.

    For byte-level tokenizers with their usual pattern and without a prefix space: the ids of a
    text are those of its parts (see `_cuts`). Each distinct part of some texts is looked up once.
    Unknown parts of one space and a word go to the library many in a text, as a token that
    begins with a space begins each; others one by one. Texts that hold a special token go to the
    library whole. The table is emptied when it is full.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        steps = json.loads(definition)
        before = steps.get("pre_tokenizer") or {}
        if steps.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level tokenizers with the usual pattern and no prefix space are supported")
        self.library = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.parts = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words with a space before each, and the end of each; nothing if a token that begins with a space does not begin each."""
        found = self.whole(["".join(words[k : k + 200]) for k in range(0, len(words), 200)])
        ids = np.concatenate(found)
        begins = np.flatnonzero(self.spaced[ids])
        return (ids, np.append(begins[1:], len(ids))) if len(begins) == len(words) else None

    def learn(self, new: pa.Array) -> None:
        """Bring parts into the table."""
        parts = new.to_pylist()
        single = np.array([p[0] == " " and p[1:].split() == [p[1:]] for p in parts], bool)
        words = [p for p, x in zip(parts, single) if x]
        found = self.joined(words) if words else None
        if found is None:
            single[:], found = False, (np.empty(0, self.dtype), np.empty(0, np.int64))
        rest = self.whole([p for p, x in zip(parts, single) if not x])
        ends = np.concatenate([found[1], len(found[0]) + np.cumsum([len(x) for x in rest], dtype=np.int64)])
        order = pa.array(np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)]))
        self.parts = pa.concat_arrays([self.parts, new.take(order)])
        self.ids = np.concatenate([self.ids, found[0], *rest])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, serialized."""
        if len(self.parts) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():
            out = np.empty(len(texts), object)
            out[special] = [x.tobytes() for x in self.whole(texts.filter(pa.array(special)).to_pylist())]
            out[~special] = self._parted(texts.filter(pa.array(~special)))
            return out.tolist()
        return self._parted(texts)

    def _parted(self, texts: pa.Array) -> list[bytes]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return [b""] * len(texts)
        cuts = _cuts(data, offsets)
        coded = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        at = pc.index_in(coded.dictionary, self.parts)
        if at.null_count:
            self.learn(coded.dictionary.filter(at.is_null()))
            at = pc.index_in(coded.dictionary, self.parts)
        at = at.to_numpy()
        begin, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = length[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin[code] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stop = (ends[np.searchsorted(cuts, offsets)] * self.width).tolist()
        return [ids[a:b] for a, b in zip(stop, stop[1:])]


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of a column of texts, a row at least."""
    sizes, begin, size = pc.binary_length(b.column(column)).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if size and size + n > SLICE_BYTES:
            yield b.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    if begin < b.num_rows:
        yield b.slice(begin)


_LOADED: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(definition)
    return _LOADED[key]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or, where the samples are too few to train one, their own bytes."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> None:
    """Encode docs (doc_id, text), append end_id to each and write the files to a new folder.

    A null text counts as empty: its document has the end id only. Rows with a null doc_id come
    first; rows with the same doc_id stand side by side, by a hash of their text. An empty table
    gives an empty dictionary and no blocks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", text_of().alias("text"))
    every = max(1, rows.count() // SAMPLE_DOCS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples = _encoder(definition.value), []
        for b in batches:
            for c in _slices(b, 0):
                samples += [data[:SAMPLE_BYTES] for data in encoder.encode(c.column(0))]
        raw = train_dictionary(samples)
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw], pa.binary())], names=["hash", "bytes"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).repartition(1).sortWithinPartitions("doc_id", "text").select("text")
    sample.mapInArrow(train, "hash string, bytes binary").write.parquet(f"{folder}/dictionary")
    raw = read_dictionary(spark, folder)
    name, raw = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(definition.value), TaskContext.get().partitionId(), 0
        dictionary = _dictionary(raw.value)
        zstd = zstandard.ZstdCompressor(level=3, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=3)
        end = encoder.packed([end_id])
        ids, counts, ends, frames = [], [], [], []

        def block(id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([encoder.width]), pa.array([b"".join(frames)], pa.binary()), pa.array([sum(counts)])],
                names=["part", "seq", "dictionary", "doc_ids", "n_tokens", "ends", "width", "payload", "total"],
            )

        for c in (c for b in batches for c in _slices(b, 1)):
            id_type = c.schema.field(0).type
            for i, data in zip(c.column(0).to_pylist(), encoder.encode(c.column(1))):
                data += end
                frames.append(zstd.compress(data))
                ids.append(i)
                counts.append(len(data) // encoder.width)
                ends.append((ends[-1] if ends else 0) + len(frames[-1]))
                if len(ids) >= BLOCK_DOCS or sum(counts) >= BLOCK_IDS:
                    yield block(id_type)
                    seq, ids, counts, ends, frames = seq + 1, [], [], [], []
        if ids:
            yield block(id_type)

    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = f"part long, seq long, dictionary string, doc_ids array<{kind}>, n_tokens array<long>, ends array<long>, width long, payload binary, total long"
    ordered.mapInArrow(pack, schema).write.parquet(f"{folder}/blocks")


def read_dictionary(spark, folder: str) -> bytes:
    """The dictionary, checked against its hash; empty if there were no documents to train it on."""
    found = spark.read.parquet(f"{folder}/dictionary").first()
    if found is None:
        return b""
    raw = bytes(found["bytes"])
    if hashlib.sha256(raw).hexdigest() != found["hash"]:
        raise ValueError("the dictionary does not have the hash that names it")
    return raw


def document_ids(block: dict, k: int, dictionary: bytes) -> np.ndarray:
    """The ids of the k-th document of a block, from its own frame alone."""
    d = _dictionary(dictionary)
    zstd = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    begin = block["ends"][k - 1] if k else 0
    return np.frombuffer(zstd.decompress(block["payload"][begin : block["ends"][k]]), f"<u{block['width']}")


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files.

    start counts the ids of all documents before it. Totals of the parts (one number for each
    partition that wrote) are summed on the driver, those of blocks within their part.
    """
    raw = spark.sparkContext.broadcast(read_dictionary(spark, folder))
    name = hashlib.sha256(raw.value).hexdigest()
    blocks = spark.read.parquet(f"{folder}/blocks")
    before, bases = 0, []
    for r in blocks.groupBy("part").agg(F.sum("total").alias("n")).orderBy("part").collect():
        bases.append((r["part"], before))
        before += r["n"]
    bases = spark.createDataFrame(bases, "p long, base long")
    inner = F.coalesce(F.sum("total").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "seq", inner.alias("inner"), "total").join(F.broadcast(bases), F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("base") + F.col("inner")).alias("start"))
    rows = blocks.join(bounded(starts, MAX_BLOCKS), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("dictionary", "doc_ids", "n_tokens", "ends", "width", "payload", "start")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(raw.value)
        zstd = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
        for b in batches:
            for hash_, ids, counts, ends, width, payload, start in zip(*b.columns):
                if hash_.as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                data, begin, crcs, starts, at, n = payload.as_py(), 0, [], [], start.as_py(), counts.as_py()
                for end, count in zip(ends.as_py(), n):
                    x = np.frombuffer(zstd.decompress(data[begin:end]), f"<u{width.as_py()}")
                    if len(x) != count:
                        raise ValueError("a frame does not have the ids that its index tells")
                    crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                    starts.append(at)
                    at, begin = at + count, end
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(unpack, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
