"""Mixture-controlled packing: deficit round-robin over source queues fills each sequence.

Each source is a queue of documents in the order of their rows. A queue earns credit by its
weight, and one token is served each time its credit, less what it was served, is half a token:
of the tokens that are due, the one that was due first comes next, ties to the earlier queue. So
each sequence takes from each queue what its weight is worth, and the fraction of a token that is
left, or owed, is carried to the next sequence. What a queue was served before a sequence, and so
its deficit there, follows from the number of tokens before that sequence alone (`Service`).
Thus no task waits for another: a task knows where its documents stand in their queues, from the
number of tokens in the tasks before it, and cuts them where the sequences end. The token ids
are stored once, and never shuffled.

Sequences have `size` tokens. What is left at the end is cut into sequences of descending powers
of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from brandloom.llm.common import bounded, stored, text_of

SLICE_BYTES = 4 << 20  # of text encoded together
REMEMBERED_WORDS, REMEMBERED_IDS = 500_000, 4_000_000  # in a worker's table, emptied when full
SLICE_TOKENS = 1 << 20  # of one queue cut together
MAX_BASES = 500_000  # rows (part, source, count) sent to all tasks; more are joined by a shuffle


# Kinds of bytes, for boundaries at which a pre-tokenizer that tells letters, digits and
# other signs apart always cuts: letter to digit or sign, and digit or sign (but for an apostrophe) to letter.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = 1, 2, 3, 4, 0
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _APOSTROPHE if chr(_c) == "'" else _SIGN
    _LOWER[_c] = ord(chr(_c).lower())
_CUT = np.zeros(32, bool)
for _x, _y in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_DIGIT, _LETTER), (_SIGN, _LETTER), (_DIGIT, _SIGN), (_SIGN, _DIGIT)):
    _CUT[_x * 5 + _y] = True


def plain_words(texts: pa.Array, special: str) -> pa.Array:
    """The words of each text (a list array) between ASCII white space and, but where a text has
    `special` in it, in lower case and cut between letters and other signs."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    kind = _KIND[data]
    cut = np.append(_CUT[kind[:-1] * 5 + kind[1:]], False) if len(data) else np.zeros(0, bool)
    cut[offsets[1:][offsets[1:] > 0] - 1] = False
    lower = _LOWER[data]
    odd = pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    if odd.any():
        odd = np.repeat(odd, np.diff(offsets))
        cut &= ~odd
        lower = np.where(odd, data, lower)
    at = np.flatnonzero(cut) + 1
    offsets += np.searchsorted(at, offsets)
    whole = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.insert(lower, at, 0x20))])
    return pc.ascii_split_whitespace(whole)


class WordEncoder:
    """The tokenizers library behind a bounded table of words.

    For tokenizers that lower the case, drop white space and cut between letters, digits and
    other signs, so that a text's ids are those of its words; others are refused. Each distinct
    word of a slice is looked up once. Unknown words of letters alone go to the library many in a
    text, as each ends with an id that ends a word; others one by one.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(definition)
        vocabulary, suffix = self.library.get_vocab(), json.loads(definition)["model"].get("end_of_word_suffix")
        self.special = os.path.commonprefix([t.content for t in self.library.get_added_tokens_decoder().values()]) or "<|"
        probe = [self.library.encode(x, add_special_tokens=False).ids for x in ("AB\n\t cd ", "ab", "cd", "x1(Y),it's 2z", "x 1 ( y ), it 's 2 z")]
        if not suffix or probe[0] != probe[1] + probe[2] or probe[3] != probe[4]:
            raise ValueError("only tokenizers that lower the case, drop white space and encode each word alone are supported")
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, and the end of each; nothing if one is not a single word to the library."""
        found = self.library.encode_batch_fast([" ".join(words[k : k + 200]) for k in range(0, len(words), 200)], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], self.dtype)
        ends = np.flatnonzero(self.final[ids]) + 1
        return (ids, ends) if len(ends) == len(words) else None

    def learn(self, new: pa.Array) -> None:
        words = new.to_pylist()
        letters = np.array([w.isalpha() for w in words], bool)
        plain = [w for w in words if w.isalpha()]
        found = self._joined(plain) if plain else None
        if found is None:
            letters[:], plain, found = False, [], (np.empty(0, self.dtype), np.empty(0, np.int64))
        rest = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast([w for w, x in zip(words, letters) if not x], add_special_tokens=False)]
        added = np.concatenate([found[0], *rest])
        ends = np.concatenate([found[1], len(found[0]) + np.cumsum([len(x) for x in rest], dtype=np.int64)])
        order = pa.array(np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)]))
        self.words = pa.concat_arrays([self.words, new.take(order)])
        self.ids = np.concatenate([self.ids, added])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, end_id after each, and the number of each."""
        if len(self.words) > REMEMBERED_WORDS or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        words = plain_words(texts, self.special)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, self.words)
        if at.null_count:
            self.learn(distinct.filter(at.is_null()))
            at = pc.index_in(distinct, self.words)
        at = at.to_numpy()
        begin, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = length[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin[code] - ends[:-1], n) + np.arange(ends[-1])]
        stop = ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        return np.insert(ids, stop, end_id), np.diff(stop, prepend=0) + 1


_LOADED: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(definition)
    return _LOADED[key]


def slices(b: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about size bytes of a column of texts or bytes, a row at least."""
    ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < b.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield b.slice(begin, end - begin)
        begin = end


class Service:
    """How many tokens of each queue deficit round-robin has served after n tokens.

    Token j of a queue of weight w is due at (j + 1/2) / w, as a double; all tokens are served in
    order of (due, queue, j). So served(n) is found from n alone: a queue has about the same
    credit as the others, which gives it but for some tokens, and these are put right one by one.
    """

    def __init__(self, totals: Sequence[int], weights: Sequence[float], size: int):
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.float64)
        if not (self.weights > 0).all():
            raise ValueError("weights must be above 0")
        dry = self.totals / self.weights  # the time at which a queue is empty
        self.times = np.unique(np.concatenate([[0.0], dry]))
        self.counts = np.array([np.minimum(self.totals, t * self.weights).sum() for t in self.times])
        n, self.size = int(self.totals.sum()), size
        self.full, rest = divmod(n, size)  # sequences of the whole size, and what follows them
        self.tail = self.full * size + np.cumsum([0] + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1])
        self.last = self.full + len(self.tail) - 1

    def begin(self, k: np.ndarray) -> np.ndarray:
        """Tokens before sequence k."""
        return np.where(k < self.full, k * self.size, self.tail[np.clip(k - self.full, 0, len(self.tail) - 1)])

    def _due(self, j: np.ndarray) -> np.ndarray:
        return (j + 0.5) / self.weights

    def served(self, n: np.ndarray) -> np.ndarray:
        """A row for each of n, a column for each queue."""
        n = np.asarray(n, np.int64)
        t = np.interp(n, self.counts, self.times)
        q = np.clip(np.floor(t[:, None] * self.weights + 0.5).astype(np.int64), 0, self.totals)
        open_, last = np.arange(len(n)), len(self.weights) - 1
        while len(open_):
            x = q[open_]
            ahead = np.where(x < self.totals, self._due(x), np.inf)  # due next
            behind = np.where(x > 0, self._due(x - 1), -np.inf)  # served last
            add, drop, rows = ahead.argmin(1), last - behind[:, ::-1].argmax(1), np.arange(len(open_))
            short = n[open_] - x.sum(1)
            a, b = ahead[rows, add], behind[rows, drop]
            wrong = (short == 0) & ((b > a) | (b == a) & (drop > add) & np.isfinite(a))
            more, less = (short > 0) | wrong, (short < 0) | wrong
            q[open_[more], add[more]] += 1
            q[open_[less], drop[less]] -= 1
            open_ = open_[more | less]
        return q

    def near(self, queue: int, j: np.ndarray) -> np.ndarray:
        """All sequences, and one more, in which ascending tokens j of a queue may lie, ascending."""
        m = len(self.weights) + 1  # a token's place is known but for so many
        place = np.interp((j + 0.5) / self.weights[queue], self.times, self.counts)
        low = np.clip((place - m).astype(np.int64) // self.size, 0, self.last)
        high = np.clip((place + m).astype(np.int64) // self.size + 1, 0, self.last)
        k = np.concatenate([np.unique(low + d) for d in range(int((high - low).max()) + 1)])
        if high.max() >= self.full:
            k = np.concatenate([k, np.arange(self.full, self.last + 1)])
        return np.unique(np.minimum(k, self.last))

    def pieces(self, queue: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents from `at` on, of n tokens, of a queue, ascending: for each piece the document
        (its place in `at`), start, length, sequence and offset."""
        j = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        k = self.near(queue, j)
        q = self.served(self.begin(k))
        mine = q[:, queue]
        cuts = np.unique(np.concatenate([at, at + n, mine]))
        doc = np.searchsorted(at, cuts, side="right") - 1
        inside = (doc >= 0) & (cuts < (at + n)[doc])
        end = np.append(cuts[1:], 0)[inside]
        begin, doc = cuts[inside], doc[inside]
        row = np.searchsorted(mine, begin, side="right") - 1
        before = (q[row + 1, :queue] - q[row, :queue]).sum(1)
        return doc, begin - at[doc], end - begin, k[row], before + begin - mine[row]


def _by_code_point(sources: list[str | None]) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, src, part, before, n, ids for each row of docs, stored: its ids with the end id as
    little-endian integers, and the tokens of its source before it in its part."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", F.col("source").cast("string").alias("src"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = _encoder(definition.value), TaskContext.get().partitionId(), {}
        for c in (c for b in batches for c in slices(b, 2, SLICE_BYTES)):
            ids, counts = encoder.encode(c.column(2), end_id)
            before = []
            for s, n in zip(c.column(1).to_pylist(), counts.tolist()):
                before.append(done.get(s, 0))
                done[s] = before[-1] + n
            ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([part] * len(counts), pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), data], names=["doc_id", "src", "part", "before", "n", "ids"])

    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, src string, part long, before long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096, weights: Sequence[float] | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text, source) in sequences of `size` tokens: doc_id, source, start,
    length, doc_tokens, sequence_id, offset, sequence_length and ids (little-endian unsigned
    32-bit integers), a row for each piece.

    weights go to the sources in turn by code point, null last; without any, a source weighs as
    much as it has tokens, so that all queues run dry together and each sequence mixes like the
    whole. A queue that runs dry leaves its share to the others. A null or empty text has the end
    id only; rows with the same or no doc_id are packed each for itself; an empty table has no
    pieces; other columns are not read. Queues are in the order of the rows as they are read, so
    reruns over the same files agree. The plan has a row for each source on the driver, as the
    caller gives a weight for each.
    """
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer_path, end_id)
    parts = stored(rows.groupBy("src", "part").agg(F.sum("n").alias("n")))
    totals = {r["src"]: r["n"] for r in parts.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    sources = _by_code_point(list(totals))
    weigh = [totals[s] if weights is None else weights[k % len(weights)] for k, s in enumerate(sources)]
    plan = spark.sparkContext.broadcast((sources, [totals[s] for s in sources], weigh))
    base = F.sum("n").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = stored(parts.select(F.col("src").alias("s"), F.col("part").alias("p"), F.coalesce(base, F.lit(0)).alias("base")))
    at = rows.join(bounded(bases, MAX_BASES), F.col("src").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "src", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, totals, weigh = plan.value
        service, index = Service(totals, weigh, size) if sources else None, {s: k for k, s in enumerate(sources)}
        for c in (c for b in batches for c in slices(b, 4, 2 * SLICE_TOKENS)):
            queue = np.array([index[s] for s in c.column(1).to_pylist()])
            at, n = c.column(2).to_numpy(), c.column(3).to_numpy()
            found = []
            for k in np.unique(queue):
                mine = np.flatnonzero(queue == k)
                mine = mine[np.argsort(at[mine])]
                doc, *rest = service.pieces(int(k), at[mine], n[mine])
                found.append((mine[doc], *rest))
            doc, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc))  # the pieces follow each other as the ids do
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            ids = np.frombuffer(b"".join(c.column(4).to_pylist()), f"<u{len(c.column(4)[0].as_py()) // int(n[0])}").astype("<u4")
            ends = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
            own = pa.array(doc)
            room = service.begin(sequence + 1) - service.begin(sequence)
            yield pa.RecordBatch.from_arrays(
                [c.column(0).take(own), c.column(1).take(own), *(pa.array(x, pa.int64()) for x in (start, length, n[doc], sequence, offset, room)), data],
                names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return at.mapInArrow(run, f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, sequence_length and ids of each sequence; pieces as pack() gives them.

    The one shuffle that packing needs where whole sequences are wanted; a group is one sequence.
    """
    inside = pieces.groupBy("sequence_id").agg(F.first("sequence_length").alias("sequence_length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return inside.select("sequence_id", "sequence_length", joined.alias("ids"))


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with an unsigned crc32 of their ids in place of them."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
