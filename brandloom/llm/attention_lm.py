"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

A word enters the model as the mean of its subword embeddings. One layer of masked attention over
the last WINDOW words gives a distribution over word classes: the last subword of a word names its
class, so endings and function words have classes of their own. Within its class a word has its
share of the class's count, less what the words that occur once say of unseen ones; all unseen
words are one type, as in the base score. Windows overlap by half, and each token is scored once,
in the first window that sees enough before it.

Counts cover all training texts. The FREQUENT most frequent words (a bounded list) go to the tasks;
what a text holds besides is joined with the counts by word. The model is trained by every task on
consecutive windows that cover all words of its training texts, and averaged row by row, ROUNDS times.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import stored, text_of

WINDOW, STRIDE, DIM, CLASSES = 32, 16, 16, 64
END = 0
FREQUENT = 150_000
ROUNDS = 2
RATE = 0.15
FLUSH = 300_000  # words a task counts before it hands them on
BATCH = 64  # windows in a training step
CHUNK = 128  # windows scored together: so few that they stay in a core's cache
READ = 64 * BATCH  # windows that are laid out together
READ_COLUMNS = ["words", "lengths", "subwords"]


def held_out(doc_id: Column, parts: int = 7, left_out: int = 2) -> Column:
    """Whether the crc32 of the id as text leaves the remainder that is not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == left_out


def words_in(text: bytes) -> list[bytes]:
    """Lower-case words of a UTF-8 text (bytes know A-Z and the six ASCII spaces only)."""
    return text.lower().split()


class Lexicon:
    """Frequent words with their subwords and classes."""

    def __init__(self, model: bytes, words: list[bytes], counts: np.ndarray):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.sp.get_piece_size()
        self.index = {w: k for k, w in enumerate(words)}
        self.counts = counts.astype(np.float64)
        own = self.pieces(words)
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.flat = np.array([i for x in own for i in x], np.int64)
        last = np.array([x[-1] for x in own], np.int64) if own else np.empty(0, np.int64)
        mass = np.bincount(last, self.counts, self.size)
        self.of_piece = np.full(self.size, 1, np.int64)
        self.of_piece[np.argsort(-mass, kind="stable")[: CLASSES - 2]] = np.arange(2, CLASSES)
        self.word_class = self.of_piece[last] if len(last) else last

    def pieces(self, words: list[bytes]) -> list[list[int]]:
        return [x or [0] for x in self.sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)] if words else []

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], list[bytes]]:
        """Index of each word of the texts in a row (new ones count on from the frequent words); classes by
        index; lengths and flat subwords of the new words; the new words."""
        index, new, base = self.index, {}, len(self.counts)
        at = np.array([index[w] if w in index else new.setdefault(w, base + len(new)) for t in texts for w in t], np.int64)
        own = self.pieces(list(new))
        lengths = np.array([len(x) for x in own], np.int64)
        flat = np.array([i for x in own for i in x], np.int64)
        cls = np.concatenate([self.word_class, self.of_piece[np.array([x[-1] for x in own], np.int64)]])
        return at, cls, (lengths, flat), list(new)


Read = tuple[np.ndarray, np.ndarray, np.ndarray]  # of a text: index of each word (new ones count on from the frequent words), lengths and flat subwords of its new words


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def read_texts(lexicon: Lexicon, texts: list[list[bytes]]) -> list[tuple[Read, list[bytes], np.ndarray, np.ndarray]]:
    """What is read of each text; its new words, how often it has them and their classes."""
    at, cls, (lengths, flat), new = lexicon.read(texts)
    starts, base, n, out = np.cumsum(lengths) - lengths, len(lexicon.counts), 0, []
    for t in texts:
        x = at[n : n + len(t)]
        n += len(t)
        is_new = x >= base
        rare, where, times = np.unique(x[is_new], return_inverse=True, return_counts=True)
        x, own = x.copy(), lengths[rare - base]
        x[is_new] = base + where
        out.append(((x, own, flat[_spans(starts[rare - base], own)]), [new[k] for k in (rare - base).tolist()], times, cls[rare]))
    return out


def _merged(lexicon: Lexicon, reads: list[Read]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each word of the texts in a row, classes by index, lengths and flat subwords of the new words of all."""
    none, base = np.empty(0, np.int64), len(lexicon.counts)
    at, lengths, flat = (np.concatenate([none, *(r[k] for r in reads)]) for k in range(3))
    more = np.array([len(r[1]) for r in reads], np.int64)
    at += np.where(at >= base, np.repeat(np.cumsum(more) - more, [len(r[0]) for r in reads]), 0)
    return at, np.concatenate([lexicon.word_class, lexicon.of_piece[flat[np.cumsum(lengths) - 1]]]), lengths, flat


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))


def _from_lists(columns: list[pa.Array]) -> list[Read]:
    split = []
    for c in columns:
        ends = c.offsets.to_numpy() - c.offsets[0].as_py()
        split.append(np.split(c.flatten().to_numpy().astype(np.int64), ends[1:-1]) if len(c) else [])
    return list(zip(*split))


def _means(table: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Mean embedding of each word."""
    if not len(lengths):
        return np.empty((0, DIM), np.float32)
    return np.add.reduceat(table[flat], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None].astype(np.float32)


def fresh(size: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(3)

    def some(*shape: int) -> np.ndarray:
        return (r.standard_normal(shape) * 0.2).astype(np.float32)

    return {"E": some(size + 1, DIM), "P": some(WINDOW, DIM), "Q": some(DIM, DIM), "K": some(DIM, DIM), "V": some(DIM, DIM), "O": some(DIM, CLASSES), "b": np.zeros((1, CLASSES), np.float32)}


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def _rows(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def forward(m: dict[str, np.ndarray], x: np.ndarray, lo: int = 0) -> tuple[np.ndarray, ...]:
    """x: windows of word vectors. Attention, its result and the class logits, from place lo of each window on."""
    x = x + m["P"]
    n = len(x)
    kv = (_rows(x) @ np.concatenate([m["K"], m["V"]], axis=1)).reshape(n, WINDOW, 2 * DIM)
    k, v = kv[..., :DIM], kv[..., DIM:]
    own = np.ascontiguousarray(x[:, lo:]) if lo else x
    q = (_rows(own) @ m["Q"]).reshape(own.shape)
    a = (q * np.float32(DIM**-0.5)) @ k.transpose(0, 2, 1)
    a += _MASK[lo:]
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    h = a @ v
    h += own
    z = (_rows(h) @ m["O"]).reshape(*h.shape[:2], CLASSES)
    z += m["b"]
    return x, q, k, v, a, h, z


def _summed(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at, ascending, and the sum of the rows of values at each."""
    order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(values[order], begin, axis=0)


def step(m: dict[str, np.ndarray], seen: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, real: np.ndarray, lengths: np.ndarray, flat: np.ndarray, place: np.ndarray) -> None:
    """One Adagrad step. place: which word (of lengths, flat) stands at each position of x."""
    xp, q, k, v, a, h, p = forward(m, x)
    p = _rows(p)
    p -= p.max(-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(-1, keepdims=True)
    p[np.arange(len(p)), target.ravel()] -= 1
    p *= (real.ravel()[:, None] / max(1, real.sum())).astype(np.float32)
    dh2 = p @ m["O"].T
    dh = dh2.reshape(h.shape)
    da = dh @ v.transpose(0, 2, 1)
    da -= (dh * (h - xp)).sum(-1, keepdims=True)  # h - xp is a @ v, so this is (da * a).sum(-1)
    da *= a
    da *= np.float32(DIM**-0.5)
    dq, dk, dv = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
    d, xr = np.concatenate([_rows(dq), _rows(dk), _rows(dv)], axis=1), _rows(xp)
    dx = dh2 + d @ np.concatenate([m["Q"], m["K"], m["V"]], axis=1).T
    into = xr.T @ d
    grads = {"O": _rows(h).T @ p, "b": p.sum(0, keepdims=True), "P": dx.reshape(x.shape).sum(0), "Q": into[:, :DIM], "K": into[:, DIM : 2 * DIM], "V": into[:, 2 * DIM :]}
    for name, g in grads.items():
        seen[name] += g * g
        m[name] -= RATE * g / np.sqrt(seen[name] + 1e-8)
    word = np.zeros((len(lengths), DIM), np.float32)
    at, sums = _summed(dx, place.ravel())
    word[at] = sums
    word /= lengths[:, None].astype(np.float32)
    piece, g = _summed(np.repeat(word, lengths, axis=0), flat)
    own = seen["E"][piece] + g * g
    seen["E"][piece] = own
    m["E"][piece] -= RATE * g / np.sqrt(own + 1e-8)


def train_on(m: dict[str, np.ndarray], lexicon: Lexicon, texts: Iterator[bytes]) -> tuple[np.ndarray, int]:
    return train_on_reads(m, lexicon, (read_texts(lexicon, [words_in(t)])[0][0] for t in texts))


def train_on_reads(m: dict[str, np.ndarray], lexicon: Lexicon, reads: Iterator[Read]) -> tuple[np.ndarray, int]:
    """Train in place on consecutive windows that cover all words of each text and its end. Rows of E touched, windows."""
    seen = {k: np.zeros_like(v) for k, v in m.items()}
    touched, windows = np.zeros(lexicon.size + 1, bool), 0

    def learn(texts: list[tuple[Read, bool]], end: bool) -> list[tuple[Read, bool]]:
        """Steps on all full batches, and on the rest at the end; else gives the texts of the rest, from there on.

        A text that has its begin has an input and a target more than words; of one without, the first word is an input only."""
        nonlocal windows
        begins = np.array([b for _, b in texts])
        words = np.array([len(r[0]) for r, _ in texts], np.int64)
        at, cls, new_lengths, new_flat = _merged(lexicon, [r for r, _ in texts])
        lengths = np.concatenate([[1], lexicon.lengths, new_lengths])  # word 0 is the begin of a text and padding
        flat = np.concatenate([[lexicon.size], lexicon.flat, new_flat])
        starts = np.cumsum(lengths) - lengths
        size = words + begins
        first = np.cumsum(size) - size
        inputs, targets = np.zeros(size.sum(), np.int64), np.full(size.sum(), END)
        is_word, goes_on, aimed = np.ones(len(inputs), bool), np.ones(len(inputs), bool), np.ones(len(at), bool)
        is_word[first[begins]] = False
        inputs[is_word] = at + 1
        goes_on[first + size - 1] = False
        aimed[(np.cumsum(words) - words)[~begins]] = False
        targets[goes_on] = cls[at[aimed]]
        n = -(-size // WINDOW)
        text = np.repeat(np.arange(len(texts)), n)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        stop = len(text) if end else len(text) // BATCH * BATCH
        for lo in range(0, stop, BATCH):
            t = text[lo : min(stop, lo + BATCH)]
            pos = begin[lo : lo + len(t), None] + np.arange(WINDOW)
            real = pos < size[t][:, None]
            pos = first[t][:, None] + np.minimum(pos, size[t][:, None] - 1)
            used, place = np.unique(np.concatenate([[0], np.where(real, inputs[pos], 0).ravel()]), return_inverse=True)
            place, own = place[1:].reshape(real.shape), lengths[used]
            pieces = flat[_spans(starts[used], own)]
            step(m, seen, _means(m["E"], own, pieces)[place], np.where(real, targets[pos], 0), real, own, pieces, place)
            touched[pieces] = True
            windows += len(t)
        if stop == len(text):
            return []
        t, b = text[stop], begin[stop]
        (own, *new), whole = texts[t]
        return [((own[max(0, b - whole) :], *new), whole and b == 0), *texts[t + 1 :]]

    waiting, n = [], 0
    for r in reads:
        waiting.append((r, True))
        n += len(r[0]) // WINDOW + 1
        if n >= READ:
            waiting = learn(waiting, False)
            n = sum(-(-(len(r[0]) + b) // WINDOW) for r, b in waiting)
    if waiting:
        learn(waiting, True)
    return np.flatnonzero(touched), windows


def score_all(m: dict[str, np.ndarray], lexicon: Lexicon, reads: list[Read]) -> np.ndarray:
    """log10 probability of each text's classes."""
    at, cls, lengths, flat = _merged(lexicon, reads)
    table = np.concatenate([m["E"][lexicon.size][None], lexicon.means, _means(m["E"], lengths, flat)])
    sizes = np.array([len(r[0]) for r in reads], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # where a text's inputs begin, with the begin mark
    inputs = np.zeros(int(sizes.sum() + len(reads)), np.int64)
    target = np.zeros_like(inputs)
    is_word = np.ones(len(inputs), bool)
    is_word[first] = False
    inputs[is_word] = at + 1
    target[first + sizes] = END
    ends = np.zeros(len(inputs), bool)
    ends[first + sizes] = True
    target[~ends] = cls[at]
    out = np.zeros(len(inputs))
    # windows of a text begin every STRIDE tokens; all but the first score their second half
    n_windows = 1 + np.maximum(0, -(-(sizes + 1 - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(reads)), n_windows)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * STRIDE
    for lo, some in ((0, np.flatnonzero(begin == 0)), (WINDOW - STRIDE, np.flatnonzero(begin))):
        for c in range(0, len(some), CHUNK):
            t, b = text[some[c : c + CHUNK]], begin[some[c : c + CHUNK]]
            pos = b[:, None] + np.arange(WINDOW)
            real = pos <= sizes[t][:, None]
            flat_pos = first[t][:, None] + np.minimum(pos, sizes[t][:, None])
            z = _rows(forward(m, table[inputs[flat_pos]], lo)[-1])
            where = flat_pos[:, lo:].ravel()
            z -= z.max(-1, keepdims=True)
            own = z[np.arange(len(z)), target[where]]
            np.exp(z, out=z)
            own = (own - np.log(z.sum(-1))) / np.log(10)
            fresh_here = real[:, lo:].ravel()
            out[where[fresh_here]] = own[fresh_here]
    return np.add.reduceat(out, first) if len(reads) else np.empty(0)


def _counts(rows: DataFrame) -> DataFrame:
    """word (UTF-8), c: counts of all words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])
            count.clear()
            return out

        for b in batches:
            for t in b.column(0):
                count.update(words_in(t.as_py()))
                if len(count) > FLUSH:
                    yield flush()
        if count:
            yield flush()

    return stored(rows.filter("NOT _out").select("_text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


_LOADED: dict[str, tuple] = {}


def _loaded(name: str, make) -> tuple:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = make()
    return _LOADED[name]


def scores(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text).

    Tokens are the lower-case words and one end. A null or empty text has the end alone. Without
    training texts the base score is 0 and the model untrained. Rows that repeat are scored
    alike; a null doc_id counts as empty text. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("_out"), text_of().cast("binary").alias("_text"))
    counts = _counts(rows)
    ends = rows.filter("NOT _out").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, floor = total["n"] + ends, total["n"] + ends + total["v"] + (ends > 0) + 1
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    words, known = top.column("word").to_pylist(), top.column("c").to_numpy()
    size = sentencepiece.SentencePieceProcessor(model_proto=model.value).get_piece_size()
    frequent = spark.sparkContext.broadcast((words, known))

    def lexicon() -> Lexicon:
        name = hashlib.sha256(frequent.value[1].tobytes() + b" ".join(frequent.value[0])).hexdigest()
        return _loaded(name, lambda: Lexicon(model.value, *frequent.value))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, n, once = lexicon(), np.zeros(CLASSES), np.zeros(CLASSES)
        for b in batches:
            last = [x[-1] for x in lex.pieces(b.column(0).to_pylist())]
            cls, c = lex.of_piece[np.array(last, np.int64)], b.column(1).to_numpy()
            n += np.bincount(cls, c, CLASSES)
            once += np.bincount(cls, c == 1, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(once)], names=["cls", "n", "once"])

    found = {r["cls"]: r for r in counts.mapInArrow(classes, "cls long, n double, once double").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()}
    in_class = np.array([found[k]["n"] if k in found else 0.0 for k in range(CLASSES)])
    unseen = np.array([(found[k]["once"] if k in found else 0.0) + 0.5 for k in range(CLASSES)]) / (in_class + 1)
    unseen = np.minimum(unseen, np.where(in_class > 0, 0.95, 1.0))  # what a class leaves to unseen words
    of_one = (1 - unseen) / np.maximum(1, in_class)  # what it gives a word for each time it occurs

    base_of_known = np.log10((known + 1) / floor)
    base_end = float(np.log10((ends + 1) / floor))
    known_base = spark.sparkContext.broadcast(base_of_known)
    kind = rows.schema["doc_id"].dataType.simpleString()
    plain = f"_row long, doc_id {kind}, held_out boolean, n_tokens long, n_often long, base double, "

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part, k = lexicon(), TaskContext.get().partitionId(), 0
        base = known_base.value
        within = np.log10(np.maximum(of_one[lex.word_class] * lex.counts, 1e-300))
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("cls", pa.int64())]))
        for b in batches:
            texts, ids, outs = b.column(2), b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 200):
                own = read_texts(lex, [words_in(t.as_py()) for t in texts[lo : lo + 200]])
                often = [x[x < len(base)] for (x, _, _), *_ in own]
                rare = [[{"word": w, "n": n, "cls": c} for w, n, c in zip(new, times.tolist(), cls.tolist())] for _, new, times, cls in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 36) + k + j for j in range(len(own))]), ids[lo : lo + 200], outs[lo : lo + 200], pa.array([len(r[0]) + 1 for r, *_ in own], pa.int64()), pa.array([len(x) for x in often], pa.int64()), pa.array([float(base[x].sum()) for x in often], pa.float64()), pa.array([float(within[x].sum()) for x in often], pa.float64())]
                    + [_lists([r[j] for r, *_ in own]) for j in range(3)] + [pa.array(rare, rare_type)],
                    names=["_row", "doc_id", "held_out", "n_tokens", "n_often", "base", "within", *READ_COLUMNS, "rare"],
                )
                k += len(own)

    # Words are looked up and cut into subwords once, for the rounds and the scores.
    texts = stored(rows.mapInArrow(read, plain + "within double, words array<int>, lengths array<int>, subwords array<int>, rare array<struct<word:binary,n:long,cls:long>>"))
    weights = fresh(size)
    for _ in range(ROUNDS):
        weights = _round(spark, texts, lexicon, weights)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, m = lexicon(), shared.value
        lex.means = _means(m["E"], lex.lengths, lex.flat)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                score = score_all(m, lex, _from_lists(b.columns[7:])) + b.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(score, pa.float64())], names=[*b.schema.names[:6], "score"])

    scored = texts.drop("rare").mapInArrow(run, plain + "score double")
    # Words beyond the frequent ones are joined by word: none of them is hot.
    rare = texts.select("_row", F.explode("rare").alias("x")).select("_row", "x.word", "x.n", "x.cls").join(counts, "word", "left")
    by_class = [F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("cls").cast("int")) for values in (of_one, unseen)]
    share = F.log10(F.when(F.col("c").isNotNull(), F.col("c") * by_class[0]).otherwise(by_class[1]))
    rare = rare.groupBy("_row").agg(F.sum(F.col("n") * share).alias("more_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor)))).alias("more_base"))
    out = scored.join(rare, "_row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(base_end)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _round(spark, texts: DataFrame, lexicon, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every task trains on its training texts from the same weights; rows are averaged by windows."""
    shared = spark.sparkContext.broadcast(weights)
    names = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = {k: v.copy() for k, v in shared.value.items()}
        touched, windows = train_on_reads(m, lexicon(), (r for b in batches for r in _from_lists(b.columns)))
        if windows:
            for j, name in enumerate(names):
                at = touched if name == "E" else np.arange(len(m[name]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j)), pa.array(at), pa.array(np.full(len(at), float(windows))), pa.array([r.astype(np.float64) * windows for r in m[name][at]], pa.list_(pa.float64()))], names=["part", "row", "n", "sums"])

    out = texts.filter("NOT held_out").select(*READ_COLUMNS).mapInArrow(run, "part long, row long, n double, sums array<double>")
    flat = out.select("part", "row", "n", F.posexplode("sums").alias("col", "x")).groupBy("part", "row", "col").agg((F.sum("x") / F.sum("n")).alias("x"))
    found = flat.toArrow()
    new = {k: v.copy() for k, v in weights.items()}
    part, row, col, x = (found.column(c).to_numpy() for c in ("part", "row", "col", "x"))
    for j, name in enumerate(names):
        own = part == j
        new[name][row[own], col[own]] = x[own]
    return new
