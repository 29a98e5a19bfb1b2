"""Packing, centroid clustering and resampling against brute force, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brandloom.llm import centroids, mixing, packing, resampling

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n int, at long, s string, _at long, _row string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéßD日0-'") for _ in range(r.randint(1, 7))) for _ in range(200)]
    out = [(i, "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", ". ", "\t\t"]) for _ in range(r.randint(0, 160))), r.choice(["a", "a", "b", "é", None])) for i in range(80)]
    out += [(80, None, "a"), (81, "", None), (82, " \n ", "b"), (None, "no id <|endoftext|> here", "b"), (None, "no id <|endoftext|> here", "b"), (83, "x" * 5_000, "tiny"), (84, "ΑΣ Σ é ́x \x00   y's 🙂", "b"), (3, out[3][1], out[3][2])]
    return [(*x, 7, 8, "clash", 9, "clash") for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def served_in_order(totals, weights):
    """One token after the other: the queue whose next token was due first, ties to the earlier queue."""
    heap = [(0.5 / w, k, 0) for k, (t, w) in enumerate(zip(totals, weights)) if t]
    heapq.heapify(heap)
    while heap:
        _, k, j = heapq.heappop(heap)
        yield k
        if j + 1 < totals[k]:
            heapq.heappush(heap, ((j + 1.5) / weights[k], k, j + 1))


@pytest.mark.parametrize("seed", range(12))
def test_service_equals_one_token_after_the_other(seed):
    r = random.Random(seed)
    m = r.choice([1, 2, 3, 7, 40])
    totals = [r.choice([1, 2, r.randint(1, 60), r.randint(1, 900)]) for _ in range(m)]
    weights = totals if seed % 2 else [r.choice([1, 2, 3, 0.01, 5.5]) for _ in range(m)]
    service = packing.Service(totals, weights, 16)
    order = list(served_in_order(totals, weights))
    counts = np.zeros((len(order) + 1, m), np.int64)
    for n, k in enumerate(order):
        counts[n + 1] = counts[n]
        counts[n + 1, k] += 1
    assert (service.served(np.arange(len(order) + 1)) == counts).all()
    if seed % 2:  # every sequence mixes like the whole, to a token for each queue
        share = np.array(totals) / sum(totals)
        assert (abs(counts - np.arange(len(order) + 1)[:, None] * share) <= 1 + m / 2).all()
    ends = [int(x) for x in service.begin(np.arange(service.last + 1))]
    sizes = np.diff(ends)
    assert ends[0] == 0 and ends[-1] == len(order) and all(x == 16 or x & (x - 1) == 0 and x < 16 for x in sizes)


def by_token(rows, order, tokenizer, weights, size):
    """Pieces by walking all tokens. order: rows as they stand in the queues."""
    queues = defaultdict(list)
    for i in order:
        ids = tokenizer.encode(rows[i][1] or "", add_special_tokens=False).ids + [2]
        queues[rows[i][2]] += [(i, j, x) for j, x in enumerate(ids)]
    sources = sorted(queues, key=lambda s: (s is None, s or ""))
    totals = [len(queues[s]) for s in sources]
    weigh = totals if weights is None else [weights[k % len(weights)] for k in range(len(sources))]
    served = list(served_in_order(totals, weigh))
    bounds, left = [], len(served)
    while left >= size:
        bounds.append(size)
        left -= size
    bounds += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    taken, out, done = [0] * len(sources), [], 0
    for number, room in enumerate(bounds):
        count, offset = Counter(served[done : done + room]), 0
        done += room
        for k, s in enumerate(sources):
            part = queues[s][taken[k] : taken[k] + count[k]]
            taken[k] += count[k]
            begin = 0
            for t in range(1, len(part) + 1):
                if t == len(part) or part[t][0] != part[begin][0]:
                    ids = [x for _, _, x in part[begin:t]]
                    out.append((part[begin][0], part[begin][1], len(ids), number, offset + begin, ids))
                    begin = t
            offset += len(part)
    return out


@pytest.mark.parametrize("weights,size", [(None, 64), (None, 4096), ([3, 1, 2], 128)])
def test_packing(spark, rows, weights, size):
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)  # then the queues stand as the rows do
    got = packing.pack(one, WORDS, size=size, weights=weights)
    tokenizer = Tokenizer.from_file(WORDS)
    want = by_token(rows, range(len(rows)), tokenizer, weights, size)
    assert sorted(
        (str(r["doc_id"]), str(r["source"]), r["start"], r["length"], r["sequence_id"], r["offset"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got.collect()
    ) == sorted((str(rows[i][0]), str(rows[i][2]), start, n, k, at, ids) for i, start, n, k, at, ids in want)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(got).collect()}
    assert whole == {k: [x for p in sorted(want, key=lambda p: p[4]) if p[3] == k for x in p[5]] for k in {p[3] for p in want}}


def test_packing_over_parts(docs, rows, none, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 300)  # many slices a task
    monkeypatch.setattr(packing, "SLICE_TOKENS", 100)
    got = packing.packed(docs, WORDS).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():  # gapless, and no padding is needed
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    for (i, ids), times in want.items():
        found = Counter((r["start"], r["length"], r["ids_crc32"]) for r in pieces[i] if r["doc_tokens"] == len(ids))
        for (start, n, crc), _ in found.items():
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
        assert sum(n * c for (_, n, _), c in found.items()) == len(ids) * times
    assert sum(len(ids) * times for (_, ids), times in want.items()) == sum(r["length"] for r in got)
    assert packing.packed(none, WORDS).collect() == [] and packing.sequences(packing.pack(none, WORDS)).collect() == []


def test_packing_mixes_each_sequence(spark):
    rows = [(i, "word " * 300, "big" if i % 5 else "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for weights, share in ((None, 0.2), ([1, 1], 0.5)):
        got = defaultdict(Counter)
        for r in packing.pack(docs, WORDS, size=256, weights=weights).collect():
            got[r["sequence_id"]][r["source"]] += r["length"]
        full = [c for _, c in sorted(got.items()) if sum(c.values()) == 256]
        early = full[: len(full) // 3]  # before a queue runs dry
        assert all(abs(c["small"] - 256 * share) <= 2 for c in (full if weights is None else early))


def test_word_encoder_equals_the_library():
    r = random.Random(0)
    texts = ["", "  ", " a", "It's (x)!?…, don't 'S", "Σ ΑΣ éx 1́ ≮ a≮", "<|ENDOFTEXT|> Ab,c<|endoftext|>", "\x1c a\x1cb \x85 \xa0x\u3000y", "İI ﬁ Å K", "가나 가x", "٣x9"]
    texts += ["".join(r.choice("aB1',.é́…日<| \n(ſ") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    with open(WORDS, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    for _ in range(2):  # with an empty table and a filled one
        ids, n = encoder.encode(pa.array(texts).slice(1), 7)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [encoder.library.encode(t, add_special_tokens=False).ids + [7] for t in texts[1:]]


def test_mixed_rows_keep_columns_whose_names_clash(spark):
    rows = [(i, "a b c", "s" if i % 2 else None, i, 2, "x", "y", "z") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, whole int, cut int, _s string, _times string, _doc string")
    taken = {r["doc_id"]: r["taken"] // 3 for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.select("doc_id", "whole", "_s").collect()) == sorted((i, i, "x") for i, n in taken.items() for _ in range(n))


def brute_clusters(vectors, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    z = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(z))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(z)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                z[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = Counter()
    for _, c, d in found:
        total[c] += d
    return [(i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, d in found]


def test_clusters(spark):
    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    vectors = [(i, [x + r.gauss(0, 0.2) for x in base[i % 4]]) for i in range(120)]
    vectors += [(i, base[0]) for i in range(120, 150)] + [(7, base[1]), (None, base[2]), (None, base[3])]  # one hot vector, repeated and null ids
    vectors += [(200, None), (201, []), (202, base[0][:63]), (203, base[0] + [0.0]), (204, [None] + base[0][1:]), (205, [math.nan] + base[0][1:]), (206, [math.inf] + base[0][1:])]
    schema = "vec_id long, embedding array<double>, v string, cluster string, distance string"
    frame = spark.createDataFrame([(*x, "a", "b", "c") for x in vectors], schema).repartition(3)
    got = centroids.clustered(frame, rounds=3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(vectors, 8, 3)))
    few = spark.createDataFrame([(1, base[0]), (2, base[0]), (3, base[1])], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in centroids.clustered(few, rounds=2).collect()) == sorted(brute_clusters([(1, base[0]), (2, base[0]), (3, base[1])], 8, 2))
    empty = centroids.clustered(frame.limit(0))
    assert empty.collect() == [] and empty.dtypes == got.dtypes


def test_prefix_crcs_give_the_crc_of_each_run():
    r = random.Random(2)
    texts = ["", "one", "Two  words", " a-b_c d ", "é" * 400 + " x " + "y" * 5000 + " z", "".join(r.choice("aBc é,9日 ") for _ in range(3000))]
    bucket, counts, words = resampling.features([t.encode() for t in texts], 1 << 32, 3)
    at = 0
    for t, n, w in zip(texts, counts, words):
        found = WORD.findall(lower(t))
        want = [zlib.crc32(" ".join(found[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(found) - k + 1)]
        assert w == len(found) and bucket[at : at + n].tolist() == want
        at += n


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_resample(docs, target, percent, least):
    def buckets(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, bs in own for b in bs), Counter(b for x in target for b in buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, bs in own:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in bs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def test_resampling(spark, docs, rows, none):
    target = [rows[5][1], rows[6][1] + " more of it", None, ""]
    aim = spark.createDataFrame([(t, 1, "clash") for t in target], "text string, doc_id int, features string")
    for percent in (25, 100):
        got = sorted(map(str, (tuple(x) for x in resampling.resample(docs, aim, percent=percent).collect())))
        assert got == sorted(map(str, brute_resample([x[:2] for x in rows], target, percent, 20)))
    assert resampling.resample(none, aim).collect() == []
    got = sorted(map(str, (tuple(x) for x in resampling.resample(docs, aim.limit(0)).collect())))
    assert got == sorted(map(str, brute_resample([x[:2] for x in rows], [], 25, 20)))
