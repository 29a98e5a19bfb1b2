"""Operators of the pipeline against brute force, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brandloom.llm import attention_lm, common, divergence, exact_dedup, mixing, near_dup, pieces, quality, substring_dedup, templates, token_files
from brandloom.llm.common import new_folder
from brandloom.llm.suffix_array import permuted_prefixes, suffix_array

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, score double, kept string, n_tokens int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 6))) for _ in range(120)]
    out = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", ". "]) for w in words)
        out.append((i, text, r.choice(["a", "b", None]), "en"))
    for i in range(60, 90):  # copies and near copies
        text = out[r.randint(0, 20)][1]
        out.append((i, text if i % 2 else text + " more words at the end of it", "a", "en"))
    out += [(90, None, "a", None), (91, "", None, "en"), (92, " \n ", "c", "en"), (None, "no id here", "c", "en"), (93, "x" * 30_000, "b", "en"), (94, "<s> ▁ \0 🙂  two", "b", "de")]
    return [(*x, 1.5, "clash", 7) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for k in range(300):
        t = r.integers(0, int(r.integers(1, 5)) + 1, int(r.integers(1, 50))).astype(np.uint8)
        t = np.tile(t, 3) if k % 5 == 0 else t
        b = t.tobytes()
        want, shared = sorted(range(len(b)), key=lambda i: b[i:]), [0] * len(b)
        for x, y in zip(want, want[1:]):
            while max(x, y) + shared[y] < len(b) and b[x + shared[y]] == b[y + shared[y]]:
                shared[y] += 1
        sa = suffix_array(t)
        assert sa.tolist() == want and permuted_prefixes(t, sa).tolist() == shared


def removed(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        yield len(t), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(bytes(x for x, y in zip(t, mark) if not y)).hexdigest()


@pytest.mark.parametrize("shard,large", [(1 << 20, 1 << 21), (200, 400)])
def test_substrings(docs, rows, none, monkeypatch, shard, large):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(substring_dedup, "LARGE_BYTES", large)
    got = Counter(tuple(x) for x in substring_dedup.remove_repeats(docs, 20, 6).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, removed([(r[1] or "").encode() for r in rows], 20)))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substrings_by_shuffle(docs, rows, spark, monkeypatch):
    """Few rows with long lists are no small table; the joins by a shuffle give the same."""
    lists = spark.createDataFrame([(1, [[0, 1]] * 50), (2, [])], "k int, x array<array<int>>")
    assert substring_dedup.few(lists, "x", 51)._jdf.queryExecution().logical().toString().count("Hint") == 0
    assert substring_dedup.few(lists, "x", 52)._jdf.queryExecution().logical().toString().count("Hint") == 1
    assert substring_dedup.few(lists.filter("k > 2"), "x", 0)._jdf.queryExecution().logical().toString().count("Hint") == 1
    monkeypatch.setattr(substring_dedup.few, "__defaults__", (0,))
    got = Counter(tuple(x) for x in substring_dedup.remove_repeats(docs, 20, 6).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, removed([(r[1] or "").encode() for r in rows], 20)))


def test_templates(spark):
    def page(k, body):
        return f'<html><head><title>t{k}</title><script>var a="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy {k}</div>{body}<footer>&copy; x</footer></body></html>'

    pages = [(k, f"http://h.example/{k}", page(k, f"<article><h1>Head {k}</h1><p><b>A &amp; b{k}<br><p>wo<i>rd</i>  \n end</p><section class='comments'>no</section></article>")) for k in range(5)]
    pages += [(k, "http://other.example/", page(k, f"<p>Same notice</p><p>Story {k}</p>")) for k in range(10, 15)] + [(20, None, None), (21, "http://h.example/x", "plain < text")]
    got = {x.page_id: (x.text, x.n_chars) for x in templates.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2][0] == "Head 2 A & b2 word end" and got[11][0] == "Story 11" and got[20] == ("", 0)
    assert all(n == len(t) for t, n in got.values())


def test_templates_inside_main(spark):
    """Notices and menus within the article are found by the template, though not in all pages and with no listed name."""

    def page(k):
        menu = f"<ul><li><a href='/{k}'>Go {k}</a></li></ul>"
        extra = "<div class='k7'>Read our terms</div>" if k != 3 else ""
        return f"<html><body><div class='x'>Top {k}</div><article>{menu}<h2>Head {k}</h2>{extra}{f'<p>Story {k} goes on</p>' * (1 + k % 2)}</article><div>Foot {k}</div></body></html>"

    pages = [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(8, "http://h.example/8", "<html><body><p>No article 8</p></body></html>"), (9, "http://h.example/1", page(1))]
    got = {x.page_id: x.text for x in templates.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {k: f"Head {k}" + f" Story {k} goes on" * (1 + k % 2) for k in range(8)}
    assert got == want | {8: "No article 8", 9: want[1]}


def test_template_names():
    """Names skip whole words only, and neither the page nor its main container nor what holds it."""

    def text(page, main=True):
        return [t for _, t, inside, _, _ in templates.parts(page) if t and (inside or not main)]

    for name in ("single no-sidebar", "sidebar", "with-header-fixed", "search-results", "job-search", "search"):
        for page in ("<html class='{0}'><body><article>Story</article></body></html>", "<body class='{0}'><article>Story</article></body>", "<body><div class='{0}'><main>Story</main></div></body>", "<body><article id='{0}'>Story</article></body>"):
            assert text(page.format(name)) == ["Story"]
    assert text("<body class='sidebar'><p>Story</p><div class='menu'>M</div>", main=False) == ["Story"]
    assert text("<body><form action='/'><p>Story</p><label>Name</label></form><div>Foot</div></body>", main=False) == ["Story", "Foot"]
    for name in ("commentlist", "respond", "x Comments", "ad"):
        assert text(f"<body><article>Story<div class='{name}'>no</div><article class='{name}'>no</article></article></body>") == ["Story"]
    assert text("<body><main>Story</main><div class='sidebar'><article>Teaser</article></div></body>") == ["Story"]


def test_template_slots():
    """Runs nest by position; a run that begins inside another and goes on after it crosses it."""
    classes, sizes, crossed = {1: 7, 2: 7, 3: 8, 4: 8, 5: 0}, {7: 2, 8: 2}, set()
    assert list(templates.slots([1, 9, 3, 9, 4, 9, 2, 9, 5, 9], classes, sizes, crossed)) == [0, 1, 1, 3, 3, 1, 1, 0, 0, 0] and not crossed
    assert list(templates.slots([1, 3, 2, 4], classes, sizes, crossed))[:3] == [0, 1, 3] and crossed == {8}


def test_pieces(docs, rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(x) for x in pieces.encode_decode(docs, PIECES).collect()) == want
    assert pieces.encode_decode(none, PIECES).count() == 0


def test_pieces_of_odd_texts():
    own, sp, r = pieces.Pieces(open(PIECES, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("ab the\n▁ éß日\x85🙂re") for _ in range(r.randint(0, 30)))
        ids = sp.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == sp.decode(ids)


def test_token_files(spark, docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "test")
    token_files.write_tokens(docs, path, folder)
    library, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(x) for x in token_files.read_tokens(spark, folder).collect()), key=lambda x: x[1]) == want
    block = spark.read.parquet(f"{folder}/blocks").orderBy("part", "seq").first().asDict()
    ids = token_files.document_ids(block, 0, token_files.read_dictionary(spark, folder))
    assert len(ids) == block["n_tokens"][0] and ids[-1] == 0
    token_files.write_tokens(none, path, empty := new_folder(spark, "test"))
    assert spark.read.parquet(f"{empty}/blocks").count() == 0


def test_divergence_counts(docs, rows):
    got = {x.doc_id: x for x in divergence.judged(docs).collect()}
    for i, text, *_ in rows:
        text, x = text or "", got[i]
        words = WORD.findall(text)
        count, inside = Counter(zip(words, words[1:], words[2:])), set()
        for k in range(len(words) - 2):
            if count[tuple(words[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert x.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (x.base_failed and x.kept)


def test_leading_tokens():
    """Frequent tokens come last by their counts, so the most frequent head no set that has others."""
    tokens, hot, counts = np.arange(1, 21, dtype=np.uint64), np.array([1, 2, 3, 30], np.uint64), np.array([9, 7, 8, 1])
    n = 20 - 15 + 1 + 1
    assert near_dup.leading(tokens, hot, counts).tolist() == list(range(4, 4 + n))
    assert near_dup.leading(tokens[:4], hot, counts).tolist() == [4, 2]
    assert near_dup.leading(tokens, hot[:0], counts[:0]).tolist() == list(range(1, 1 + n))


def test_near_duplicates(docs, rows, none):
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    least = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), least.get(i)) for i, s in sets.items()}
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_count_all_documents(spark):
    """No document is left out of the counts, however many there are; a token has its documents' number at least."""
    texts = [f"one two three four five{' own%d and more words' % k if k % 3 else ''}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [near_dup.tokens_of(t.encode()) for t in texts]
    counts = near_dup.token_counts(docs)
    assert counts.sum() == sum(map(len, sets))
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    assert n.max() == 300 and (counts[near_dup._buckets(token)] >= n).all()
    assert near_dup.leading(token, None, counts)[0] != token[n.argmax()] and near_dup.token_counts(docs.limit(0)).sum() == 0


@pytest.mark.parametrize("rounds", [3, 0])  # without rounds the matrix finds all links
def test_near_duplicates_at_the_bound(spark, monkeypatch, rounds):
    """Sets of unlike sizes that reach the bound just so, or fail by one token, in one family."""
    r = random.Random(11)
    base = [f"b{k}" for k in range(64)]
    texts = [" ".join(base[lo:hi]) for lo in range(0, 12, 3) for hi in (40, 44, 48, 52, 56, 60, 64)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(64)] = f"x{r.randrange(40)}"
        texts.append(" ".join(w[r.randint(0, 8) : 64 - r.randint(0, 8)]))
    sets = [set(near_dup.tokens_of(t.encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    links = [(a, b) for a in group for b in group if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    if not rounds:
        monkeypatch.setattr(near_dup, "_near", lambda docs, sets: (spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, g long, part long")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs).collect()} == dict(enumerate(group))


def test_near_duplicates_broadcast_no_lists(spark, docs, rows, none, monkeypatch):
    """Lists of ids beyond the bound are never broadcast, and the result is the same."""
    want = {tuple(x) for x in near_dup.near_duplicates(docs).collect()}
    sent = []
    monkeypatch.setattr(common, "FEW_IDS", 0)
    monkeypatch.setattr(common, "FILTER_WORDS", 2)  # most others pass the filter too
    monkeypatch.setattr(common.F, "broadcast", lambda df, f=common.F.broadcast: sent.append(df.count()) or f(df))
    assert {tuple(x) for x in near_dup.near_duplicates(docs).collect()} == want
    assert sent and max(sent) <= 2
    ids, some = spark.range(0, 90, 3).toDF("gone"), docs.select("doc_id", "text")
    got = common.without(some, "doc_id", ids).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], r[1]) for r in rows if r[0] is None or r[0] not in range(0, 90, 3))


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    taken, target, largest = Counter(), {}, max(x["size"] for x in got)
    for x in got:
        assert 0 <= x.taken <= 2 * x["size"]
        key = x.source_size, x.target
        taken[key] += x.taken
    assert all(abs(n - key[1]) <= largest for key, n in taken.items())
    assert sum(k[1] for k in taken) == pytest.approx(1.5 * sum(k[0] for k in taken))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(none).count() == 0
    assert mixing.targets([("a", 10), ("b", 1000), (None, 100)], (3, 1, 2), 1.5, 2.0) == [("a", 20.0), ("b", 1445.0), (None, 200.0)]


def test_attention_base_scores(docs, rows):
    got = attention_lm.scores(docs, PIECES).collect()
    words = [(r[0], lower(r[1]).split(" ") and WORD.findall(lower(r[1]))) for r in rows]
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in words}
    count = Counter(w for i, own in words if not out[i] for w in own)
    ends = sum(not out[i] for i, _ in words)
    n = sum(count.values()) + ends
    by_id = {x.doc_id: x for x in got}
    for i, own in words:
        x = by_id[i]
        base = sum(np.log10((count[w] + 1) / (n + len(count) + 2)) for w in own) + np.log10((ends + 1) / (n + len(count) + 2))
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(own) + 1, sum(w in count for w in own) + 1, n)
        assert x.base_score == pytest.approx(base) and x.score < 0 and np.isfinite(x.score)


def test_attention_trains_on_all_words(monkeypatch):
    """Every word and the end of each text is a target once, with the word before it as input."""
    with open(PIECES, "rb") as f:
        own = attention_lm.Lexicon(f.read(), [b"w%d" % k for k in range(50)], np.ones(50))
    seen, w = Counter(), attention_lm.WINDOW
    monkeypatch.setattr(attention_lm, "step", lambda m, g, x, target, real, *_: seen.update({"targets": int(real.sum()), "ends": int((real & (target == attention_lm.END)).sum())}))
    sizes = [0, 1, w - 1, w, w + 1, 2 * w, 5 * w + 7, 100 * w]
    texts = [b" ".join(b"w%d" % (k % 70) for k in range(n)) for n in sizes]
    touched, windows = attention_lm.train_on(attention_lm.fresh(own.size), own, iter(texts))
    assert seen == {"targets": sum(sizes) + len(sizes), "ends": len(sizes)} and windows == sum(n // w + 1 for n in sizes)
    assert {i for x in own.pieces([b"w%d" % k for k in range(70)]) for i in x} <= set(touched.tolist())


def test_attention_reads_texts_once(monkeypatch):
    """Texts that are read apart give the steps that they give together, wherever a text is cut between layouts; scores hang on no slices."""
    with open(PIECES, "rb") as f:
        own = attention_lm.Lexicon(f.read(), [b"w%d" % k for k in range(50)], np.ones(50))
    r, w = random.Random(3), attention_lm.WINDOW
    texts = [[b"w%d" % r.randrange(90) for _ in range(n)] for n in (0, 3, w, 70 * w + 5, w - 1, 140 * w, 64 * w - 1, 9)]
    reads = [x[0] for x in attention_lm.read_texts(own, texts)]
    for (at, lengths, flat), t in zip(reads, texts):
        new = list(dict.fromkeys(x for x in t if x not in own.index))
        assert len(at) == len(t) and sorted(lengths.tolist()) == sorted(map(len, own.pieces(new))) and (at < 50).tolist() == [x in own.index for x in t]
        places = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
        assert [places[k - 50].tolist() for k in at if k >= 50] == [own.pieces([x])[0] for x in t if x not in own.index]
    got = []
    for size in (1, 65, 10_000):
        monkeypatch.setattr(attention_lm, "READ", size)
        m = attention_lm.fresh(own.size)
        got.append((m, *attention_lm.train_on_reads(m, own, iter(reads))))
    for m, touched, windows in got:
        assert windows == sum(len(t) // w + 1 for t in texts) and touched.tolist() == got[0][1].tolist()
        assert all(np.allclose(m[k], got[0][0][k], atol=1e-4) for k in m)
    own.means = attention_lm._means(m["E"], own.lengths, own.flat)
    whole = attention_lm.score_all(m, own, reads)
    monkeypatch.setattr(attention_lm, "CHUNK", 3)
    assert np.allclose(whole, np.concatenate([attention_lm.score_all(m, own, [x]) for x in reads]), rtol=1e-5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in got]) > 0.95
    clash = docs.withColumnRenamed("source", "_score")
    kept = quality.accepted(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() < docs.count()
    assert {round(x.score, 3) for x in quality.classify(docs.limit(0), labels).collect()} == set()


@pytest.mark.parametrize("bits", [64, 2])  # two bits: identifiers collide until they are wider
def test_exact_duplicates(docs, rows, none, bits):
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", []).append(r[0])
    want = Counter()
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(x) for x in exact_dedup.exact_duplicates(docs, bits=bits, least=4, most=50).collect()) == want
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_token_table_forgets(monkeypatch):
    """A table that is full at each call, long texts, other white space and special tokens change no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = token_files.Encoder(f.read())
    monkeypatch.setattr(token_files, "REMEMBERED", 2)
    texts = ["", " ", "a b\nc", "a b  c", "x\0y z", "end <|endoftext|> here", "tab\tand\n\nline", "é ß 漢字", "word " * 500 + "z", "a b\nc"]
    for k in (1, 3, len(texts)):
        for at in range(0, len(texts), k):
            some = texts[at : at + k]
            assert own.encode(some) == [own.packed(library.encode(t, add_special_tokens=False).ids) for t in some]
    signs = [" ", " ", "\n", "\t", "a", "B", "é", "1", "'", "s", ",", "(", "’", "\u00a0", "\u0085", "\u3000", "\x1c", "\x0b", "\0", "漢", "😀", "Ġ", "<|endoftext|>"]
    r = random.Random(4)
    for k in range(4_000):
        some = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(3)]
        assert own.encode(some) == [own.packed(library.encode(t, add_special_tokens=False).ids) for t in some]
        if k % 500 == 0:
            monkeypatch.setattr(token_files, "REMEMBERED", 1_000)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_files.Encoder(f.read())
    monkeypatch.setattr(token_files, "SLICE_BYTES", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [t for s in token_files._slices(batch, 0) for t in s.column(0).to_pylist()] == texts
