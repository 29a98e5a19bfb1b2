"""The pipeline and its dedup stages against brute force, with repeated and null ids."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from brandloom.llm import mixing, quality

SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(80)) for _ in range(12)]
    out = [(k, t, "a" if k % 2 else "b", "en") for k, t in enumerate(texts[:8])]
    out += [out[1], out[1], (1, texts[8], "a", "en"), (20, texts[1], "b", "en"), (20, texts[1], "b", "en")]  # repeated rows, an id of two texts
    out += [(None, texts[9], "a", "en")] * 2 + [(None, texts[2], "a", "en"), (None, texts[10], None, "en"), (None, texts[10] + " tail", "a", "en")]
    return out + [(2, texts[2] + " more", "a", "en"), (30, texts[3] + " more", "b", "en"), (31, None, "a", "en"), (None, "", "a", "en")]


def exact(rows):
    best = {}
    for x in rows:
        t = x[1] or ""
        if t not in best or (x[0] is not None, x[0] or 0) > (best[t] is not None, best[t] or 0):
            best[t] = x[0]
    return Counter((i, t) for t, i in best.items())


def near(rows):
    sets, group = [], list(range(len(rows)))
    for x in rows:
        w = (x[1] or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    best = {}
    for k, g in enumerate(group):
        best.setdefault(g, []).append((rows[k][0] is None, rows[k][0] or 0))
    return Counter(None if none else i for none, i in map(min, best.values()))


def test_exact_stage_keeps_one_row(spark, rows):
    got = corpus_pipeline.exact_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert Counter((x.doc_id, x.text or "") for x in got.collect()) == exact(rows) and got.columns == ["doc_id", "text", "source", "lang"]


def test_near_stage_keeps_one_row(spark, rows):
    some = [x for x in dict.fromkeys(rows) if x[1]]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(some, SCHEMA).repartition(3), "")
    assert Counter(x.doc_id for x in got.collect()) == near(some) and got.columns == ["doc_id", "text", "source", "lang"]


def test_run(spark, rows, tmp_path, monkeypatch):
    """All stages in a row; the classifier and the mix are replaced by all rows, as they have tests of their own."""
    monkeypatch.setattr(quality, "accepted", lambda docs, labels: docs)
    monkeypatch.setattr(mixing, "mixed", lambda docs: docs)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = near([(i, t) for i, t in exact(rows)])
    assert Counter(x[0] for x in got) == want
    own = {(len(sp.encode(t)), hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()) for t in {x[1] or "" for x in rows}}
    assert {(x[1], x[2]) for x in got} <= own


def test_stages_keep_columns_whose_names_clash(spark, rows):
    some = [(*x, k, "k", "i", "s", "r") for k, x in enumerate(dict.fromkeys(x for x in rows if x[1]))]
    docs = spark.createDataFrame(some, SCHEMA + ", _row int, _kept string, _id string, sha string, _number string").repartition(3)
    for stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates, corpus_pipeline.mix_sources):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert {tuple(x) for x in got.collect()} <= set(some) and got.count() > 0
