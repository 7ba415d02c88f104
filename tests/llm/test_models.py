"""Language ID, quality and token counts: plain versions, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from framewright.llm import langid, quality, queries, token_counts
from framewright.llm.common import crc_fold

SF = "/root/testdata/sf0.01"

# ---- language


def plain_phrases(text: str, train: str) -> int:
    known, code, n, i = "".join(map(chr, langid.letters(train))), "".join(map(chr, langid.letters(text))), 0, 0
    while i < len(code):
        j = i
        while j < len(code) and code[i : j + 1] in known:
            j += 1
        i = j + (j < len(code) and code[j] not in known)
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.text("abc dé", min_size=1, max_size=80), st.text("abcé xz", max_size=60), st.sampled_from([1, 2, 3, 7, 512]), st.sampled_from([0, 10**7]))
def test_phrases(train, text, stretch, dense):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "STRETCH", stretch)
        m.setattr(langid, "DENSE", dense)
        _phrases(train, text)


def test_a_large_alphabet_has_no_table():
    train = "".join(chr(0x4E00 + i * 7 % 2600) for i in range(9000))
    m = langid.Model({"zh": train, "en": "the cat sat"})
    assert m.machines[1].table is None and m.machines[0].table is not None
    n, _ = m.phrases([train[100:900] + "the cat", "the cat sat"])
    assert n[0, 1] == plain_phrases(train[100:900] + "the cat", train) and n[1, 0] == 1


def test_a_text_without_letters_needs_no_edges(monkeypatch):
    monkeypatch.setattr(langid, "DENSE", 0)
    _phrases(" ", "")
    _phrases("  ", "abc a")


def _phrases(train, text):
    m = langid.Model({"x": train, "y": "a"})
    n, size = m.phrases([text, "", text * 30])
    assert n[0].tolist() == [plain_phrases(text, train), plain_phrases(text, "a")]
    assert n[1].tolist() == [0, 0] and size[1] == 0
    assert n[2][0] == plain_phrases(text * 30, train)


def test_every_case_has_a_language(docs, none, rows):
    texts = langid.training_text(docs, F.lit(True))
    assert set(texts) == {"en", "de"} and all(len(x) <= langid.TRAIN_CHARS + 1 for x in texts.values())
    got = langid.identify(docs, texts).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) >= {"doc_id", "lang_pred", "score", "bits", "removed"}
    for r in got:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == has and 0 <= r["score"] <= 1 and (r["score"] > 0) == has
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.training_text(none, F.lit(True)) == {} and langid.identify(none, texts).collect() == []


def test_held_out_languages(spark):
    got = queries.op9_cross_parsing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


# ---- quality


def test_words_and_contexts():
    texts = ["The cat, the 12 DOGS", "a"]
    raw = [t.encode() for t in texts]
    bucket, doc = quality.tokens(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0])]))
    assert doc.tolist() == [0] * 6 + [1] and bucket[0] == bucket[3] and len(set(bucket.tolist())) == 6
    alone, _ = quality.tokens(np.frombuffer(b"xx the", np.uint8), np.array([0]))
    assert alone[1] == bucket[0], "a word's bucket does not follow from its place"
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for i in range(7):
        for j in range(max(0, i - quality.WINDOW), min(7, i + quality.WINDOW + 1)):
            if i != j and doc[i] == doc[j]:
                np.add.at(want[bucket[i]], place[bucket[j]], sign[bucket[j]])
    assert np.allclose(quality.contexts(bucket, doc), want)


def test_table_is_the_sum_over_tasks(spark, docs):
    one = quality.word_vectors(docs.coalesce(1))
    assert np.allclose(one, quality.word_vectors(docs.repartition(7)), atol=1e-6)
    assert np.allclose(np.linalg.norm(one, axis=1)[np.abs(one).sum(axis=1) > 0], 1, atol=1e-5)


def test_temperature_and_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + 0.2 * rng.normal(size=600) > 0).astype(int)
    m = quality.Network(x[:400], y[:400], epochs=30)
    p = m.score(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.8 and 0.25 <= m.temperature <= 8 and p.min() >= 0 and p.max() <= 1


def test_odd_labels(spark, docs, none, rows):
    labels = "doc_id long, quality int"
    few = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], labels)
    got = quality.classify(docs, few).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {1.0}
    assert {r["score"] for r in quality.classify(docs, spark.createDataFrame([], labels)).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2) for i in range(30)], labels)
    scores = quality.classify(docs, both).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.classify(none, both).collect() == []


def test_held_out_quality(spark):
    got = queries.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert sum(s >= 0.3 for s in good) >= 0.95 * len(good)


# ---- token counts

VOCAB = [("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁ab", -4.0), ("bb", -1.5), ("▁▁▁", -4.0)]
NONE = "\U0010fffd"


def plain_count(tok, text):
    """Pieces of the tokenizer; an unknown stretch, which is number 0, counts as its bytes."""
    got = tok.encode(text, add_special_tokens=False)
    return sum(1 if i else len(piece.encode()) for i, piece in zip(got.ids, got.tokens, strict=True))


def unigram(vocab):
    tok = Tokenizer(models.Unigram([(NONE, 0.0), *vocab], 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return tok


@settings(max_examples=200, deadline=None)
@given(st.text("ab ▁x", max_size=24))
def test_ties_follow_the_tokenizer(text):
    assert token_counts.Counter(VOCAB).text(text)[0] == plain_count(unigram(VOCAB), text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=24))
def test_pieces_over_words(text):
    vocab = [*VOCAB, ("a▁b", -0.5)]
    assert token_counts.Counter(vocab).text(text)[0] == plain_count(unigram(vocab), text)


def test_counts_of_a_large_vocabulary(docs, none, rows, spark):
    path = P.path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    assert not {"<s>", "<unk>", "<0x0A>"} & {p for p, _ in vocab} and min(s for _, s in vocab) > -11
    tok = unigram(vocab)
    got = token_counts.count_tokens(docs, path).select("doc_id", "text", "n_tokens").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == plain_count(tok, r["text"] or "")
    assert token_counts.count_tokens(none, path).collect() == []
    rng, count = random.Random(1), token_counts.counter(path)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b", "c", "de", "é", "日", " ", "  ", "     ", "\n", "<s>", "<0x0A>", "0", "1", "▁", "𠮷"]) for _ in range(rng.randint(1, 40)))
        assert count.text(t)[0] == plain_count(tok, t)
    assert [count.text(t)[0] for t in ("x<s>y", "x<0x0A>y", "a    b", "tokenization of words", "𠮷" * 3)] == [5, 8, 3, 4, 13]


def test_counts_are_near_those_of_the_merges(spark):
    """The same vocabulary read as merges by its own library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    own = token_counts.counter(P.path("piece_bpe_32k.model"))
    ours, theirs = sum(own.text(t)[0] for t in texts), sum(len(sp.encode(t)) for t in texts)
    assert abs(ours / theirs - 1) < 0.08, (ours, theirs)


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 1000)
    own = token_counts.Counter(VOCAB)
    for i in range(300):
        own.text(f"ab{'b' * (i % 40)} {'a' * 500}")
    assert own.held <= 1100 and max(map(len, own)) <= token_counts.LONGEST


def test_null_ids_have_a_fold(spark, tmp_path):
    """A null doc_id counts as the empty text, whose crc32 is 0: held out by op3, learned from by op9."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, "the cat and the dog", "en", "s", 1), (1, "der Hund und die Katze", "de", "s", 1), (2, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, mod, hit in ((queries.op3_quality, 5, 0), (queries.op9_cross_parsing, 3, 1)):
        got = {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}
        assert got == {i: zlib.crc32(str(i).encode() if i is not None else b"") % mod == hit for i in (None, 1, 2)}


def test_folds(spark):
    got = spark.range(200).select("id", crc_fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
