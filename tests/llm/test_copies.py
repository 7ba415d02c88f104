"""Near copies against all pairs, with null and repeated ids."""

from __future__ import annotations

import random

import pytest

from framewright.llm import copies

from .test_duplicates import roots


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_kept(rows, percent=80):
    """Ids of the first rows of all components by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = roots(len(rows), near)
    return {min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)}, len(set(group)), len(near)


def edited(rng, words, count):
    words = list(words)
    for i in rng.sample(range(len(words)), count):
        words[i] = f"e{rng.randrange(10**6)}"
    return words


def test_every_similarity_up_to_the_limit(spark):
    """Pairs planted at each number of changed words; each pair has a base of its own."""
    rng, rows = random.Random(8), []
    for changed in range(1, 11):
        for _ in range(12):
            base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
            rows += [" ".join(base), " ".join(edited(rng, base, changed))]
    rows = list(enumerate(rows))
    want, count, near = plain_kept(rows)
    got = {r["doc_id"] for r in copies.one_of_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert 20 < near < 120 and got == {i for _, i in want}


def test_one_large_group(spark, monkeypatch):
    """Edits of one text, of which most are no near copies of each other, and a third of all rows one text."""
    monkeypatch.setattr(copies, "GROUP", 64)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(edited(rng, base, rng.choice((0, 1, 1, 2, 2, 2, 3)))) for _ in range(300)] + [" ".join(base)] * 200
    rows = list(enumerate(rows))
    want, count, near = plain_kept(rows)
    got = {r["doc_id"] for r in copies.one_of_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i for _, i in want}


@pytest.mark.parametrize("tile", [1024, 8])
def test_all_pairs_within_the_limit(spark, monkeypatch, tile):
    monkeypatch.setattr(copies, "GROUP", tile)
    rng, rows = random.Random(3), []
    common = [f"c{i}" for i in range(30)]
    for b in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 120))]
        rows.append(" ".join(base + common[: b % 31]))
        for _ in range(4):
            own = [f"e{rng.randrange(10**6)}" if rng.random() < rng.choice((0.02, 0.04)) else w for w in base]
            rows.append(" ".join(own + common[: b % 31]))
    rows = [(i, t) for i, t in enumerate(rows)] + [(900, ""), (901, None), (902, "a few words"), (903, "A few\nwords")]
    want, count, near = plain_kept(rows)
    got = copies.one_of_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert near > 100 and len(got) == count and {(r["doc_id"] is None, r["doc_id"]) for r in got} == want


def test_null_and_repeated_ids_only_choose(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (1, text("b")), (2, text("c")), (2, text("d")), (2, text("d")), (None, text("e")), (None, text("e") + " more")]
    got = copies.one_of_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in got) == [(0, "a"), (0, "e"), (1, "b"), (2, "c"), (2, "d")]
    named = spark.createDataFrame([("x", text("a")), ("y", text("a")), ("z", text("b"))], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in copies.one_of_copies(named).collect()) == ["x", "z"]


def test_stage_keeps_what_no_fingerprint_links(spark, sf):
    import corpus_pipeline as cp

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(None, text("a"), "en", "s", 1), (2, text("c"), "en", "s", 1), (2, text("d"), "en", "s", 1)]
    assert cp.one_of_near_copies(spark, spark.createDataFrame(rows, schema), sf).count() == 3


def test_no_documents(none):
    assert copies.one_of_copies(none).collect() == []
