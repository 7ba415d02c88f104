"""Decontamination against a plain scan, by broadcast and by shuffle."""

from __future__ import annotations

import re

import pytest

from framewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain_scan(texts, items, n):
    grams = {}
    for i, text in items:
        w = plain_words(text)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[tuple(w[k : k + size])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def items(rows):
    t = [r[1] for r in rows]
    return [(1, " ".join(t[3].split()[5:40])), (2, t[8]), (3, "ÜNÏCÖDÉ 日本語"), (10, None), (11, ""), (12, " .!"), (None, t[24][:400]), (None, "A"), (2, t[9]), (7, t[24][:400].upper()), (7, "the of and to in is that it for was")]


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("n", [3, 10])
def test_scan(spark, docs, rows, items, small, n):
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs, tests, n=n, keep=["doc_id", "text"], small=small).collect()
    got = sorted(((r["doc_id"], r["text"], r["n_words"], sorted(r["covered"]), r["items"]) for r in found), key=repr)
    want = sorted(((r[0], r[1], *x) for r, x in zip(rows, plain_scan([r[1] for r in rows], items, n), strict=True)), key=repr)
    assert got == want
    assert any(r[3] for r in got)


def test_removal(spark, docs, rows, items):
    tests = spark.createDataFrame(items, "item_id long, text string")
    cut = decontaminate.decontaminate(docs, tests)
    assert cut.columns == docs.columns
    found = plain_scan([r[1] for r in rows], items, 10)
    want = []
    for r, (_, hit, _) in zip(rows, found, strict=True):
        text, hit = r[1], set(hit)
        if hit:
            at, out = 0, ""
            for i, m in enumerate(WORD.finditer(text)):
                out += "" if i in hit else text[at : m.end()]
                at = m.end()
            text = out + text[at:]
        want.append((r[0], text, *r[2:]))
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(want, key=repr)
    left = decontaminate.decontaminate(docs, tests, "documents")
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r, x in zip(rows, found, strict=True) if not x[1]), key=repr)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, tests, "all")


def test_empty(spark, docs, none):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert {(len(r["covered"]), len(r["items"])) for r in decontaminate.scan(docs, tests).collect()} == {(0, 0)}
    assert decontaminate.scan(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert decontaminate.decontaminate(docs, tests).count() == docs.count()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x one two three y", 5, "z")], "doc_id long, text string, n_words int, items string")
    tests = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.scan(docs, tests).first().asDict() == {"doc_id": 1, "text": "x one two three y", "n_words": 5, "covered": [1, 2, 3], "items": ["1"]}
    assert tuple(decontaminate.decontaminate(docs, tests).first()) == (1, "x y", 5, "z")
