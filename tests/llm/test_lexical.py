"""Ranked search against a plain count of all scores."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from framewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(rows, items, k):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, length in docs:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    t = [r[1] for r in rows]
    return [(1, t[3]), (2, t[8][:60]), (3, "ÜNÏCÖDÉ 日本語 𠮷"), (4, None), (5, ""), (6, " .!"), (None, "the of THE"), (7, "zzzz unknown"), (1, "which your"), (8, t[24]), (9, "xxx 123")]


@pytest.mark.parametrize(("k", "block_terms", "bucket"), [(10, 200_000, 100_000), (3, 40, 5), (100, 200_000, 7)])
def test_search(spark, docs, rows, items, k, block_terms, bucket):
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(docs, tests, k, block_terms=block_terms, bucket=bucket)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search([r[:2] for r in rows], items, k)


def test_many_copies_and_ties(spark):
    rows = [(i, "alpha beta beta gamma") for i in range(500, 0, -1)] + [(1000 + i, f"alpha w{i} other words here") for i in range(300)] + [(5000, "gamma"), (None, "gamma")]
    items = [(1, "beta gamma"), (2, "alpha"), (3, "gamma")]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(docs, tests, 4, bucket=40).collect()), key=repr) == plain_search(rows, items, 4)


def test_bounds_skip_buckets_and_rows():
    """A bucket of small norms is not looked into; in one that is, only what may reach the k-th best is added."""
    impacts, items = np.array([100, 900, 50, 40, 30], np.int64), [np.array([0, 1])]

    class Seen(lexical.Best):
        added = 0

        def add(self, scores, ids, none):
            Seen.added += len(scores)
            super().add(scores, ids, none)

    rows, terms = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 0, 0, 0])
    norm = np.array([math.hypot(100, 900), 50, 40, 30])
    args = (norm, rows, terms, impacts, items, np.array([1, 1]))
    one = Seen(1, 500)
    lexical._search_bucket(*args, [one], np.arange(4), np.zeros(4, bool))
    assert (one.scores.tolist(), one.ids.tolist(), Seen.added) == ([1000], [0], 1)
    lexical._search_bucket(norm[1:], rows[2:] - 1, terms[2:], impacts[2:], items, np.array([1, 1]), [one], np.arange(3), np.zeros(3, bool))
    assert Seen.added == 1


def test_empty(spark, docs, none):
    no_items, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(docs, no_items).collect() == []
    assert lexical.search(none, some).collect() == []
    assert lexical.search(none, some).columns == lexical.search(docs, some).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs.where("text is null"), some).collect() == []
