"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, removed string, media string, fp long, times long, host string"
WORDS = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()


def make_rows(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    texts: list[str | None] = [" ".join(word() for _ in range(rng.randint(3, 150))) for _ in range(n)]
    passage = " ".join(word() for _ in range(70))
    texts[3] = f"{texts[3]} {passage} {texts[4]}"
    texts[7] = f"{texts[8]} {passage}\n{texts[9]}"
    texts[10] = texts[11]
    words = (texts[13] or "").split() + [word() for _ in range(400)]
    texts[13] = " ".join(words)
    texts[14] = " ".join([*words[:200], "changed", *words[201:]])
    texts[20], texts[21], texts[22], texts[23] = None, "", "  \n\t ", "123 !! ..."
    texts[24] = " ".join(word() for _ in range(6000))
    texts[25] = "ünïcödé 日本語 𠮷 " * 3
    texts[26] = "x" * 5000
    texts[27] = "A"
    rows = [(i, t, ("en", "de", None)[i % 3], (None if i % 11 == 0 else f"s{i % 4}"), len(t or ""), 0.5, 1, "r", "m", 9, 7, "h") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a text of no id", "en", "s1", 3, 0.5, 1, "r", "m", 9, 7, "h"), (None,) * 12]
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
