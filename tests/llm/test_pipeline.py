"""The pipeline's stages against brute force, each on its own input, and the whole."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from framewright.llm import mixing

from .test_copies import plain_kept
from .test_duplicates import plain_chunks


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage read and gave."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "", "en", "src1", 0), (10_003, "12 34 !!", None, None, 8), (10_004, "The cat sat on the mat with the hat.", None, None, 36)], docs.schema)
    docs = docs.union(odd)
    folder, out = tmp_path_factory.mktemp("stages"), []
    for i, (name, f) in enumerate(cp.STAGES):
        path = f"file://{folder}/{i}"
        f(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(cols == want for _, _, _, cols in stages[:-1]) and len(stages) == 5


def test_language(stages):
    _, before, after, _ = stages[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {10_001, 10_002, 10_003} <= gone and 10_004 not in gone
    assert len(gone) <= 3 + 0.02 * len(before)


def test_one_of_near_copies(stages):
    _, before, after, _ = stages[1]
    want, count, near = plain_kept([(r["doc_id"], r["text"]) for r in before])
    kept = {r["doc_id"] for r in after}
    assert near and kept == {i for _, i in want} and len(after) == count < len(before)


def test_repeats(stages):
    _, before, after, _ = stages[2]
    got, seen, changed = {r["doc_id"]: r for r in after}, set(), 0
    for r in sorted(before, key=lambda r: r["doc_id"]):
        parts, keep, run, own = plain_chunks(r["text"].encode()), b"", b"", set(seen)
        for p in [*parts, None]:
            if p is not None and p in own:
                run += p
                continue
            keep += run if len(run.split()) < 20 else b""
            run = b""
            if p is not None:
                keep += p
                own.add(p)
        seen |= set(parts)
        x = got[r["doc_id"]]
        assert x["text"].encode() == keep and x["n_chars"] == len(x["text"])
        changed += x["text"] != r["text"]
    assert len(after) == len(before) and changed


def test_mix(stages):
    _, before, after, _ = stages[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, took = defaultdict(int), defaultdict(int)
    for r in before:
        size[r["source"]] += words(r["text"])
    for r in after:
        took[r["source"]] += words(r["text"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([(s, size[s]) for s in order]), strict=True):
        assert abs(took[s] - t) <= max(10, 0.005 * t)  # sources of a few documents here
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    known = {tuple(r) for r in before}
    assert all(tuple(r) in known for r in after)


def test_packing(stages):
    _, before, after, _ = stages[4]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in after) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    ends = Counter()
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(v == 1024 or v & (v - 1) == 0 for v in ends.values())


def test_run(spark, sf):
    got = cp.run(spark, sf)
    assert got.agg(F.sum("length")).first()[0] > 0 and "doc_id" in got.columns
