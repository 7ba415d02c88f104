"""SimHash, substring dedup and SpotSigs against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import components, queries, simhash, spotsigs, substrings


def plain_simhash(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    to = list(range(n))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint(rows):
    for r in rows:
        assert simhash.simhash(r[1]) == plain_simhash(r[1], 4)


def test_components(docs, rows):
    for radius in (4, 9):
        got = simhash.near_duplicates(docs, k=4, radius=radius).collect()
        assert len(got) == len(rows)
        f = [plain_simhash(r[1], 4) for r in rows]
        group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= radius])
        least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
        want = sorted(((rows[i][0], f[i], least[group[i]]) for i in range(len(rows))), key=repr)
        assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=repr) == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 90), st.integers(1, 6), st.sampled_from([4, 16]))
def test_forest_joins_what_is_near(seed, n, radius, tile):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64), axis=1)
    fp = np.unique(base[rng.integers(0, 4, n)] ^ flips)
    to = simhash.forest(fp, radius, tile)
    near = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius])
    same = roots(len(fp), list(enumerate(to.tolist())))
    assert same == near


def test_large_groups_are_cut_into_tiles(spark):
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64), axis=1))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = simhash.hamming_links(df, radius=4, tile=8, group=16).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    assert all((int(r["a"]) ^ int(r["b"])) & (2**64 - 1) != 0 for r in links)
    near = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4])
    assert roots(len(fp), [(at[r["a"]], at[r["b"]]) for r in links]) == near


@pytest.mark.parametrize("group", [4096, 32])
def test_nearest_links_are_near_and_one_for_each(spark, group):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (12, 2), dtype=np.uint64).repeat(30, axis=0)
    fp[:, 0] ^= np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(fp), 5), dtype=np.uint64), axis=1)
    rows = [(i, *map(int, x)) for i, x in enumerate(fp.view(np.int64))]
    got = simhash.nearest_links(spark.createDataFrame(rows, "node long, fp long, fp2 long"), len(rows), group=group).collect()
    assert len({r["a"] for r in got}) == len(got)
    assert all(np.bitwise_count(fp[r["a"]] ^ fp[r["b"]]).sum() <= 24 for r in got)
    groups = len(set(roots(len(rows), [(r["a"], r["b"]) for r in got])))
    assert 12 <= groups < (36 if group == 4096 else 200)


def test_more_blocks_find_the_same(spark):
    assert [simhash.blocks_to_agree(n) for n in (10, 10**6, 10**10, 10**12)] == [2, 2, 3, 4]
    rng = np.random.default_rng(3)
    fp = np.unique(np.repeat(rng.integers(0, 2**63, 20, dtype=np.uint64), 10) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 2), dtype=np.uint64), axis=1)).view(np.int64)
    df, at = spark.createDataFrame([(int(x),) for x in fp], "fp long"), {int(x): i for i, x in enumerate(fp)}
    two, three = (roots(len(fp), [(at[r["a"]], at[r["b"]]) for r in simhash.hamming_links(df, agree=n).collect()]) for n in (2, 3))
    assert two == three and len(set(two)) == 20


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (90, 90), (7, None)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 1 for i in range(2, 41)}, 100: 90}


def test_no_documents(none):
    assert simhash.near_duplicates(none).collect() == []
    assert substrings.dedup_substrings(none).collect() == []
    assert spotsigs.near_duplicates(none).collect() == []


# ---- substrings


def plain_chunks(raw: bytes) -> list[bytes]:
    """Byte by byte, as the rule says."""
    table = substrings.gear_table()
    out, at, run = [], 0, 0
    for i in range(len(raw)):
        space = raw[i] in b" \t\n\r\x0b\f"
        starts = not space and (i == 0 or raw[i - 1] in b" \t\n\r\x0b\f")
        run = 0 if space or starts else run + 1
        h = 0
        if i >= 16:
            for b in raw[i - 16 : i]:
                h = (2 * h + int(table[b])) & 0xFFFF
            if (starts and h < 65536 // substrings.WORDS) or (run >= substrings.LONG and raw[i] & 0xC0 != 0x80 and h < 65536 // 48):
                out.append(raw[at:i])
                at = i
    return [*out, raw[at:]] if raw else []


def test_chunks(rows):
    for r in rows:
        raw = (r[1] or "").encode()
        if raw and len(raw) < 9000:
            start, _ = substrings.chunks(np.frombuffer(raw, np.uint8), np.array([0]))
            assert [raw[i:j] for i, j in zip(start, [*start[1:], len(raw)], strict=True)] == plain_chunks(raw)
    two = [rows[1][1].encode(), rows[2][1].encode()]
    start, _ = substrings.chunks(np.frombuffer(b"".join(two), np.uint8), np.array([0, len(two[0])]))
    assert len(start) == sum(len(plain_chunks(x)) for x in two)


def test_repeated_passages_go_and_others_stay(docs, rows):
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(docs, min_words=20).collect()}
    seen: set = set()
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        text = next(r[1] for r in rows if r[0] == i)
        parts = plain_chunks((text or "").encode())
        before, keep, run = set(seen), b"", b""
        for p in [*parts, None]:
            if p is not None and p in before:
                run += p
                continue
            words = len(run.split()) if b"x" * 100 not in run else 10**6
            keep += run if words < 20 else b""
            run = b""
            if p is not None:
                keep += p
                before.add(p)
        seen |= set(parts)
        if i != 26:
            assert (got[i]["text"] or "").encode() == keep, i
    assert len(got[7]["removed"]) == 1 and got[7]["removed"][0]["length"] > 200
    assert got[20]["text"] is None and got[21]["text"] == ""


def test_op6_columns(spark, sf):
    df = queries.op6_substring_dedup(spark, sf)
    assert df.count() == 200 and "doc_id" in df.columns


# ---- SpotSigs


def plain_common(texts):
    """Words of most documents."""
    n = Counter(w for t in texts for w in {w for w in re.findall(r"[^\W_]+", (t or "").lower())})
    return {w for w, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[: spotsigs.COMMON] if c >= spotsigs.SHARE * len(texts)}


def plain_sigs(text, common):
    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower())]
    content = [(w, words[i - 1] if i else "^") for i, w in enumerate(words) if w not in common]
    begins = lambda j, a: j == 0 or a in common or xxhash.xxh64_intdigest(a, 42) % spotsigs.EVERY == 0
    return {(a, *[content[j + k][0] if j + k < len(content) else None for k in range(3)]) for j, (_, a) in enumerate(content) if begins(j, a)} or {text or ""}


def test_signatures(docs, rows):
    common = spotsigs.common_words(docs)
    assert set(common) == plain_common([r[1] for r in rows])
    got = spotsigs.with_signatures(docs.select("doc_id", "text"), "text", "s", common).collect()
    for r in got:
        assert len(r["s"]) == len(plain_sigs(r["text"], set(common))), r["doc_id"]


def test_texts_without_common_words(spark):
    """Texts of a language that the corpus hardly has differ unless they are alike."""
    word = lambda s, i: "".join("абвгдежзик"[int(d)] for d in str(xxhash.xxh32_intdigest(f"{s}{i}")))
    same = [word("s", i) for i in range(3)]
    a, b = (" ".join(same + [word(x, i) for i in range(200)]) for x in "ab")
    df = spark.createDataFrame([(a, b, a + " " + word("c", 1))], "a string, b string, c string")
    for c in "abc":
        df = spotsigs.with_signatures(df, c, f"s{c}", ("the", "of"))
    r = df.select(spotsigs.likeness(F.col("sa"), F.col("sb")).alias("far"), spotsigs.likeness(F.col("sa"), F.col("sc")).alias("near")).first()
    assert r["far"] < 0.2 and r["near"] > 0.6


def test_links_at_a_threshold(spark, docs, rows):
    member, pairs = spotsigs.class_links(docs, 0.5)
    common = plain_common([r[1] for r in rows])
    sets = {frozenset(plain_sigs(r[1], common)): None for r in rows}
    ids = {s: min((r[0] for r in rows if frozenset(plain_sigs(r[1], common)) == s and r[0] is not None), default=None) for s in sets}
    sets = [s for s in sets if ids[s] is not None]
    want = {tuple(sorted((ids[a], ids[b]))) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) / len(a | b) >= 0.5}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert want, "the fixture has near copies"
    assert member.count() == len(rows)


def test_op8_against_plain_python(spark, sf):
    got = {r["doc_id"]: r for r in queries.op8_spotsigs(spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    common = plain_common([r["text"] for r in docs])
    for i, r in enumerate(docs):
        t, nx = r["text"], docs[(i + 1) % len(docs)]["text"]
        n = len(t) // 3
        edited = t[: len(t) - n] + nx[:n]
        x = got[r["doc_id"]]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (plain_sigs(x, common) for x in (t, edited, nx))
        assert abs(x["near_edited"] - len(a & b) / len(a | b)) < 1e-9 and abs(x["near_next"] - len(a & c) / len(a | c)) < 1e-9


def test_next_over_levels(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "SMALL", 3)
    ids = [*range(0, 3000, 7), -5, 10**12, 10**12 + 1]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, "doc_id", ["text"], "text").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def test_next_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (300, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["text"], r["next_text"]) for r in spotsigs.with_next(df, "doc_id", ["text"], "text").collect())
    assert got == [(False, "a", "b"), (False, "b", "z"), (False, "c", "a"), (True, "z", "c")]


