"""Packing: exact round trip of every id, gapless sequences, proportions."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framewright.llm import packing

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=20), min_size=1, max_size=5), st.sampled_from([8, 32, 1024]), st.sampled_from([1, 4, 8]), st.sampled_from([None, (5, 2, 1), (1, 0.001, 7)]))
def test_schedule(sizes, length, quantum, weights):
    totals = [sum(x) for x in sizes]
    s = packing.Schedule(totals, quantum, length, [weights[i % 3] for i in range(len(sizes))] if weights else None)
    queue = np.concatenate([[i] * len(x) for i, x in enumerate(sizes)])
    start, size = np.concatenate([np.cumsum(x) - x for x in sizes]), np.concatenate(sizes)
    doc, at, n, seq, off = s.pieces(queue, start, size)
    assert n.min() > 0
    for i in range(len(size)):
        own = np.sort(at[doc == i])
        assert own[0] == 0 and np.array_equal(own, np.append(0, np.cumsum(n[doc == i][np.argsort(at[doc == i])]))[:-1])
        assert n[doc == i].sum() == size[i]
    full = Counter()
    for j in np.lexsort((off, seq)):
        assert off[j] == full[seq[j]]
        full[seq[j]] += n[j]
    assert sorted(full) == list(range(len(full)))
    for k, v in full.items():
        assert v == length if k < sum(totals) // length else v < length and v & (v - 1) == 0


@pytest.mark.parametrize("weights", [None, [3, 1, 2], [1, 1, 1]])
def test_schedule_is_deficit_round_robin(weights):
    """The closed form serves the queues as the loop with counters does, also when some are empty."""
    totals, quantum = [50, 7, 23], 4
    s = packing.Schedule(totals, quantum, 16, weights)
    left, credit, place, want = list(s.quanta), [0] * 3, 0, {}
    while any(left):
        for q in range(3):
            credit[q] += s.credit[q]
            if credit[q] >= s.most:  # a quantum's worth
                credit[q] -= s.most
                k = s.quanta[q] - left[q]
                if left[q]:
                    want[q, k] = place
                    place += min(quantum, totals[q] - k * quantum)
                    left[q] -= 1
    assert place == sum(totals)
    for q in range(3):
        assert s.position(q, np.arange(s.quanta[q])).tolist() == [want[q, k] for k in range(s.quanta[q])]
    assert all(0 <= d < quantum for r in range(s.most if s.most < 100 else 9) for d in s.deficits(r))


def test_windows_hold_the_targets(spark):
    """Every window of all that lasts is within two quanta of each source's target, over task borders too."""
    text = " ".join(["word"] * 300)
    rows = [(i, text, f"s{i % 3}") for i in range(120)] + [(1000 + i, text, "s0") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), *ARGS, quantum=16, weights={"s0": 5, "s1": 2, "s2": 1}).collect()
    held, total = defaultdict(Counter), Counter()
    for r in got:
        held[r["sequence_id"]][r["source"]] += r["length"]
        total[r["source"]] += r["length"]
    lasts = int(min(total[s] / w for s, w in (("s0", 5), ("s1", 2), ("s2", 1))) * 8 // 1024) - 1
    assert lasts >= 10
    for i in range(lasts):
        assert all(abs(held[i][s] - 1024 * w / 8) <= 32 for s, w in (("s0", 5), ("s1", 2), ("s2", 1)))
    assert held[max(held)].keys() <= total.keys() and sum(total.values()) == len(rows) * 301


def test_wide_numbers():
    s = packing.Schedule([2**45, 2**44], 64, 1024)
    assert s.kind is object
    last = s.position(0, np.array([s.quanta[0] - 1]))[0]
    assert 2**45 + 2**44 - 128 <= last < 2**45 + 2**44


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["a<|endoftext|>b", "\r\n \t x", "  trailing  ", "don't I'LL we're"]))
def test_ids_are_those_of_the_tokenizer(text):
    assert packing.encoder(*ARGS)(text) == Tokenizer.from_file(ARGS[0]).encode(text, add_special_tokens=False).ids


def test_every_id_is_packed_once(docs, rows):
    got = packing.pack(docs, *ARGS, sequence_length=128, quantum=16).collect()
    tok = Tokenizer.from_file(ARGS[0])
    want = Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    for i, ids in want:
        own = sorted({(r["start"], r["length"], bytes(r["ids"])) for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids)})
        if i is not None:
            assert np.frombuffer(b"".join(x[2] for x in own if x[1] * 4 == len(x[2])), "<u4").tolist()[: len(ids)] == list(ids) or want[i, ids] > 1
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(v == 128 or (v & (v - 1)) == 0 for v in ends.values())


def test_nothing(none):
    assert packing.pack(none, *ARGS).collect() == []


@pytest.mark.parametrize("most,weights", [(1, None), (2, (5, 2, 1)), (2, {"s1": 3, "s2": 2})])
def test_further_sources_share_a_queue(docs, monkeypatch, most, weights):
    monkeypatch.setattr(packing, "MAX_QUEUES", most)
    got = packing.pack(docs, *ARGS, sequence_length=128, quantum=16, weights=weights).collect()
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
