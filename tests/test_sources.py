"""Containers: exact round trips, faults, probes, and the files themselves."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from framewright.sources import containers as c
from framewright.sources import read_media, save_files
from framewright.sources.files import parse

payloads = st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=12)


@given(payloads)
def test_ivf(parts):
    data = c.write_ivf([(i * 3, p) for i, p in enumerate(parts)])
    assert [(p[1], p[5]) for p in c.read_ivf(data)] == [(i * 3, p) for i, p in enumerate(parts)]
    assert c.probe(data) == ("ivf", 100)


@given(payloads, st.integers(0, 3))
def test_mp4(parts, shift):
    samples = [(1 + i % 3, shift if i % 2 else 0, i % 4 == 0, p) for i, p in enumerate(parts)]
    got = list(c.read_mp4(c.write_mp4(samples)))
    dts = 0
    for s, p in zip(samples, got, strict=True):
        assert p == (0, dts + s[1], dts, s[0], s[2], s[3])
        dts += s[0]


@given(payloads)
def test_webm(parts):
    clusters = [(i * 100, [(j - 1, j == 0, p) for j, p in enumerate(parts[i : i + 3])]) for i in range(0, len(parts), 3)]
    got = [(p[1], p[4], p[5]) for p in c.read_webm(c.write_webm(clusters))]
    assert got == [(t + d, k, p) for t, blocks in clusters for d, k, p in blocks]


@given(st.binary(max_size=300), st.sampled_from([1, 2]))
def test_wav(samples, channels):
    samples = samples[: len(samples) // (2 * channels) * 2 * channels]
    got = list(c.read_wav(c.write_wav(samples, channels=channels), 7))
    assert b"".join(p[5] for p in got) == samples
    assert [p[1] for p in got] == list(range(0, len(samples) // (2 * channels), 7))


def test_units_of_both_start_codes():
    assert c.units(b"\0\0\1\x67a\0\0\0\1\x68b\0\0\1\x65\x80c\0\0") == [b"\x67a", b"\x68b", b"\x65\x80c"]


def test_access_units_open_at_companions_and_first_slices():
    parts = [b"\x67", b"\x68", b"\x65\x80", b"\x65\x40", b"\x41\x80", b"\x06", b"\x41\x80"]
    assert [len(g) for g in c.access_units(parts)] == [4, 1, 2]
    assert [p[4] for p in c.read_annexb(c.write_annexb(parts))] == [True, False, False]


def test_first_run_of_a_chunk_holds_until_the_next(spark):
    box, pack = c.box, __import__("struct").pack
    table = lambda name, body: box(name, pack(">I", 0), body)
    stbl = table(b"stts", pack(">III", 1, 5, 10)) + table(b"stsz", pack(">II", 4, 5)) + table(b"stsc", pack(">I6I", 2, 1, 2, 1, 3, 1, 1)) + table(b"stco", pack(">I3I", 3, 100, 200, 300)) + table(b"stss", pack(">II", 1, 3))
    offset, size, dts, shift, duration, key = c.sample_table(stbl, 0, len(stbl))
    assert offset.tolist() == [100, 104, 200, 204, 300] and size.tolist() == [4] * 5
    assert dts.tolist() == [0, 10, 20, 30, 40] and key.tolist() == [False, False, True, False, False]


@pytest.mark.parametrize("data", [b"", b"DKIF", c.write_ivf([(0, b"abc")])[:-1], b"RIFF____WAVEdata\4\0\0\0abcd", b"\x1a\x45\xdf\xa3\xff"])
def test_faults_become_rows(spark, data):
    rows = parse(spark.createDataFrame([(1, bytearray(data))], "id long, content binary"), keys=("id",)).collect()
    assert not rows or rows[-1]["error"]


def test_files_of_a_folder(spark, tmp_path):
    made = spark.createDataFrame([("a.ivf", bytearray(c.write_ivf([(5, b"x"), (6, b"yz")]))), ("b.wav", bytearray(c.write_wav(bytes(8))))], "name string, content binary")
    assert sorted(save_files(made, f"file://{tmp_path}/out").collect()) == [("a.ivf", 32 + 12 + 1 + 12 + 2), ("b.wav", 52)]
    got = read_media(spark, f"file://{tmp_path}/out").orderBy("path", "seq").collect()
    assert [(r["path"][-5:], r["pts"], bytes(r["data"])) for r in got] == [("a.ivf", 5, b"x"), ("a.ivf", 6, b"yz"), ("b.wav", 0, bytes(8))]
