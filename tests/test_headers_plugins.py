"""Header fields of bits by hand, and the plug-in registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewright.functions import boxes, fields
from framewright.functions import bits as bt
from framewright.plans import headers
from framewright.plugins import REGISTRY, Registry


def bits(*parts: str) -> bytes:
    b = "".join(parts)
    b += "0" * (-len(b) % 8)
    return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8))


def ue(v: int) -> str:
    s = format(v + 1, "b")
    return "0" * (len(s) - 1) + s


def se(v: int) -> str:
    return ue(2 * v - 1 if v > 0 else -2 * v)


def read(spark, kind, *rows):
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "i long, data binary")
    return fields.READERS[kind](df, "i").orderBy("i").collect()


def test_sequences(spark):
    chroma = bits(format(100, "08b"), "00000000", format(40, "08b"), ue(3), ue(1), ue(0), ue(2), "0", "0", ue(4), ue(0), ue(2), ue(4), "0", ue(119), ue(67), "1", "1", "1", ue(0), ue(0), ue(0), ue(4), "0", "1")
    doubled = bits(format(77, "08b"), "00000000", format(30, "08b"), ue(0), ue(0), ue(2), ue(1), "0", ue(44), ue(17), "0", "1", "1", "0", "0", "1")
    scaling = bits(format(100, "08b"), "00000000", format(40, "08b"), ue(3), ue(1), ue(0), ue(2), "0", "1", "0", "1" + se(-8), "1" + "1" * 3 + se(5) + "1" * 2 + se(-13), "00000", "0" * 0, ue(0), ue(1), "0", se(-3), se(2), ue(2), se(5), se(-7), ue(2), "0", ue(0), ue(0), "1", "1", "0", "0")
    a, b, c, d, e = read(spark, "sequence", chroma, doubled, b"\x42\x00", b"", scaling)
    assert (a["sps_id"], a["width"], a["height"], a["depth_chroma"], a["max_frame_num"], a["max_refs"], a["error"]) == (3, 1920, 1080, 10, 256, 4, None)
    assert (b["width"], b["height"], b["error"]) == (720, 576, None)
    assert c["error"] and d["error"] and c["width"] is None and e["error"] is None
    assert e["scaling"] == [[], [0], [8, 8, 8, 13, 13, 13] + [13] * 10, [], [], [], [], []]
    assert (e["poc_type"], e["off_ref"], e["off_field"], e["cycle"], e["width"]) == (1, -3, 2, [5, -7], 16)


def test_frames(spark):
    shown = bits("10", "00", "0", "0", "1", "0", format(0x498342, "024b"), "010", "0", format(639, "016b"), format(479, "016b"))
    again, wrong = bits("10", "00", "1", "101"), bits("01", "00")
    a, b, c = read(spark, "frame", shown, again, wrong)
    assert (a["key"], a["shown"], a["width"], a["height"]) == (True, True, 640, 480)
    assert (b["show_existing"], b["key"], b["shown"], b["width"]) == (5, False, True, None) and c["error"] == "no frame marker"


def test_bits_are_packed(spark):
    texts = ["1", "00000001", "1" * 7 + "0" * 30, "0" * 22 + "1", "0" * 40 + "11", "0" * 8 + "1" * 9, "01" * 400, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", bt.packed(F.col("t"), False).alias("p"), bt.packed(F.col("t")).alias("e"), headers._bytes(F.col("t")).alias("b")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["p"] == (None if t is None else bits(t)) and (None if t is None else bytes(r["e"]).replace(b"\0\0\3", b"\0\0")) == r["p"]
        assert r["b"] is None if t is None else bytes(r["b"]).replace(b"\0\0\3", b"\0\0") == bits(t, "1")
    assert bytes(got[3]["e"]) == b"\0\0\3\2" and bytes(got[4]["e"]) == b"\0\0\3\0\0\3\0\xc0"


def test_bits_are_worked_out_once(spark):
    plan = spark.range(3).select(headers._bytes(F.bin(F.col("id") + 4711)).alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("4711") == 1, plan


def test_slices_give_what_is_asked(spark, sf):
    cut = F.when(F.col("o_orderkey") % 5 == 0, F.substring("data", 1, 3)).otherwise(F.col("data"))
    df = headers._slices(spark, sf).withColumn("data", cut)
    names = ("weights1", "kind", "changes0", "idr_id")
    some = fields.slices(df, "o_orderkey", only=names)
    assert some.columns == ["o_orderkey", *names, "error"]
    got = some.orderBy("o_orderkey").collect()
    assert got == fields.slices(df, "o_orderkey").select(*some.columns).orderBy("o_orderkey").collect()
    assert 0 < sum(r["error"] is not None for r in got) < len(got)
    for f, other in ((headers.slice_lists, "first_mb"), (headers.slice_header, "changes0")):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert f"{other}#" not in plan


def test_messages_and_configuration(spark):
    rows = [(bytearray([6, 1, 0x55, 255, 5, 2, 1, 2, 0x80]),), (bytearray([1, 255, 3] + [0] * 258 + [2, 0]),), (bytearray(b""),)]
    got = spark.createDataFrame(rows, "d binary").select(boxes.messages(F.hex("d")).alias("m")).collect()
    assert [[tuple(x) for x in r["m"]] for r in got] == [[(6, 1), (260, 2)], [(1, 258), (2, 0)], []]
    rows = [(bytearray([1, 100, 0, 31, 0xFF, 0xE1, 0, 3, 1, 2, 3, 1, 0, 1, 9]),), (bytearray([1, 100, 0, 31, 0xFF, 0xE1, 0, 30, 1]),)]
    got = spark.createDataFrame(rows, "d binary").coalesce(1).select(fields.configuration(F.col("d")).alias("c")).collect()
    assert tuple(got[0]["c"]) == (4, 100, 31, 3, 1) and got[1]["c"] is None


def test_registry_and_filters(spark):
    r = Registry()
    r.add("decoder", "low", codec="x", priority=50, note="first")(lambda df: df)
    r.add("decoder", "high", codec="x", priority=100)(lambda df: df)
    r.add("decoder", "late", codec="x", priority=100)(lambda df: df)
    r.add("encoder", "enc", codec="x")(lambda df: df)
    r.add("writer", "w", extensions=("mp4", "mov"))(lambda df: df)
    assert r.for_codec("decoder", "x").name == "late" and r.for_extension("writer", "A.MOV").name == "w"
    assert r.catalogue() == [("x", True, True, "first")]
    for wrong in (lambda: r.for_codec("decoder", "y"), lambda: r.named("filter", "none"), lambda: r.for_extension("writer", "a.txt")):
        with pytest.raises(KeyError):
            wrong()
    use = lambda name, **o: REGISTRY.named("filter", name).make(**o)
    log = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "stream_index int, pts long, size long")
    got = log.transform(use("streams", keep=(0,))).transform(use("gain", by=3)).transform(use("shift", us=5)).transform(use("merge", other=log)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 2), (0, 6, 6), (1, 1, 2)]
