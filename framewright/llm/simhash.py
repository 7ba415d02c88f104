"""SimHash near-duplicates: exact Hamming comparison in tiles.

A pair of fingerprints that differ in at most ``radius`` bits agrees in full on
at least ``agree`` of ``radius + agree`` blocks of bits. So fingerprints are dealt by
every choice of ``agree`` blocks, and those that share one are compared, in tiles,
with exclusive-or and bit counts; tile pairs whose bit counts differ by more than
the radius are skipped. Nothing within the radius is lost, and no two texts are
compared that share no such choice. Equal fingerprints are one row throughout.
A group beyond ``tile`` rows is cut into tiles by bit count and by hash, and each
pair of tiles is a row group of its own, so that no group lands in one task.
Links within a tile pair are told as a forest that joins the same fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Rows of a group that are compared in one task.
GROUP = 4096
_LANES = np.uint64(0x0101010101010101)


def simhash(text: str | None, k: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if over half of the shingles' hashes have it."""
    return int(wide_simhash(text, k, seed, 1)[0])


def wide_simhash(text: str | None, k: int = 4, seed: int = 42, width: int = 2) -> np.ndarray:
    """A fingerprint of ``width`` words of 64 bits. The first is that of the shingles' hashes; the others are of hashes made from these."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - k + 1)
    if not words:
        return np.zeros(width, np.uint64)
    data = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[i:j], seed) for i, j in zip(start, end, strict=True)), np.uint64, n)
    return of_hashes(h, width)


def of_hashes(h: np.ndarray, width: int = 2) -> np.ndarray:
    """The fingerprint of shingles' hashes."""
    return np.array([_majority(h if w == 0 else _mixed(h, w)) for w in range(width)], np.uint64)


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros((8, 8), np.int64)  # [shift, lane]
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        for shift in range(8):
            lanes = (part >> np.uint64(shift)) & _LANES
            sums = np.add.reduceat(lanes, np.arange(0, len(part), 255))  # a lane holds up to 255
            counts[shift] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint64)
    weights = np.uint64(1) << (np.arange(8, dtype=np.uint64)[None, :] * np.uint64(8) + np.arange(8, dtype=np.uint64)[:, None])
    return int((bits * weights).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text, as a signed number. A null text is an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x.as_py(), k, seed) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def forest(fp: np.ndarray, radius: int, tile: int = 1024) -> np.ndarray:
    """For each of a group's fingerprints, the index of another of its component (its own: the component's first).

    Tiles of the group, sorted by bit count, are compared; pairs of tiles whose
    counts lie further apart than the radius are skipped.
    """
    fp = fp.reshape(len(fp), -1)
    count = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    x, pop = fp[order], count[order]
    label = np.arange(len(x))
    changed = True
    while changed:
        changed = False
        for i in range(0, len(x), tile):
            for j in range(i, len(x), tile):
                if pop[j] - pop[min(i + tile, len(x)) - 1] > radius:
                    break
                near = sum(np.bitwise_count(x[i : i + tile, None, w] ^ x[None, j : j + tile, w]).astype(np.uint16) for w in range(x.shape[1])) <= radius
                a, b = label[i : i + tile], label[j : j + tile]
                big = len(x)
                low_a = np.minimum(a, np.where(near, b[None, :], big).min(axis=1))
                low_b = np.minimum(b, np.where(near, a[:, None], big).min(axis=0))
                if (low_a != a).any() or (low_b != b).any():
                    changed = True
                    label[i : i + tile] = low_a
                    label[j : j + tile] = np.minimum(label[j : j + tile], low_b)
        label = label[label]
    out = np.empty(len(x), np.int64)
    out[order] = order[label]
    return out


def _compare(batches: Iterator[pa.RecordBatch], radius: int, tile: int, keys: int = 4) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys, the first columns; rows come sorted by them, and a run may go on in the next batch.

    After the keys comes a fingerprint of one word, which names itself, or a name
    and a fingerprint of several words.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(key: np.ndarray, body: np.ndarray) -> Iterator[pa.RecordBatch]:
        name, fp = body[:, 0], (body[:, 1:] if body.shape[1] > 1 else body).view(np.uint64)
        edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        size = np.diff(np.append(edge, len(key)))
        found = []
        group = np.repeat(np.arange(len(edge)), size)
        small = size <= 16
        for lag in range(1, int(size[small].max(initial=0))):  # all pairs of all small groups at one distance
            i = np.flatnonzero((group[:-lag] == group[lag:]) & small[group[:-lag]])
            near = i[np.bitwise_count(fp[i] ^ fp[i + lag]).sum(axis=1, dtype=np.int64) <= radius]
            found.append((name[near], name[near + lag]))
        for g in np.flatnonzero(~small):
            own = slice(edge[g], edge[g] + size[g])
            to, names = forest(fp[own], radius, tile), name[own]
            least = names.copy()  # a component is named alike in all groups that hold it, so that its links are the same
            np.minimum.at(least, to, names)
            at = np.flatnonzero(least[to] != names)
            found.append((names[at], least[to][at]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        key, body = rows[:, :keys], rows[:, keys:]
        last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))[-1])
        if held and (held[0][0][0] != key[0]).any():
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        if last or not held:
            if last:
                yield from links(*(np.concatenate(x) for x in zip(*held, (key[:last], body[:last]), strict=True)))
            held = [(key[last:], body[last:])]
        else:
            held.append((key, body))
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def blocks_to_agree(count: int, radius: int = 4, group: int = GROUP) -> int:
    """How many blocks must agree so that groups of ``count`` even fingerprints stay below a quarter of ``group``, two at least."""
    agree = 2
    while agree < 6 and count >> (64 * agree // (radius + agree)) > group // 4:
        agree += 1
    return agree


def hamming_links(fps: DataFrame, radius: int = 4, agree: int = 2, tile: int = 1024, group: int = 4096, fp_col: str = "fp") -> DataFrame:
    """(a, b): links that join all fingerprints within ``radius`` bits, as forests of the groups compared; any ``agree`` finds the same."""
    blocks, at = [], 0
    for i in range(radius + agree):
        width = 64 // (radius + agree) + (i < 64 % (radius + agree))
        blocks.append(((1 << width) - 1) << at)
        at += width
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(sum(x)) for x in combinations(blocks, agree)]
    rows = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    rows = rows.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "key"])
    # tiles of a large group: by bit count, then by hash; a row goes to each pair of tiles that may hold a partner
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / group).cast("long"))
    parts = F.ceil(F.col("n") / group).cast("long")
    pop = F.bit_count("fp").cast("long")
    mine = pop * 1_000_000 + part
    others = F.flatten(F.transform(F.sequence(F.greatest(pop - radius, F.lit(0)), F.least(pop + radius, F.lit(64))), lambda p: F.transform(F.sequence(F.lit(0), parts - 1), lambda h: p * 1_000_000 + h)))
    pairs = F.transform(others, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    rows = rows.withColumn("t", F.explode(F.when(F.col("n") <= group, one).otherwise(pairs)))
    rows = rows.select(F.col("band").cast("long").alias("band"), "key", "t.i", "t.j", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInArrow(lambda it: _compare(it, radius, tile), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint and the smallest doc_id it reaches by links of at most ``radius`` bits.

    A null or empty text has fingerprint zero and links like any other; rows that
    repeat are linked; null ids count only where a component has no other. An
    empty table gives no rows; other columns are left out.
    """
    marked = materialize(fingerprints(docs, k, seed, id_col, text_col), "simhash")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("m"))
    roots = connected_components(hamming_links(first, radius, blocks_to_agree(first.count(), radius)))
    first = first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "m")
    linked = first.join(first.groupBy("root").agg(F.min("m").alias("component_id")), "root").select(F.col("fp").alias("c_fp"), "component_id")
    return marked.join(linked, marked["fp"] == linked["c_fp"]).select("doc_id", "fp", "component_id")


def _nearest(batches: Iterator[pa.RecordBatch], radius: int, tile: int = 512) -> Iterator[pa.RecordBatch]:
    """(a, b, bits): for rows (key, salt, node, fp, fp2), sorted by the first two, the nearest of the rows before in its group by bit count."""

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
        order = np.lexsort((rows[:, 2], pop, rows[:, 1], rows[:, 0]))
        rows, fp, pop = rows[order], fp[order], pop[order]
        edge = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        size = np.diff(np.append(edge, len(rows)))
        group, small = np.repeat(np.arange(len(edge)), size), size <= 16
        best, to = np.full(len(rows), radius + 1), np.full(len(rows), -1)
        for lag in range(1, int(size[small].max(initial=0))):  # all pairs of all small groups at one distance
            i = np.flatnonzero((group[:-lag] == group[lag:]) & small[group[:-lag]])
            far = np.bitwise_count(fp[i] ^ fp[i + lag]).sum(axis=1, dtype=np.int64)
            ok = far < best[i + lag]
            best[i[ok] + lag], to[i[ok] + lag] = far[ok], i[ok]
        for g in np.flatnonzero(~small):
            lo, hi = int(edge[g]), int(edge[g] + size[g])
            for at in range(lo, hi, tile):
                end = min(at + tile, hi)
                for other in range(lo, end, tile):
                    stop = min(other + tile, hi)
                    if pop[at] - pop[stop - 1] > radius:
                        continue
                    far = sum(np.bitwise_count(fp[at:end, None, w] ^ fp[None, other:stop, w]).astype(np.int64) for w in range(fp.shape[1]))
                    far[np.arange(other, stop)[None, :] >= np.arange(at, end)[:, None]] = radius + 1
                    j = far.argmin(axis=1)
                    far = far[np.arange(end - at), j]
                    ok = np.flatnonzero(far < best[at:end])
                    best[at + ok], to[at + ok] = far[ok], other + j[ok]
        has = np.flatnonzero(to >= 0)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(rows[has, 2]), pa.array(rows[to[has], 2]), pa.array(best[has])], ["a", "b", "bits"])

    held = np.zeros((0, 5), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if len(rows):
            last = int(np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))[-1])
            if last:
                yield from links(rows[:last])
            held = rows[last:]
    if len(held):
        yield from links(held)


def nearest_links(fps: DataFrame, count: int, radius: int = 24, draws: int = 6, group: int = GROUP, seed: int = 42) -> DataFrame:
    """(a, b): for rows (node, fp, fp2) with fingerprints of 128 bits, at most one link each to a near one; not all that are near.

    Rows that agree on some drawn bits (as many as ``count`` rows need for groups of
    a few) are compared in tiles, and each is linked to its nearest of a lower bit
    count. A group of more than ``group`` rows is split by hash. A first step for what finds the rest.
    """
    bits = min(40, max(12, int(count).bit_length()))
    rng, keys = np.random.default_rng(seed), []
    for t in range(draws):
        mask = np.zeros(128, np.uint8)
        mask[rng.choice(128, bits, replace=False)] = 1
        low, high = (int(x) for x in np.packbits(mask).view(">i8"))
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(low)), F.col("fp2").bitwiseAND(F.lit(high))))
    rows = fps.select("node", "fp", "fp2", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group)
    large = materialize(large.select(F.col("key").alias("large"), F.ceil(F.col("n") / group).cast("long").alias("parts")), "large")
    hint = F.broadcast if large.count() <= 100_000 else (lambda x: x)
    rows = rows.join(hint(large), F.col("key") == F.col("large"), "left")
    salt = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long")))
    rows = rows.select("key", salt.alias("salt"), "node", "fp", "fp2")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lambda it: _nearest(it, radius), "a long, b long, bits long")
    return found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
