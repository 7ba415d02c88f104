"""Near copies by SimHash tiles and word shingles: every pair of sets with a Jaccard similarity of ``percent`` or more is found, and no other is linked.

Three steps, each on what the one before left apart:

1. SimHash fingerprints of 128 bits are dealt by a few draws of their bits and compared
   in tiles (simhash.nearest_links). Of each row the nearest other is compared by whole
   sets. This joins most of a large group by as many links as it has rows.
2. Two sets as similar as the limit have one of their first elements in common, in any one order
   of all shingles, if as many are taken as the limit lets them differ in and one
   (prefix filter). The order puts shingles last that are frequent in a sample of texts;
   results don't depend on it. Only shingles that step 1 left in different
   components are looked at further.
3. What shares such a shingle is compared in tiles by size and by the parity of its hashes in
   512 slots, which never differs in more slots than the sets do in elements; pairs
   that this leaves are compared so in more slots, and then by their whole sets.

So no pair is lost to a draw, a radius or a cap. Equal sets are one node, named by 64
bits of a digest of their shingles; two sets of one name by chance are kept apart unless both have links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, sized
from .components import connected_components
from .simhash import nearest_links, of_hashes

#: One text of so many, but about so many texts at least, is in the sample that tells frequent shingles.
SHARE, SAMPLE = 64, 16_000
#: How many texts of the sample make a shingle frequent, and how many shingles are kept. Only the order of shingles follows from them.
OFTEN, KEPT = 3, 200_000
#: Rows of a shingle's group that make a tile.
GROUP = 8192
#: Times that each set is linked to the nearest of another component before all pairs that are left are compared.
TURNS = 1
#: A table of so many rows (ids and hashes) is broadcast instead of shuffling the texts that it is joined with.
SMALL = 200_000
#: Texts, or their parities, of a task that compares pairs, about.
TEXTS = 4096
#: A task forgets the sets that it has seen beyond so many; a set that it sees again sends its shingles again.
_SEEN = 1_000_000
#: Rows of a tile that are compared at once.
_TILE = 256
_NODE = "node long, comp long, n long, " + ", ".join(f"k{i} long" for i in range(8))


def shingles(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of a text's shingles of ``k`` words, in order; a shorter text is one shingle, and one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    data = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(data[i:j], seed) for i, j in zip(start, end[len(words) - n :].tolist(), strict=True)), np.uint64, n))


def parity(h: np.ndarray) -> np.ndarray:
    """8 words: for each of 512 slots, whether an odd number of the hashes falls into it."""
    slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=512) & 1).astype(np.uint8)).view(np.int64)


def wide_parity(h: np.ndarray) -> bytes:
    """Parities of a power of two of slots, four to eight times as many as the hashes and 512 at least."""
    bits = max(9, (4 * len(h)).bit_length())
    slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The parities of ``size`` bytes of slots: those of slots next to each other are joined."""
    if len(x) == size:
        return x
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(x).reshape(8 * size, -1), axis=1))


def prefix(h: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes, of which similar sets share one, that are not frequent and that are."""
    often = np.zeros(len(h), bool)
    if len(frequent):  # in order, and so are the hashes
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    n = len(h) + (percent * len(h)) // -100 + 1 if len(h) else 0
    rare, last = h[~often][:n], h[often]
    return rare.view(np.int64), last[: n - len(rare)].view(np.int64)


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many texts of a sample have."""
    share = min(1.0, max(1 / SHARE, SAMPLE / max(1, docs.count())))
    few = docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) <= (1 << 30) * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), k).view(np.int64))], ["s"])

    found = few.select("text").distinct().mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    return np.unique(np.array([r["s"] for r in found.orderBy(F.desc("count"), "s").limit(KEPT).collect()], np.int64).view(np.uint64))


def _marked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each row its id, the hash of its text, and its set's node, size, fingerprint, parities and prefix (the last two once in a task)."""
    frequent, id_type = _frequent(docs, k), docs.schema["doc_id"].dataType.simpleString()
    longs = lambda x: pa.array(x, pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            node, more, n, fp, bits, wide, rare, often = ([] for _ in range(8))
            for x in batch.column(2):
                h = shingles(x.as_py(), k)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                node.append(int.from_bytes(digest[:8], "big", signed=True))
                more.append(int.from_bytes(digest[8:], "big", signed=True))
                n.append(len(h))
                fp.append(of_hashes(h).view(np.int64))
                bits.append(parity(h))
                new = digest not in seen
                one = prefix(h, frequent, percent) if new else ([], [])
                rare.append(one[0])
                often.append(one[1])
                wide.append(wide_parity(h) if new else None)
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
            fp = np.array(fp, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(more, pa.int64()), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), longs(bits), pa.array(wide, pa.binary()), longs(rare), longs(often)],
                ["doc_id", "hash", "node", "more", "n", "fp", "fp2", "parity", "wide", "rare", "often"],
            )

    schema = f"doc_id {id_type}, hash long, node long, more long, n long, fp long, fp2 long, parity array<long>, wide binary, rare array<long>, often array<long>"
    return materialize(docs.mapInArrow(run, schema), "marked")


def _nodes_of(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """(p_node) of all that are in pairs, how many they are, and the pairs."""
    count = pairs.count()
    nodes = materialize(sized(pairs.select(F.explode(F.array("a", "b")).alias("p_node")).distinct(), 2 * count), "pair-nodes")
    return nodes, nodes.count(), count


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""
    nodes, count, many = _nodes_of(pairs)
    hint = F.broadcast if count <= SMALL else (lambda x: x)
    first = classes.join(hint(nodes), F.col("node") == F.col("p_node"), "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    first = first.select("node", F.col("row.doc_id").alias("r_id"), F.col("row.hash").alias("r_hash"))
    texts = docs.join(hint(first), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash"))).select("node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [(None, None)] * 2  # the last sets of either side: rows come sorted by one of them
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                for side in (0, 1):
                    node = batch.column(side)[i].as_py()
                    if held[side][0] != node:
                        held[side] = node, shingles(batch.column(2 + side)[i].as_py(), k)
                x, y = held[0][1], held[1][1]
                same = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near))

    found = materialize(sized(texts.groupBy("node").agg(F.first("text").alias("text")), count, TEXTS), "texts")
    pairs = sized(pairs, many, 4 * TEXTS)
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    links = materialize(sized(both.select("a", "b", "x", "y"), many, 4 * TEXTS).mapInArrow(compare, "a long, b long"), "links")
    drop(found, nodes)
    return links


def _possible(marked: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and parities in slots as many as four times the shingles allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                m, n = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8) for c in (4, 5))
                x, y = folded(x, min(len(x), len(y))), folded(y, min(len(x), len(y)))
                far = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))
                ok[i] = 100 * min(m, n) >= percent * max(m, n) and far * (100 + percent) <= (100 - percent) * (m + n)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok))

    nodes, count, many = _nodes_of(pairs)
    own = marked.where("wide is not null").select("node", "n", "wide").join(F.broadcast(nodes) if count <= SMALL else nodes, F.col("node") == F.col("p_node"), "left_semi")
    own = sized(own.groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("wide")), count, TEXTS)
    side = lambda c, m, w: own.select(F.col("node").alias(c), F.col("n").alias(m), F.col("wide").alias(w))
    both = sized(pairs, many, 4 * TEXTS).join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    found = materialize(sized(both, many, 4 * TEXTS).mapInArrow(run, "a long, b long"), "candidates")
    drop(nodes)
    return found


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different rows (s, node), sorted by both, without those that are alone with their s."""
    s, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = last = None  # the s of the last row told, and the last row seen
    for batch in batches:
        s, node = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((s, node)))
        if len(s):
            new = np.append(last != (s[0], node[0]), (s[1:] != s[:-1]) | (node[1:] != node[:-1]))
            s, node = s[new], node[new]
        if len(s) > 1:
            same = s[1:] == s[:-1]
            keep = np.append(s[0] == before, same[:-1]) | same
            last = s[-2], node[-2]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[:-1][keep]), pa.array(node[:-1][keep])], ["s", "node"])
                before = s[:-1][keep][-1]
            s, node = s[-1:], node[-1:]
    if len(s) and s[0] == before:
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(node)], ["s", "node"])


def _candidates(key: np.ndarray, body: np.ndarray, percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of equal keys that sizes and parities allow and that are not joined yet, with the slots in which they differ; or only the nearest of each row."""
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    size = np.diff(np.append(edge, len(key)))
    node, comp, n, bits = body[:, 0], body[:, 1], body[:, 2], np.ascontiguousarray(body[:, 3:]).view(np.uint64)
    group, small, found = np.repeat(np.arange(len(edge)), size), size <= 16, []

    def put(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        """Pairs within the limits, with the share of slots in which they differ."""
        far = 1_000_000 * far // (n[i] + n[j])
        if nearest:
            i, j, far = np.append(i, j), np.append(j, i), np.append(far, far)
            order = np.lexsort((far, i))
            order = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
            found.append(np.stack([node[i], node[j], far], axis=1)[order])
        else:
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), far], axis=1))

    for lag in range(1, int(size[small].max(initial=0))):
        i = np.flatnonzero((group[:-lag] == group[lag:]) & small[group[:-lag]])
        j = i + lag
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = far * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        put(i[ok], j[ok], far[ok])
    for g in np.flatnonzero(~small):
        own = np.arange(edge[g], edge[g] + size[g])
        if (comp[own] == comp[own[0]]).all():
            continue
        own = own[np.argsort(n[own], kind="stable")]  # tiles by size: those too far apart are not met
        until = np.searchsorted(100 * n[own], 100 * 100 * n[own] // percent, side="right")
        for at in range(0, len(own), _TILE):
            x = own[at : at + _TILE]
            for other in range(at, int(until[min(at + _TILE, len(own)) - 1]), _TILE):
                y = own[other : other + _TILE]
                far = np.zeros((len(x), len(y)), np.int32)
                for w in range(bits.shape[1]):
                    far += np.bitwise_count(bits[x, w][:, None] ^ bits[y, w][None, :])
                least, most = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
                ok = (comp[x][:, None] != comp[y][None, :]) & (100 * least >= percent * most) & (far * (100 + percent) <= (100 - percent) * (least + most))
                if other == at:
                    ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                i, j = np.nonzero(ok)
                put(x[i], y[j], far[i, j].astype(np.int64))
    if found and len(pairs := np.concatenate(found)):
        if nearest:  # one for each row, over all groups at hand
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
            pairs = pairs[np.append(True, pairs[1:, 0] != pairs[:-1, 0])]
        else:
            pairs = np.unique(pairs, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], ["a", "b", "far"])


def _compared(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """_candidates of rows sorted by their three keys; a run may go on in the next batch."""
    held = np.zeros((0, 14), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if len(rows):
            last = int(np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))[-1])
            if last:
                yield from _candidates(rows[:last, :3], rows[:last, 3:], percent, nearest)
            held = rows[last:]
    if len(held):
        yield from _candidates(held[:, :3], held[:, 3:], percent, nearest)


def _found(rows: DataFrame, single: DataFrame, joined: DataFrame, percent: int, nearest: bool, count: int) -> DataFrame:
    """(a, b) of rows (s, node) that share a shingle, are in different components and may be similar; or of each node the nearest of those."""
    rows = rows.join(joined, F.col("node") == F.col("c_node"), "left").select("s", "node", F.coalesce("root", "node").alias("comp"))
    # only shingles that more than one component has; a large group goes to tiles by hash, and each row to every pair of tiles that holds its own
    apart = rows.groupBy("s").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rows = rows.join(apart.select(F.col("s").alias("a_s"), "parts"), F.col("s") == F.col("a_s")).select("s", "parts", F.col("node").alias("r_node"), "comp")
    rows = rows.join(single.select("node", "n", "parity"), F.col("r_node") == F.col("node"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    names = [x.split()[0] for x in _NODE.split(", ")]
    rows = rows.select("s", F.explode(tiles).alias("t"), "node", "comp", "n", *[F.col("parity")[i].alias(f"k{i}") for i in range(8)]).select("s", "t.i", "t.j", *names)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(lambda it: _compared(it, percent, nearest), "a long, b long, far long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))
    found = found.select("a", "b")
    return materialize((sized(found, count) if nearest else found).distinct(), "found")


def links(docs: DataFrame, marked: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links of similar sets that join all that are similar."""
    single = classes.where("n > 0").dropDuplicates(["node"])
    count = single.count()
    near = materialize(sized(nearest_links(single.select("node", "fp", "fp2"), count), count), "nearest")
    found = _verified(docs, classes, near, k, percent)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = marked.select(F.explode("rare").alias("s"), "node").repartition(n, "s").sortWithinPartitions("s", "node").mapInArrow(_shared, "s long, node long")
    rows = materialize(rare.union(marked.select(F.explode("often").alias("s"), "node").distinct()), "shared")
    # of shingles that the same sets have, one is enough
    once = rows.groupBy("s").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)])
    once = once.where("c > 1").groupBy("c", "x0", "x1").agg(F.min("s").alias("o_s")).select("o_s")
    groups = materialize(rows.join(once, F.col("s") == F.col("o_s"), "left_semi"), "groups")
    drop(near, rows)
    # a large group is first joined by the nearest of each set, so that what is left to compare in full does not grow with its square
    for turn in range(TURNS + 1):
        joined = materialize(sized(connected_components(found).select(F.col("node").alias("c_node"), "root"), count), "joined")
        nearest = turn < TURNS
        pairs = _found(groups, single, joined, percent, nearest, count)
        if pairs.isEmpty():
            break
        possible = _possible(marked, pairs, percent)
        found = found.union(_verified(docs, classes, possible, k, percent))
        drop(pairs, possible, joined)
    drop(groups)
    return found


def one_of_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of all that links of ``percent`` similarity join, one stays.

    That is the row of the smallest id, null ids last, then of the smallest hash of
    its text. Ids are of any type and only choose: a row of null id that is like no
    other stays, and so do different texts of one id. Null texts and texts without
    words are equal; rows of equal id and text are one.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = _marked(own, k, percent)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    classes = materialize(marked.groupBy("node", "more").agg(F.min(row).alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "fp2", "parity")]), "classes")
    roots = connected_components(links(own, marked, classes, k, percent)).select(F.col("node").alias("c_node"), "root")
    roots = materialize(roots.union(roots.select("root", "root").distinct()), "roots")
    named = classes.join(roots, F.col("node") == F.col("c_node"), "left").select("node", "more", "row", F.coalesce("root", "node").alias("comp"), F.when(F.col("root").isNull(), F.col("more")).otherwise(0).alias("own"))
    kept = named.groupBy("comp", "own").agg(F.min("row").alias("row"))
    # what goes is told by id and hash, so that texts are not shuffled where it is little
    each = marked.groupBy("doc_id", "hash").agg(F.count("*").alias("times"))
    kept = kept.select(F.col("row.doc_id").alias("k_id"), F.col("row.hash").alias("k_hash"))
    gone = materialize(each.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")), "left_anti").select(F.col("doc_id").alias("__gone_id"), F.col("hash").alias("__gone_hash")), "gone")
    hint = F.broadcast if gone.count() <= SMALL else (lambda x: x)
    match = lambda a, b: F.col(f"`{id_col}`").eqNullSafe(F.col(a)) & (F.xxhash64(text) == F.col(b))
    found = docs.join(hint(gone), match("__gone_id", "__gone_hash"), "left_anti")
    again = each.where("times > 1").select(F.col("doc_id").alias("__again_id"), F.col("hash").alias("__again_hash"))
    if again.isEmpty():
        return found
    twice = found.withColumn("__hash", F.xxhash64(text)).withColumn("__id", F.col(f"`{id_col}`"))
    twice = twice.join(again, match("__again_id", "__again_hash"), "left_semi").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
    return found.join(again, match("__again_id", "__again_hash"), "left_anti").union(twice)
