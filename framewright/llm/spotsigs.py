"""SpotSigs document fingerprints, by DataFrame functions only.

A signature is a common word (the anchor) and the chain of the next content words
after it; a document's fingerprint is the set of its signatures. The common words are
those in the most documents of the corpus at hand. One other word in ``EVERY``, by its
hash, is an anchor too, so that texts in a language of few documents have signatures. Two documents
are as alike as the Jaccard similarity of their sets. Sets whose sizes are further
apart than the threshold allows can't be alike enough: sets are dealt to
partitions by size, and only those of one partition or the next are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors are at most so many words, each in at least this share of the documents.
COMMON, SHARE = 120, 0.02
#: One word in so many is an anchor whatever its frequency.
EVERY = 16
#: Content words in a chain.
CHAIN = 3
#: Ids are dealt to windows by ranges of so many.
RANGE = 128
#: A table of so many rows at most may be ordered as a whole, or broadcast.
SMALL = 8192


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def common_words(docs: DataFrame, text_col: str = "text", most: int = COMMON, share: float = SHARE) -> tuple[str, ...]:
    """The words in most documents of the whole table, at most ``most``: what the driver gets."""
    each = docs.select(F.explode(F.array_distinct(words(F.coalesce(F.col(text_col), F.lit(""))))).alias("w"))
    found = each.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    least = share * docs.count()
    return tuple(sorted(r["w"] for r in found if r["n"] >= least))


def with_signatures(df: DataFrame, text_col: str, out: str, anchors: tuple[str, ...], chain: int = CHAIN) -> DataFrame:
    """df and ``out``: the sorted set of the text's signatures, as 64-bit hashes.

    The begin of a text counts as an anchor too, so that any text with a content
    word has a signature; one without is its own text's hash. Null as empty. Columns
    whose names begin with __fw_ are its own.
    """
    common = list(anchors)
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__fw_w", words(text))
    # each word is looked up once: what stands before a content word comes along with it
    df = df.withColumn("__fw_w", F.transform("__fw_w", lambda w: F.struct(w.alias("w"), (w.isin(common) if common else F.lit(False)).alias("c"))))
    begin = F.struct(F.lit("^").alias("w"), F.lit(False).alias("c"))
    before = lambda x, i: F.struct(x["w"].alias("w"), x["c"].alias("c"), F.when(i == 0, begin).otherwise(F.get("__fw_w", i - 1)).alias("a"))
    df = df.withColumn("__fw_c", F.filter(F.transform("__fw_w", before), lambda x: ~x["c"])).drop("__fw_w")
    begins = lambda x, j: (j == 0) | x["a"]["c"] | (F.pmod(F.xxhash64(x["a"]["w"]), F.lit(EVERY)) == 0)
    follow = lambda x, j: F.when(begins(x, j), F.xxhash64(x["a"]["w"], x["w"], *[F.get("__fw_c", j + i)["w"] for i in range(1, chain)]))
    sigs = F.array_sort(F.array_distinct(F.array_compact(F.transform("__fw_c", follow))))
    df = df.withColumn(out, sigs).drop("__fw_c")
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.xxhash64(text))))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where their sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(small >= least * large, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: 16 hex digits for each signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _next_lower(keys: DataFrame, key: str, fan: int = 4096) -> DataFrame:
    """(key, below): of distinct long keys the next lower one; below the lowest comes the highest.

    Keys are ordered within ranges; the highest of each range goes to the level
    above, until a level is small.
    """
    if keys.count() <= SMALL:
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc(key))
        return keys.select(key, F.coalesce(F.lead(key).over(order), F.max(key).over(Window.partitionBy(F.lit(0)))).alias("below"))
    dealt = keys.select(key, F.floor(F.col(key) / fan).cast("long").alias("__fw_up"))
    tops = materialize(dealt.groupBy("__fw_up").agg(F.max(key).alias("__fw_top")), "tops")
    above = _next_lower(tops.select("__fw_up"), "__fw_up", fan).join(tops.select(F.col("__fw_up").alias("below"), F.col("__fw_top").alias("__fw_next")), "below").select("__fw_up", "__fw_next")
    order = Window.partitionBy("__fw_up").orderBy(F.desc(key))
    return dealt.withColumn("below", F.lead(key).over(order)).join(above, "__fw_up").select(key, F.coalesce("below", "__fw_next").alias("below"))


def with_next(df: DataFrame, id_col: str, cols: list[str], tie: str, late: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """df, and next_<col> of the row with the next lower id; after the lowest comes the highest.

    Ids are whole numbers. Rows of equal id follow each other by ``tie``; a null id is the lowest. Rows are
    dealt out by ranges of ids: one shuffle, and no task has more than a range (rows of
    null id and of one id are in one range, as their order follows from ``tie`` alone).
    ``late`` adds those of ``cols`` that are dear to make, so that they are made once a row and not
    for all rows again to find the first of each range.
    """
    key = F.coalesce(F.floor(F.col(id_col) / RANGE).cast("long"), F.lit(-(1 << 62)))
    df = df.withColumn("__fw_range", key)
    order = Window.partitionBy("__fw_range").orderBy(F.desc_nulls_last(id_col), tie)
    heads = materialize(df.groupBy("__fw_range").agg(F.max(id_col).alias("__fw_head")), "ranges")
    below = _next_lower(heads.select("__fw_range"), "__fw_range")
    first = below.join(heads.select(F.col("__fw_range").alias("below"), "__fw_head"), "below").select(F.col("__fw_range").alias("__fw_for"), "__fw_head")
    few = heads.count() <= SMALL
    hint = F.broadcast if few else (lambda x: x)
    tops = df.join(hint(first), df[id_col].eqNullSafe(first["__fw_head"]))
    tops = late(tops).groupBy("__fw_for").agg(F.min(F.struct(F.col(tie).alias("__fw_tie"), *cols)).alias("__fw_row"))
    df = late(df)
    df = df.withColumn("__fw_lead", F.lead(F.struct(*cols)).over(order)).withColumn("__fw_last", F.lead(F.lit(1)).over(order).isNull())
    df = df.join(tops, df["__fw_range"] == tops["__fw_for"])
    return df.select(*[c for c in df.columns if c not in ("__fw_range", "__fw_lead", "__fw_last", "__fw_for", "__fw_row")], *[F.when(F.col("__fw_last"), F.col("__fw_row")[c]).otherwise(F.col("__fw_lead")[c]).alias(f"next_{c}") for c in cols])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links): class_id tells equal sets apart, links is the number of other classes at ``threshold`` or more; plus no pairs of copies.

    See also class_links for the pairs of classes. Null as empty text; a class's id
    is its smallest doc_id; classes of null ids only have none, and no links.
    """
    member, pairs = class_links(docs, threshold, id_col, text_col)
    both = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("links"))
    return member.join(both, member["class_id"].eqNullSafe(both["c"]), "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def class_links(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of all rows, and (a, b, likeness) of classes that are alike; a < b.

    Sets are dealt to partitions by the logarithm of their size, to the base of the
    threshold: alike sets lie in one partition or in neighbours. Within them only
    sets that share one of their rarest signatures are compared (as many as leave
    too few others to reach the threshold), the sizes first, then in full.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(with_signatures(own, "text", "sigs", common_words(own)).select("doc_id", "sigs"), "spotsigs")
    classes = materialize(marked.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "classes")
    member = marked.join(classes, "sigs").select("doc_id", "class_id")
    n = F.size("sigs")
    each = classes.where("class_id is not null").select("class_id", n.alias("n"), F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    rare = Window.partitionBy("class_id").orderBy("df", "sig")
    # signatures of one class only never link; they still take places among the rarest
    ranked = each.join(counts, "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("r", F.row_number().over(rare))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9).cast("long")
    prefix = prefix.select("class_id", "n", "sig", part.alias("part"))
    left = prefix.select(F.col("class_id").alias("x"), F.col("n").alias("nx"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("px"))
    right = prefix.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), "sig", "part")
    found = left.join(right, ["sig", "part"]).where((F.col("x") != F.col("y")) & ((F.col("px") < F.col("part")) | (F.col("x") < F.col("y"))))
    found = found.where(F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sets = classes.select("class_id", "sigs")
    full = found.join(sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
    full = full.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)
    return member, full
