"""Benchmark decontamination, by DataFrame functions only.

The windows of n words of all test items are a hash set. Every window of every document
is hashed and looked up there, a hit is held against the words themselves, and
what is hit goes: the words, or the whole document.

The set is broadcast where it is counted small; beyond, windows and set meet by
shuffle. A document's windows are made and looked up in the task that reads it, so
only its counts and hits are shuffled, under a number of its own: neither a null id, nor a
repeated row, nor a passage that many documents share gathers rows in a task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What lies between words, once A-Z are small.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
WINDOW = 10
#: The set of windows is broadcast if it has so many windows and bytes at most.
SMALL, SMALL_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """Lower-case (A-Z only) runs of digits, letters and all that isn't ASCII; null has none."""
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(small, BREAK), "")


def _hash(list_col: str, at: Column, n: int) -> Column:
    """The hash of n words from a place; fewer where the list ends."""
    return F.xxhash64(*[F.get(list_col, at + i) for i in range(n)])


def test_windows(tests: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(len, hash, gram, items): the different windows of all items, and the ids (as text, null as '') of those that have each.

    A window is n words; an item of fewer is one window, one without words has none.
    """
    each = tests.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n, F.lit(0)) + 1)
    grams = each.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(n)))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.select(F.size("gram").alias("len"), _hash("gram", F.lit(0), n).alias("hash"), "gram", "items")


def scan(docs: DataFrame, tests: DataFrame, n: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, test_id: str = "item_id", test_text: str = "text", small: int = SMALL) -> DataFrame:
    """The columns ``keep`` of docs (all, unless given) and n_words, covered (places of the words that a window hits, from 0), items (ids as text, sorted): one row for each row.

    A null text has no words; empty tables give none or no hits; repeated rows and ids
    are rows of their own; test items of one id count once, and null ids as one whose
    text is ''. Columns of docs that have one of the three names are replaced. ``small`` bounds the
    windows that are broadcast.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "covered", "items")]
    grams = materialize(test_windows(tests, test_id, test_text, n), "grams")
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items") * 24 + F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " "))), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lens")).first()
    fits = size["n"] <= small and size["bytes"] <= SMALL_BYTES
    lens = size["lens"] or [n]
    rows = docs.select(F.monotonically_increasing_id().alias("__fw_row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__fw_doc"), words(F.col(text_col)).alias("__fw_w"))
    # one row of place -1 stands for the document itself
    at = F.explode(F.sequence(F.lit(-1), F.greatest(F.size("__fw_w") - lens[0], F.lit(-1)))).alias("__fw_at")
    rows = rows.select("__fw_row", "__fw_doc", "__fw_w", at)
    place, itself = F.col("__fw_at"), F.col("__fw_at") < 0
    if len(lens) == 1:
        rows = rows.withColumn("__fw_len", F.when(itself, 0).otherwise(lens[0])).withColumn("__fw_hash", F.when(itself, F.col("__fw_row")).otherwise(_hash("__fw_w", place, lens[0])))
    else:
        each = [F.struct(F.lit(k).alias("len"), F.when(~itself & (place + k <= F.size("__fw_w")), _hash("__fw_w", place, k)).alias("hash")) for k in lens]
        own = F.struct(F.lit(0).alias("len"), F.when(itself, F.col("__fw_row")).alias("hash"))
        rows = rows.withColumn("__fw_x", F.explode(F.array(own, *each))).where("__fw_x.hash is not null").withColumns({"__fw_len": F.col("__fw_x.len"), "__fw_hash": F.col("__fw_x.hash")}).drop("__fw_x")
    gram = F.when(~itself, F.slice("__fw_w", place + 1, F.col("__fw_len")))
    if not fits:  # what is shuffled has its own words only, not those of the document
        rows = rows.select("__fw_row", F.when(itself, F.col("__fw_doc")).alias("__fw_doc"), F.when(itself, F.size("__fw_w")).alias("__fw_n"), "__fw_at", "__fw_len", "__fw_hash", gram.alias("__fw_gram"))
    found = rows.join(F.broadcast(grams) if fits else grams, (F.col("__fw_len") == F.col("len")) & (F.col("__fw_hash") == F.col("hash")), "left")
    found = found.where(itself | (F.col("gram") == (gram if fits else F.col("__fw_gram"))))
    head = F.when(itself, F.struct(F.col("__fw_doc").alias("doc"), (F.size("__fw_w") if fits else F.col("__fw_n")).cast("long").alias("n")))
    found = found.select("__fw_row", head.alias("head"), F.when(~itself, F.struct(place.alias("at"), F.col("__fw_len").alias("len"))).alias("hit"), F.when(~itself, F.col("items")).alias("items"))
    found = found.groupBy("__fw_row").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_list("hit").alias("hits"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))
    return found.select(*[F.col("head.doc")[c].alias(c) for c in keep], F.col("head.n").alias("n_words"), covered.alias("covered"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, tests: DataFrame, remove: str = "spans", n: int = WINDOW, text_col: str = "text", **names: str) -> DataFrame:
    """docs without what the tests' windows hit: the words (``spans``), each with what stands before it, or the whole rows (``documents``).

    Texts without a hit stay as they are, null ones too. See scan for odd cases.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__fw_all"), F.col(text_col).alias("__fw_text"))
    found = scan(inner, tests, n, "__fw_text", None, **names)
    if remove == "documents":
        return found.where(F.size("covered") == 0).select("__fw_all.*")
    text, last = F.col("__fw_text"), F.col("n_words").cast("int") - 1
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))
    left = F.array_except(F.sequence(F.lit(0), last), F.col("covered"))
    end = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    cut = F.concat(F.array_join(F.transform(left, lambda i: F.get("__fw_pieces", i)), ""), end)
    found = found.withColumn("__fw_pieces", F.when(F.size("covered") > 0, pieces))
    found = found.withColumn("__fw_cut", F.when(F.size("covered") > 0, cut).otherwise(text))
    return found.select(*[F.col("__fw_cut" if c == text_col else f"__fw_all.`{c}`").alias(c) for c in docs.columns])
