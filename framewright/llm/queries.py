"""The registered queries of this subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, flac, html_text, langid, lexical, mixing, packing, quality, simhash, spotsigs, substrings, token_counts
from .common import crc_fold, table


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; quanta of 64 tokens, sources weighing 5, 2, 1 in turn."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, weights=(5, 2, 1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op2_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document, counted without making them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_tokens", "token_score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of those whose fold is not 0."""
    fold = crc_fold("doc_id", 5)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold != 0), "quality")
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents over 4 words, linked within 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_chars", "other_chars")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text cut: stretches of 20 words or more that an earlier document, or the text itself, has before go."""
    docs = table(spark, sf_dir, "documents")
    found = substrings.dedup_substrings(docs, min_words=20)
    return found.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"), F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("removed_bytes"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream, read back and told by digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), flac.padded("text").alias("payload"))
    back = flac.read_column(flac.write_column(rows, keep=False))
    pcm = F.col("decoded.pcm")
    return back.select("doc_id", "n_bytes", F.octet_length(pcm).cast("long").alias("payload_bytes"), F.sha2(pcm, 256).alias("payload_sha256"), F.crc32(F.substring(pcm, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("decoded.feature").alias("feature"), flac.block_index("decoded").alias("blocks"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    anchors = spotsigs.common_words(docs)
    docs = spotsigs.with_next(docs, "doc_id", ["text", "sigs"], tie="text", late=lambda df: spotsigs.with_signatures(df, "text", "sigs", anchors))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    docs = spotsigs.with_signatures(docs, "edited", "edited_sigs", anchors)
    like = lambda other: spotsigs.likeness(F.col("sigs"), F.col(other))
    return docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spotsigs.as_text(F.col("sigs")).alias("fingerprint"), spotsigs.as_text(F.col("edited_sigs")).alias("edited_fingerprint"), like("edited_sigs").alias("near_edited"), like("next_sigs").alias("near_next"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints of all documents, and how many other classes each is alike to at 0.8 or more."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 3)
    texts = langid.training_text(docs, fold != 1)
    found = langid.identify(docs.select("doc_id", "text"), texts)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighing 5, 2, 1 in turn."""
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest score for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN b USING (t) GROUP BY r, t),
k AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT i, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN f USING (t) JOIN k USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after planted faults: what is wrong with it, and the cheapest edits that repair it."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 10 words of benchmark items hit, and which items."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10, keep=["doc_id"])
    n_hit = F.size("covered").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM b WHERE len(w) > 0),
o AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM d, (SELECT DISTINCT n FROM g)),
h AS (SELECT r, p, n, item FROM o JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and target of every source in the mix of op10."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(mixing.WORD)), F.lit(0)).cast("long")
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sizes = table(spark, sf_dir, "documents").groupBy(src.alias("src")).agg(F.sum(size).alias("source_size"))
    found = mixing.source_targets(sizes, (5, 2, 1), 3)
    return found.select(F.when(~F.col("src.none"), F.col("src.name")).alias("source"), "source_size", F.round("target", 3).alias("target"))


MIX_TARGETS = r"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w FROM sizes),
held AS (SELECT sum(3.0::DOUBLE * size) OVER o AS held, sum(w) OVER () - sum(w) OVER o AS free FROM ranked WINDOW o AS (ORDER BY 3.0::DOUBLE * size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
cuts AS (SELECT * FROM held UNION ALL SELECT 0.0, sum(w) FROM ranked),
share AS (SELECT max(((SELECT sum(size) FROM sizes)::DOUBLE - held) / free) AS share FROM cuts WHERE free > 0)
SELECT source, size AS source_size, round(least(share * w, 3.0::DOUBLE * size), 3) AS target FROM ranked, share
"""


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of what op7 stores, before it is stored."""
    payload = flac.padded("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"))


MEDIA_PAYLOADS = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
padded AS (SELECT doc_id, raw, greatest((octet_length(raw) + 575) // 576, 1) * 576 - octet_length(raw) AS short FROM raw)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(octet_length(raw) + short AS BIGINT) AS payload_bytes, sha256(raw || repeat('\xFF'::BLOB, short)) AS payload_sha256 FROM padded
"""


def media_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCM blocks that op7's streams decode to, each with the sample that it begins at."""
    docs = table(spark, sf_dir, "documents").select("doc_id", flac.padded("text").alias("payload"))
    blocks = flac.pcm_blocks(flac.read_column(flac.write_column(docs, keep=False)), ["doc_id"])
    return blocks.select("doc_id", "block", "first_sample", "n_samples", F.md5("pcm").alias("pcm_md5"))


MEDIA_BLOCKS = rf"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
padded AS (SELECT doc_id, hex(raw || repeat('\xFF'::BLOB, greatest((octet_length(raw) + 575) // 576, 1) * 576 - octet_length(raw))) AS h FROM raw),
b AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + {flac.BLOCK * flac.SEEK - 1}) // {flac.BLOCK * flac.SEEK})) AS block FROM padded),
c AS (SELECT doc_id, block, substring(h, block * {2 * flac.BLOCK * flac.SEEK} + 1, {2 * flac.BLOCK * flac.SEEK}) AS h FROM b)
SELECT doc_id, CAST(block AS INTEGER) AS block, block * {flac.BLOCK * flac.SEEK} AS first_sample, CAST(length(h) // 2 AS INTEGER) AS n_samples, md5(unhex(h)) AS pcm_md5 FROM c
"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op8: the next document is found as there."""
    return op8_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_TEXTS = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM texts)
SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - length(text) // 3) || substring(following, 1, length(text) // 3)) AS edited_sha256 FROM pairs
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators, and those of their parts that SQL can say."""
    parts = {f.__name__: f for f in (mix_targets, media_payloads, media_blocks, edited_texts, spotsigs_classes)}
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | parts


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11, "op13_decontamination": OP13, "mix_targets": MIX_TARGETS, "media_payloads": MEDIA_PAYLOADS, "media_blocks": MEDIA_BLOCKS, "edited_texts": EDITED_TEXTS}
