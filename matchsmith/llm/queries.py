"""Registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchsmith.llm import (chat, exact_search, extraction, fill_middle, fingerprints, hard_negatives, huffman, near_join, packing,
                            pieces, quality, secret_scans, warc)
from matchsmith.llm.common import Scratch
from matchsmith.session import read_table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(read_table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids with an end id, and back."""
    ids = pieces.encode(read_table(spark, sf_dir, "documents"))
    texts = pieces.decode(ids.select(F.struct(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")).alias("row"), "ids"), key="row")
    return texts.select("row.*", F.sha2("text", 256).alias("decoded_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; values as digests."""
    found = secret_scans.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, fertility and verdict of every document."""
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text through Huffman-coded files."""
    folder = Scratch(spark, "token-files").path("files")
    huffman.store_ids(read_table(spark, sf_dir, "documents"), folder)
    back = huffman.read(spark, folder)
    return back.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every text and of its edited text."""
    return fingerprints.edited_likeness(read_table(spark, sf_dir, "documents"))


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class and number of links of every document: five words, similarity 0.8."""
    return near_join.near_join(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to an archive and back: responses with every payload held against its digest and size,
    revisits by their headers alone."""
    folder = Scratch(spark, "warc").path("archive")
    warc.register(spark)
    warc.deduplicated(read_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    read = lambda verify, kind: (spark.read.format("warc").option("payload", "false").option("verify", verify).load(folder)
                                 .filter(F.col("record_type") == kind))
    back = read("true", "response").unionByName(read("false", "revisit"))
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and packed into sequences of 4096 tokens."""
    table = Scratch(spark, "packing").table(
        packing.pieces(read_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return packing.pack(table.drop("ids"))


# A conversation whose texts hold control strings of common templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, through the written examples."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    scratch = Scratch(spark, "chat")
    return chat.read_back(scratch.table(chat.examples(scratch.table(chat.format_turns(rows), "turns")), "examples"))


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) + CASE role
      WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
      ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) END AS chars FROM rows),
placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN role = 'assistant' THEN stop ELSE 0 END) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three and rearranged, and rebuilt from the output."""
    out = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(c1, c2)], '') AS p,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every query row among all others."""
    return exact_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_VECTORS_SQL = r"""vectors AS (
  SELECT row_number() OVER () AS r, {columns}, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""

OP12_SQL = "WITH " + _VECTORS_SQL.format(columns="vec_id", scale=64) + r""",
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS cr, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor row and each of its positives, labels corrupted where the id is divisible by 7."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP13_SQL = "WITH " + _VECTORS_SQL.format(
    columns="vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", scale=256) + r""",
scored AS (
  SELECT q.r, q.vec_id AS anchor_id, c.r AS cr, c.vec_id, q.label = c.label AS same,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0 AND q.label IS NOT NULL AND c.label IS NOT NULL),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS nth FROM scored WHERE same),
mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST, n.cr) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
  WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_html_text, op2_sentencepiece, op3_secrets, op4_quality, op5_token_files, op6_fingerprints, op7_near_join, op8_warc, op9_packing,
                                  op10_chat_format, op11_fill_middle, op12_exact_search, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op10_chat_format": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_exact_search": OP12_SQL,
                           "op13_hard_negatives": OP13_SQL}
