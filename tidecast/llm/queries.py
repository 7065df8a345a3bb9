"""The registered queries ``opN_<name>`` and the SQL they must agree with.

Each query reads whole tables, runs its operator and derives the columns of its contract.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import (
    audit,
    blobscan,
    chat,
    decontam,
    langid,
    lines,
    lm,
    packing,
    quality,
    shards,
    simhash,
    topk,
    variants,
)
from tidecast.llm.common import shared_folder
from tidecast.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash")
def op1(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, distance=2)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


BLANK_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM split),
keyed AS (SELECT *, {LOWER_SQL.format(f"trim(line, {BLANK_SQL})")} AS key FROM line),
common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10)
SELECT doc_id, max(n)::BIGINT AS n_lines,
       count(*) FILTER (c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), ''))
         AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.drop_common_lines(docs, min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_sharding")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    )
    laid = shards.assign_shards(shards.checkpointed(sized), 40, "size", ["group", "doc_id"])
    return laid.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The windows of an item are compared as lists, so the twin is the plain definition.
OP10_SQL = rf"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL.format("coalesce(text, '')")},
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array({LOWER_SQL.format("coalesce(text, '')")},
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width,
         w[s:(s + least(len(w), 10) - 1)] AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, s, w[s:(s + width - 1)] AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s
        FROM doc, widths WHERE len(w) >= width)),
met AS (SELECT p.doc_id, p.s, p.width, i.item_id FROM places p JOIN windows i USING (width, win)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + width)) AS pos FROM met) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items,
         sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op10_decontamination", OP10_SQL)
def op10(spark, folder):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontam.find_overlap(docs, bench, window=10)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_secret_scan")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = blobscan.update_ledger(docs, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    found = blobscan.findings(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*blobscan.BASE))
    named = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in blobscan.BASE],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


OP6_SQL = f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
placed AS (
  SELECT *, (row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1)::BIGINT AS pos FROM named),
speakers AS (
  SELECT DISTINCT c.conv_id, s.role AS speaker
  FROM (SELECT DISTINCT conv_id FROM named) c
  LEFT JOIN (SELECT DISTINCT conv_id, role FROM named WHERE role <> 'system') s
    ON c.conv_id = s.conv_id),
shown AS (
  SELECT n.*, speaker, coalesce(role = speaker, false) AS own,
         '{chat.OPEN}' || CASE WHEN coalesce(role = speaker, false) THEN 'assistant'
           WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM placed n JOIN speakers s ON n.conv_id = s.conv_id),
pieces AS (
  SELECT *, head || text || '{chat.CLOSE}' || chr(10) AS piece,
         coalesce(sum(length(head || text || '{chat.CLOSE}' || chr(10))) OVER (
           PARTITION BY conv_id, speaker ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM shown)
SELECT conv_id, pos // {chat.PART} AS part, speaker, count(*)::BIGINT AS n_turns,
       count(*) FILTER (own)::BIGINT AS n_own, min(begins)::BIGINT AS begins,
       string_agg(piece, '' ORDER BY pos) AS rendered,
       coalesce(string_agg((begins + length(head))::VARCHAR || ':' ||
         (begins + length(piece) - 1)::VARCHAR, ',' ORDER BY begins) FILTER (own), '') AS masks
FROM pieces GROUP BY conv_id, pos // {chat.PART}, speaker"""


@query("op6_chat_formatting", OP6_SQL)
def op6(spark, folder):
    shown = chat.rotate(table(spark, folder, "conversations"))
    spans = F.transform(
        "masks",
        lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")),
    )
    return shown.withColumn("masks", F.array_join(spans, ","))


def remainder(modulus: int):
    """crc32 of the document id as text, modulo; a missing id counts as empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % modulus


@query("op7_language_id")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(remainder(4) != 2))
    asked = docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text")
    found = langid.identify(asked, model, carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_packing")
def op8(spark, folder):
    import public_tokenizers

    packed = packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 2
    )
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q),
           lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
        AS INTEGER) AS rank FROM scored)
WHERE rank <= 20"""


@query("op9_exact_topk", OP9_SQL)
def op9(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), k=20, every=20, scale=64)


@query("op2_lm_scoring")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", (remainder(10) == 0).alias("held_out"), "text"
    )
    counts, lex = lm.count(docs.where("NOT held_out"))
    coded = lm.code_texts(docs, lex.tokens, ["doc_id", "held_out"], "text", ~F.col("held_out"))
    model = lm.fit(coded, counts, lex)
    return lm.score_coded(coded, model, ["doc_id", "held_out"], taught=True)


@query("op11_quality")
def op11(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.where(remainder(5) != 0))
    asked = docs.withColumn("held_out", remainder(5) == 0)
    scored = quality.score(asked, model, threshold=0.3, carry=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


# The letters of an order are drawn one by one; the first document of a text is its smallest id.
OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
lab AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
         coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         {'A': len(w) < 50,
          'B': 100 * len(list_distinct(w)) < 65 * len(w),
          'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM doc d LEFT JOIN lab l ON d.doc_id = l.doc_id),
fails AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x:
    CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS failed
  FROM flagged),
sums AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own,
         string_split(left(filter_order, step - 1), '') AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT part, filter_order, step, n, good, toxic, len(failed) AS k,
         list_contains(failed, own) AS fails, step > 1 AND list_has_any(failed, before) AS gone
  FROM sums, steps)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(k, 1))) FILTER (fails), 0)::BIGINT AS shapley
FROM told GROUP BY part, filter_order, step"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_spelling_variants")
def op13(spark, folder):
    return variants.spelling_variants(
        table(spark, folder, "documents"), min_chars=6, min_count=5, ratio=5, damage=199
    )
