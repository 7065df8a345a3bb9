"""Drop lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import BLANKS, ascii_lower, checkpointed, same, stage


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(
    docs: DataFrame,
    min_documents: int = 10,
    min_chars: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All rows and columns, ``text`` without common lines, plus ``n_lines`` and ``n_dropped``.

    A line is common when its key has ``min_chars`` code points and occurs in ``min_documents``
    documents, told apart by id: rows of one id are one document, and so are all rows without an id.
    A missing or empty text is one empty line and comes back empty. Every input row comes back,
    repeated ones too. Columns named ``n_lines`` or ``n_dropped`` are replaced.

    Keys travel as 128-bit digests. Lines are numbered in their text; the positions to drop meet
    the text again by document id and text hash, so texts are shuffled once and lines never.
    """
    whole = docs.drop("n_lines", "n_dropped").withColumn(
        text, F.coalesce(F.col(text), F.lit(""))
    )
    digest = F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x: F.when(F.char_length(line_key(x)) >= min_chars, F.unhex(F.md5(line_key(x)))),
    )
    hashed = checkpointed(
        whole.select(
            F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_of"), digest.alias("_keys")
        )
    )
    # A line in as many documents is in as many rows: few keys are left to count by document.
    # Keys are stored, so that both sides of a join are dealt for it alone and a line that most
    # documents share can be split over tasks.
    often = checkpointed(
        hashed.select(F.explode(F.array_distinct("_keys")).alias("_key"))
        .where("_key IS NOT NULL")
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= min_documents)
        .select("_key")
    )
    placed = hashed.select("_id", "_of", F.posexplode("_keys").alias("_pos", "_key"))
    met = stage(placed.where("_key IS NOT NULL").join(often, "_key"), "common-lines")
    common = checkpointed(
        met.select("_key", "_id")
        .distinct()
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_documents"))
        .where(F.col("_documents") >= min_documents)
        .select("_key")
    )
    gone = met.join(common, "_key").groupBy("_id", "_of").agg(F.collect_set("_pos").alias("_gone"))
    # Whole rows travel as one struct: their column names cannot clash with those used here.
    placed = whole.select(
        F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("_row"),
        F.col(doc_id).alias("_id"),
        F.xxhash64(text).alias("_of"),
    )
    joined = placed.join(gone, same(placed, gone, "_id", "_of"), "left").select("_row", "_gone")
    split = joined.withColumn("_lines", F.split(F.col("_row").getField(text), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    cleaned = F.when(F.col("_gone").isNull(), F.col("_row").getField(text)).otherwise(rest)
    return split.select(
        *[
            (cleaned if c == text else F.col("_row").getField(c)).alias(c) for c in whole.columns
        ],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
