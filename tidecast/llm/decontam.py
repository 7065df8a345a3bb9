"""Words of documents that lie in a benchmark item's windows. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ascii_lower, checkpointed

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Benchmark entries broadcast at once; an entry has at most 2 * window - 1 words.
BLOCK = 100_000


def words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters, A-Z lower-cased; none for a missing text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def entries(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """One row per word that some windows of an item are found by.

    ``items`` has ``ids`` and distinct ``words``; ``docs`` has ``words``. A window must contain all
    its words, so its rarest one is the whole necessary prefix. Rarity is the word's count in all
    documents. The windows that share a word at one place of the item start side by side; the entry
    holds the stretch they cover (``context``), the word's place in it (``at``), the number of
    windows (``n``) and their length (``width``).
    """
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode("words").alias("word"))
    blocks = -(-vocabulary.count() // BLOCK)
    parts = []
    for b in range(blocks):
        some = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)
        parts.append(seen.join(F.broadcast(some), "word"))
    if not parts:
        parts = [seen.where("false")]
    counts = reduce(DataFrame.union, parts).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    spread = items.select("ids", "words", F.posexplode("words").alias("pos", "word"))
    ranked = (
        spread.join(counts, "word", "left")
        .groupBy("ids", "words")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("count", F.lit(0)).alias("count"), "word"))).alias("places"))
    )
    n = F.size("words")
    sized = ranked.withColumn("width", F.least(n, F.lit(window)))
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0), n - F.col("width"))))
    rarest = F.array_min(
        F.transform(
            F.slice("places", F.col("start") + 1, F.col("width")),
            lambda p: F.struct(p["count"], p["word"], p["pos"]),
        )
    )
    grouped = (
        starts.withColumn("rarest", rarest)
        .groupBy("ids", "words", "width", F.col("rarest.pos").alias("pos"))
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    )
    stretch = F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("width"))
    at = F.col("pos") - F.col("lo")
    return grouped.select(
        "ids",
        "width",
        (F.col("hi") - F.col("lo") + 1).alias("n"),
        stretch.alias("context"),
        at.alias("at"),
        F.get("words", "pos").alias("key"),
        F.get(stretch, at - 1).alias("prev"),
        F.get(stretch, at + 1).alias("next"),
    )


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)``, a row per input row.

    A document word is hit inside any occurrence of a window: ``window`` consecutive words of an
    item, or all of a shorter item. ``items`` lists the ids of items with occurring windows, each
    once. Missing texts have no words; an item without words has no window, one without id marks
    words but is not listed. Empty tables find nothing. Other columns are not read.

    Documents are read twice, for word counts and for matching, and never shuffled: words meet the
    broadcast entries in the scan, at the rarest word of a window. Length and position, and a
    neighbouring word, are bounds of that join; survivors are compared word by word. The benchmark
    goes through in blocks of a fixed number of entries, so any size of it is searched.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).select(
        "id", F.xxhash64("text").alias("of"), words(F.col("text")).alias("words")
    )
    items = (
        benchmark.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item")).alias("ids"))
    )
    items = checkpointed(items.select("ids", "words"))
    found = checkpointed(entries(items, source, window))
    total = found.count()
    blocks = max(1, -(-total // BLOCK))
    # An empty word ends every document: it meets an entry of its own, so that documents without
    # a match keep a row in the same pass.
    ended = source.select("id", "of", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    blank = found.sparkSession.range(1).select(
        F.lit(None).cast(found.schema["ids"].dataType).alias("ids"),
        F.lit(0).alias("width"),
        F.lit(0).alias("n"),
        F.array(F.lit("")).alias("context"),
        F.lit(0).alias("at"),
        F.lit("").alias("key"),
        F.lit(None).cast("string").alias("prev"),
        F.lit(None).cast("string").alias("next"),
    )
    matches = []
    for b in range(blocks):
        part = found.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        part = part.union(blank) if b == 0 else part
        near = (
            (F.size("context") == 1)
            | F.coalesce(F.get("words", F.col("pos") - 1) == F.col("prev"), F.lit(False))
            | F.coalesce(F.get("words", F.col("pos") + 1) == F.col("next"), F.lit(False))
        )
        fits = F.size("words") >= F.col("width")
        matches.append(ended.join(F.broadcast(part), (F.col("word") == F.col("key")) & fits & near))
    # Only the words around a place leave the join: a long text is not copied for every match.
    first = F.col("pos") - F.col("at")
    met = reduce(DataFrame.union, matches).select(
        "id",
        "of",
        F.size("words").cast("long").alias("n_words"),
        (F.col("word") == "").alias("end"),
        "ids",
        "width",
        "n",
        "context",
        first.alias("first"),
        F.slice("words", F.greatest(first, F.lit(0)) + 1, F.col("n") + F.col("width")).alias("near"),
    )
    begin = F.col("first")
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: begin + j),
        lambda s: (s >= 0)
        & (s + F.col("width") <= F.col("n_words"))
        & (
            F.slice("near", F.greatest(s, F.lit(0)) - F.greatest(begin, F.lit(0)) + 1, F.col("width"))
            == F.slice("context", s - begin + 1, F.col("width"))
        ),
    )
    hit = F.array_distinct(
        F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("width") - 1)))
    )
    none = F.array().cast("array<int>")
    # A generator, not a filter: a filter would move below the slice and see whole texts.
    outcome = F.when(F.col("end"), F.array(none)).otherwise(F.filter(F.array(hit), lambda h: F.size(h) > 0))
    verified = met.select(
        "id",
        "of",
        "n_words",
        "end",
        F.when(~F.col("end"), F.col("ids")).alias("ids"),
        F.explode(outcome).alias("hit"),
    )
    # Repeated rows meet in one group and leave it as often as they came.
    merged = verified.groupBy("id", "of", "n_words").agg(
        F.count(F.when(F.col("end"), 1)).alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return merged.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        "items",
        copies,
    ).drop("copy")
