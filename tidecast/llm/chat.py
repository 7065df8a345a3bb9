"""Chat formatting by perspective rotation. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import checkpointed, stage

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = 512


def rotate(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system: str = "system",
    part_turns: int = PART,
) -> DataFrame:
    """``(conv_id, part, speaker, begins, n_turns, n_own, rendered, masks)``.

    One row per conversation, part and participant. The dialogue is rendered with that speaker as
    ``assistant``, other speakers as named users and ``system`` turns as they are; ``masks`` lists
    the spans (code points, end exclusive) of the speaker's own words with their closing mark, the
    only ones a loss should count.

    A conversation of at most ``part_turns`` turns is one part. A longer one is cut into parts of
    that many turns by position, whatever the turns' numbers, so that no task gathers it whole.
    ``begins`` is where a part begins in the whole dialogue as that speaker sees it, and the spans
    count from the whole dialogue's beginning; parts read one after another are that dialogue.

    Turns of equal number are ordered by role and text, those without a number come first; a
    repeated row is a repeated turn. Turns without a role belong to a speaker named ``unknown``,
    missing texts are empty. A conversation with nothing but system turns keeps one row, with a
    missing speaker and no mask. Turns without a conversation are one of their own. An empty table
    gives no row.
    """
    named = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    long = checkpointed(
        named.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns)
    ).select(F.col("conv_id").alias("_conv"))
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = named.join(long, is_long, "left_anti").withColumn("part", F.lit(0).cast("long"))
    shown = seen_by_all(whole, system)
    cut = numbered(named.join(long, is_long, "left_semi")).withColumn("part", F.floor(F.col("pos") / part_turns))
    cut = stage(seen_by_all(cut.withColumn("part", F.col("part").cast("long")), system), "parts")
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ("conv_id", "speaker", "part")
    begins = cut.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0)).alias("at"),
    )
    moved = cut.join(begins, equal(keys)).select(
        *[c for c in cut.columns if c not in ("begins", "masks")],
        F.col("at").cast("long").alias("begins"),
        F.transform(
            "masks", lambda m: F.struct((m["start"] + F.col("at")).alias("start"), (m["end"] + F.col("at")).alias("end"))
        ).alias("masks"),
    )
    return shown.unionByName(moved)


def equal(keys: Sequence[str]) -> Column:
    """Join condition between columns and those of the same names after a ``_``; missing are equal."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, from 0, by turn, role and text within each conversation.

    Rows are dealt by ranges of that order, and each range counts on from the ranges before it, so a
    conversation of any length is cut. Equal rows travel once, with their number.
    """
    order = ("turn", "role", "text")
    once = rows.groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("n"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.repartitionByRange(ranges, "conv_id", "turn", "role", F.substring("text", 1, 256))
    dealt = stage(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("_conv_id"),
        F.col("range").alias("_range"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    so_far = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("past", F.sum("n").over(so_far))
    joined = counted.join(offsets, equal(["conv_id", "range"]))
    last = F.col("offset") + F.col("past") - 1
    return joined.select(
        "conv_id", *order, F.explode(F.sequence(last - F.col("n") + 1, last)).alias("pos")
    )


def seen_by_all(named: DataFrame, system: str) -> DataFrame:
    """Every part as each speaker of the conversation sees it; spans count from the part."""
    spoke = F.when(F.col("role") != system, F.col("role"))
    # The speakers of the whole conversation, a few words each: reduced before the shuffle.
    cast = named.groupBy("conv_id").agg(F.collect_set(spoke).alias("speakers"))
    parts = named.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    alone = F.array(F.lit(None).cast("string"))
    seats = F.when(F.size("speakers") > 0, F.sort_array("speakers")).otherwise(alone)
    seated = parts.join(
        cast.select(F.col("conv_id").alias("_conv"), seats.alias("speakers")),
        F.col("conv_id").eqNullSafe(F.col("_conv")),
    ).select("conv_id", "part", "turns", F.explode("speakers").alias("speaker"))
    own = lambda t: F.coalesce(t["role"] == F.col("speaker"), F.lit(False))
    head = lambda t: F.concat(
        F.lit(OPEN),
        F.when(own(t), "assistant")
        .when(t["role"] == system, system)
        .otherwise(F.concat(F.lit("user name="), t["role"])),
        F.lit("\n"),
    )
    pieces = seated.withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                own(t).alias("own"),
                F.concat(head(t), t["text"], F.lit(CLOSE + "\n")).alias("shown"),
                F.char_length(head(t)).cast("long").alias("head"),
            ),
        ),
    )
    # Running length, one start per turn; a part has few turns, so the list stays short.
    begin = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["shown"])).alias("at"),
            F.concat(acc["all"], F.array(acc["at"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    spans = F.transform(
        F.filter(F.arrays_zip("pieces", "begin"), lambda z: z["pieces"]["own"]),
        lambda z: F.struct(
            (z["begin"] + z["pieces"]["head"]).alias("start"),
            (z["begin"] + F.char_length(z["pieces"]["shown"]) - 1).cast("long").alias("end"),
        ),
    )
    return pieces.withColumn("begin", begin).select(
        "conv_id",
        "part",
        "speaker",
        F.lit(0).cast("long").alias("begins"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("rendered"),
        spans.alias("masks"),
    )
