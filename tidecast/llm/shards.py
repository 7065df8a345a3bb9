"""Balanced shards by sampled splitters. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import checkpointed

# Sampled keys per range: with 32, a range holds half to twice its share almost always.
OVERSAMPLING = 32


def splitters(keys: DataFrame, ranges: int, seed: int) -> list:
    """Boundaries that cut the bytes of ``keys`` (``key``, ``size``) into about equal ranges.

    A row is drawn with a chance in proportion to its size, by a hash, so that a repeated task
    draws the same rows. About ``ranges * OVERSAMPLING`` keys, whatever the input, reach the driver.
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return []
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chance = F.col("size") * (ranges * OVERSAMPLING / total)
    drawn = keys.where(draw < chance).select("key", F.ceil(chance).alias("weight"))
    sample = sorted(drawn.collect(), key=lambda r: tuple(r.key))
    step = sum(r.weight for r in sample) / ranges
    bounds, past = [], 0.0
    for row in sample:
        past += row.weight
        if past >= step * (len(bounds) + 1) and (not bounds or tuple(row.key) > bounds[-1]):
            bounds.append(tuple(row.key))
    return bounds


def range_of(key: Column, bounds: list, schema: T.DataType) -> Column:
    """Number of boundaries not above the key: one look at every 32nd, one inside a group."""
    if not bounds:
        return F.lit(0)
    width = 32
    named = [{f"k{i}": v for i, v in enumerate(b)} for b in bounds]
    groups = [named[i : i + width] for i in range(0, len(named), width)]
    # As JSON text, which the optimiser folds into one literal.
    of = T.ArrayType(schema)
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), of)
    inside = F.from_json(F.lit(json.dumps(groups)), T.ArrayType(of))
    group = F.size(F.filter(firsts, lambda b: b <= key))
    below = F.size(F.filter(F.get(inside, group - 1), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + below)


def assign_shards(
    docs: DataFrame,
    shards: int,
    size: str,
    key: list[str],
    ranges_per_shard: int = 16,
    seed: int = 7,
) -> DataFrame:
    """All rows and columns plus ``shard`` (int) and ``slot`` (long, 0, 1, ... in the shard).

    Rows are laid out in the order of ``key``; shard ``i`` holds those whose first byte falls in
    the i-th of ``shards`` equal parts of all bytes, so shards differ by less than two rows' sizes.
    The result is a function of the rows alone; sampling only spreads the work. Key columns must be
    long or text. Missing keys come first; rows with equal keys lie side by side, in any order.
    Rows of missing or negative size count as 0 bytes. Columns ``shard`` and ``slot`` are replaced.

    Splitters cut the key space into ranges of about equal bytes. Ranges that come out overfull are
    sampled again and subdivided. A key column that is distinct by row (as a document id) splits
    even one text that holds a third of all rows. Exact bytes of the ranges, a table bounded by
    their number, give each range its first byte; the rest is a running sum inside ranges.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = docs.drop("shard", "slot")
    fill = [
        F.struct(
            F.col(k).isNotNull().alias(f"k{2 * i}"),
            (F.coalesce(F.col(k), F.lit("")) if t == "string" else
             F.coalesce(F.col(k).cast("long"), F.lit(0))).alias(f"k{2 * i + 1}"),
        )
        for i, (k, t) in enumerate((k, dict(whole.dtypes)[k]) for k in key)
    ]
    flat = F.struct(*[f.getField(f"k{2 * i + j}").alias(f"k{2 * i + j}") for i, f in enumerate(fill) for j in (0, 1)])
    bytes_ = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = whole.select(
        F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("row"),
        flat.alias("key"),
        bytes_.alias("size"),
    )
    keys = rows.select("key", "size")
    kind = keys.schema["key"].dataType
    bounds = splitters(keys, shards * ranges_per_shard, seed)
    share = (keys.agg(F.sum("size")).first()[0] or 0) / (shards * ranges_per_shard)
    # Equal whole keys cannot be told apart, so two rounds without progress end the subdivision.
    for again in range(4):
        placed = keys.withColumn("range", range_of(F.col("key"), bounds, kind))
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * share)
        over = {r.range: r.bytes for r in full.collect()}
        if not over or not share:
            break
        inside = placed.where(F.col("range").isin(list(over)))
        more = splitters(inside, int(sum(over.values()) / share) + 1, seed + again + 1)
        if set(more) <= set(bounds):
            break
        bounds = sorted(set(bounds) | set(more))
    ranged = rows.withColumn("range", range_of(F.col("key"), bounds, kind))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most a few times shards * ranges_per_shard rows, whatever the input.
    starts = checkpointed(
        sums.select(
            "range",
            F.coalesce(F.sum("bytes").over(past), F.lit(0)).alias("byte0"),
            F.coalesce(F.sum("n").over(past), F.lit(0)).alias("row0"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    order = Window.partitionBy("range").orderBy("key", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumns(
        {
            "byte": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "nth": F.row_number().over(order) - 1,
        }
    ).join(F.broadcast(starts), "range")
    # In decimals, since bytes times shards may pass the longs' range.
    first = (F.col("byte0") + F.col("byte")).cast("decimal(28,0)")
    part = F.floor(first * shards / F.greatest(F.col("total"), F.lit(1))).cast("int")
    laid = numbered.select(
        "row",
        "range",
        F.least(part, F.lit(shards - 1)).alias("shard"),
        (F.col("row0") + F.col("nth")).alias("rank"),
    )
    begins = checkpointed(laid.groupBy("shard").agg(F.min("rank").alias("rank0")))
    out = laid.join(F.broadcast(begins), "shard")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in whole.columns],
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - F.col("rank0")).cast("long").alias("slot"),
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    placed = assigned.repartition("shard", F.floor(F.col("slot") / 1_000_000))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
