"""Near-duplicates by SimHash: meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the
radius share a variant, so a shuffle on variants meets every pair; a variant's group holds at most
one ball of fingerprints, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import checkpointed, texts
from tidecast.llm.components import components

BITS, SEED, HASHES_AT_ONCE = 64, 42, 1 << 16


def simhash(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        some = words[at : at + HASHES_AT_ONCE + shingle - 1]
        parts = [some[i:] for i in range(shingle)] if len(words) > shingle else [[b" ".join(words)]]
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in zip(*parts)), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(0, dtype=np.int64)
    ones = np.packbits(2 * counts > n, bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint)``, a row per input row; the fingerprint as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle make one
    shingle; a missing text or one without words has fingerprint 0.
    """
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = pa.array([simhash(t, shingle) for t in texts(b, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], ["doc_id", "fingerprint"])

    schema = T.StructType([kept.schema["doc_id"], T.StructField("fingerprint", T.LongType())])
    return kept.mapInArrow(run, schema)


def ball(radius: int) -> list[tuple[int, int]]:
    """(mask, bits set) for all masks of at most ``radius`` bits, as signed longs."""
    out = []
    for k in range(radius + 1):
        for bits in combinations(range(BITS), k):
            mask = sum(1 << i for i in bits)
            out.append((mask - (1 << BITS) if mask >> (BITS - 1) else mask, k))
    return out


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints within ``distance`` bits.

    Around a variant, each fingerprint is linked to one centre instead of to all others: the
    smallest of those no further than ``distance // 2``. With the other at most
    ``(distance + 1) // 2`` away their distance is within the radius, so no true link is lost, and
    the bit count of the pair is checked again.
    """
    masks = ball((distance + 1) // 2)
    table = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(k).alias("off")) for m, k in masks])
    spread = distinct.select("fingerprint", F.inline(table)).select(
        "fingerprint", "off", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")
    )
    inner = F.when(F.col("off") <= distance // 2, F.col("fingerprint"))
    met = spread.withColumn("centre", F.min(inner).over(Window.partitionBy("variant")))
    pairs = met.where("fingerprint <> centre").select(
        F.col("fingerprint").alias("u"), F.col("centre").alias("v")
    )
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return pairs.distinct().where(apart <= distance)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` bits, the
    row's own included; missing ids count for no minimum, and a component of nothing else has a
    missing one. Equal fingerprints, and so repeated rows, are one node. An empty table gives none.
    """
    if not 0 <= distance <= 4:
        raise ValueError("a distance of 0 to 4 bits is supported: larger balls hold too many variants")
    marked = checkpointed(fingerprints(docs, shingle, doc_id, text))
    nodes = checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fingerprint"), distance))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    # Stored, as in the components: one component, or one fingerprint, may have a third of all rows.
    smallest = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(rooted.join(smallest, "root").select("fingerprint", "component_id"))
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
