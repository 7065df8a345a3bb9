"""Secret scanning through a ledger of content-addressed blobs.

A blob is a text, named by its SHA-256. The ledger says which (blob, rule version) pairs have been
scanned and what they showed, so a run scans only pairs that no earlier run has seen: all rules on a
new blob, a new or changed rule on the old ones. Every row that carries a blob, a path's present text
or an older version of it, gets its findings by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import batches, checkpointed, texts

# The base kinds, in their order, then the added ones. A pattern with a group is
# held to the length of the group, one without to the length of the match.
BASE = ("assign", "access", "hex")
RULES: dict[str, tuple[str, int]] = {
    "assign": (
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),  # the runs of [0-9a-f]+ that are long enough
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
}
# Only assignments are slow to search for; a text without any of these has none.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rule_versions array<string>, spans {SPANS}"
SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)


def rule_versions() -> dict[str, str]:
    """The present version of each rule; it changes with the rule alone."""
    named = {kind: repr((kind, rule)).encode() for kind, rule in RULES.items()}
    return {kind: f"{kind}:{hashlib.sha256(text).hexdigest()[:16]}" for kind, text in named.items()}


def compiled(rules: dict[str, tuple[str, int]] | None = None) -> dict[str, tuple[re.Pattern, int]]:
    rules = RULES if rules is None else rules
    return {kind: (re.compile(pattern, re.ASCII), least) for kind, (pattern, least) in rules.items()}


def find_spans(text: str, rules: dict[str, tuple[re.Pattern, int]]) -> list[dict]:
    """All spans by start, then kind as listed; code points, end exclusive.

    Matches of a kind are leftmost and do not overlap; those that are too short are dropped after
    they have been passed over.
    """
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    out, kinds = [], list(rules)
    for order, (kind, (pattern, least)) in enumerate(rules.items()):
        if kind == "assign" and not hinted:
            continue
        for m in pattern.finditer(text):
            if len(m.group(pattern.groups)) >= least:
                out.append((m.start(), order, m.end()))
    return [{"kind": kinds[k], "start": a, "end": b} for a, k, b in sorted(out)]


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def blob_store(docs: DataFrame, text: str) -> DataFrame:
    """``(blob, packed)``, one row per distinct text. Texts are packed before they are shuffled."""
    schema = pa.schema([("blob", pa.binary()), ("packed", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in parts:
            once = {hashlib.sha256(t).digest(): t for t in texts(b, "text")}
            yield from batches(
                {"blob": list(once), "packed": [pack(t) for t in once.values()]}, schema
            )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "blob binary, packed binary")
    return rows.groupBy("blob").agg(F.first("packed").alias("packed"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks.

    Append them to the ledger. A missing text is the empty blob; an empty table gives no row.
    """
    versions, store, present = rule_versions(), blob_store(docs, text), dict(RULES)
    wanted = F.array(*map(F.lit, versions.values()))
    store = store.withColumn("todo", wanted)
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rule_versions")).alias("known"))
        todo = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        store = store.drop("todo").join(known, "blob", "left").select("blob", "packed", todo.alias("todo"))
        store = store.where(F.size("todo") > 0)
    schema = pa.schema(
        [("blob", pa.binary()), ("rule_versions", pa.list_(pa.string())), ("spans", SPAN_TYPE)]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        rules = {versions[kind]: (kind, rule) for kind, rule in compiled(present).items()}
        for b in parts:
            todo = b.column("todo").to_pylist()
            spans = [
                find_spans(unpack(z).decode(), dict(rules[v] for v in which))
                for z, which in zip(b.column("packed").to_pylist(), todo)
            ]
            yield from batches(
                {"blob": b.column("blob").to_pylist(), "rule_versions": todo, "spans": spans}, schema
            )

    return store.mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, without rows if nothing has been written there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Scan what the stored ledger at ``path`` lacks, append it there, and read the whole ledger.

    ``path`` lies in a folder that all executors share. An aborted run appends nothing.
    """
    spark = docs.sparkSession
    scan_unseen(docs, read_ledger(spark, path), text).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns plus ``spans`` from the ledger, without the text itself.

    Every path and version of a blob gets its spans, repeated rows included. Spans of older rules
    do not count. A blob that no present rule has scanned has missing spans. A column named
    ``spans`` is replaced.
    """
    present = rule_versions()
    pairs = F.create_map(*[F.lit(x) for pair in present.items() for x in pair])
    valid = F.filter("spans", lambda s: F.array_contains("rule_versions", pairs[s["kind"]]))
    kinds = F.array(*map(F.lit, present))
    # A blob that several runs have scanned has a row of each; their spans come together again.
    placed = F.transform(
        valid, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("nth"), s["kind"], s["end"])
    )
    current = F.arrays_overlap("rule_versions", F.array(*map(F.lit, present.values())))
    # Stored, so that a blob that most paths carry can be split over tasks in the join.
    known = checkpointed(
        ledger.where(current)
        .groupBy(F.col("blob").alias("_blob"))
        .agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("_placed"))
        .select("_blob", F.transform("_placed", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("_spans"))
    )
    others = [c for c in docs.columns if c not in (text, "spans")]
    paths = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"),
        blob_name(F.col(text)).alias("_blob"),
    )
    joined = paths.join(known, "_blob", "left")
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in others], F.col("_spans").alias("spans")
    )
