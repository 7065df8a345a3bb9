"""What each text filter removes, alone and behind the others.

A table-driven byte transducer reads every text once: it counts words, capitals, code points and
symbols and puts the words' spans into a hash table whose matches are verified byte by byte. What
the filters have in common is then a matter of sums over their 32 combinations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import stage, texts

# Classes of bytes, and what the transducer does in a gap and in a word.
BLANK, CAPITAL, SYMBOL, INNER, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[32, *range(9, 14)]] = BLANK
CLASS[65:91] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL
CLASS[0x80:0xC0] = INNER  # bytes of a code point after its first
GAP, WORD = 0, 1
NEXT = np.array([[GAP, WORD, WORD, WORD, WORD]] * 2, np.uint8)
POINT, UPPER, MARK, BEGIN, END = 1, 2, 4, 8, 16
EMIT = np.array(
    [
        [POINT, POINT | UPPER | BEGIN, POINT | MARK | BEGIN, BEGIN, POINT | BEGIN],
        [POINT | END, POINT | UPPER, POINT | MARK, 0, POINT],
    ],
    np.uint8,
)

FILTERS = "ABCDE"
AT_ONCE = 1 << 20  # bytes read at once; a longer text is read in several parts
LONG = 256  # bytes from which a word is hashed and compared on its own
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def transduce(buffer: np.ndarray) -> np.ndarray:
    """What the transducer emits at each byte; it starts in a gap.

    Its next state depends on the byte's class alone, so all bytes are looked up at once.
    """
    classes = CLASS[buffer]
    after = NEXT[0][classes]
    before = np.empty_like(after)
    before[0], before[1:] = GAP, after[:-1]
    return EMIT.ravel()[before * np.uint8(EMIT.shape[1]) + classes]


class Spans:
    """Words of a buffer by begin and end, eight bytes at a time."""

    def __init__(self, raw: bytes, begin: np.ndarray, end: np.ndarray):
        self.raw, self.begin, self.size = raw, begin, end - begin
        padded = raw + bytes(8)
        self.lanes = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
        self.long = self.size > LONG

    def lane(self, words: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of words, zeros past their end."""
        left = np.clip(self.size[words] - 8 * k, 1, 8).astype(np.uint64)
        return self.lanes[self.begin[words] + 8 * k] << (np.uint64(64) - left * np.uint64(8))

    def one(self, word: int) -> bytes:
        return self.raw[self.begin[word] : self.begin[word] + self.size[word]]

    def hashes(self) -> np.ndarray:
        out = self.size.astype(np.uint64)
        words, k = np.flatnonzero(~self.long), 0
        while len(words):
            h = (out[words] ^ self.lane(words, k)) * MULTIPLIER
            out[words] = h ^ (h >> np.uint64(29))
            k += 1
            words = words[self.size[words] > 8 * k]
        for w in np.flatnonzero(self.long).tolist():
            out[w] = xxhash.xxh64_intdigest(self.one(w))
        return out

    def equal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether words of equal size are equal, byte by byte."""
        same = np.ones(len(left), bool)
        at, k = np.flatnonzero(~self.long[left]), 0
        while len(at):
            same[at] = self.lane(left[at], k) == self.lane(right[at], k)
            k += 1
            at = at[same[at] & (self.size[left[at]] > 8 * k)]
        for i in np.flatnonzero(self.long[left]).tolist():
            same[i] = self.one(left[i]) == self.one(right[i])
        return same


def insert(spans: Spans, owner: np.ndarray) -> np.ndarray:
    """The words that a hash table of all (owner, word) holds: one of each.

    All words try their slot at once; a slot keeps one of those that came. Words that are verified
    to equal the one kept are done, the others try the next slot.
    """
    n = len(owner)
    bits = max(4, (2 * n).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    hashed = spans.hashes()
    mixed = (hashed ^ (owner.astype(np.uint64) * MULTIPLIER)) * MULTIPLIER
    slot = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free]] = todo[free]
        held = table[at]
        alike = (held != todo) & (hashed[held] == hashed[todo]) & (owner[held] == owner[todo])
        alike &= spans.size[held] == spans.size[todo]
        done = held == todo
        which = np.flatnonzero(alike)
        done[which] = spans.equal(held[which], todo[which])
        todo = todo[~done]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return table[table >= 0]


def count_parts(parts: list[bytes]) -> tuple[np.ndarray, Spans, np.ndarray, np.ndarray]:
    """Counts per part (words, distinct words, capitals, code points, symbols); and the distinct
    words, with the part of each word."""
    raw = b"\n".join(parts) + b"\n"
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    at = np.cumsum(sizes) - sizes
    said = transduce(np.frombuffer(raw, np.uint8))
    begin = np.flatnonzero(said & BEGIN)
    spans = Spans(raw, begin, np.flatnonzero(said & END))
    owner = np.searchsorted(at, begin, "right") - 1
    kept = insert(spans, owner)
    sums = [np.add.reduceat((said & bit) > 0, at, dtype=np.int64) for bit in (UPPER, POINT, MARK)]
    words = [np.bincount(x, minlength=len(parts)) for x in (owner, owner[kept])]
    return np.stack([*words, sums[0], sums[1] - 1, sums[2]]), spans, owner, kept


def cuts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``AT_ONCE`` bytes, each but the last followed by a blank."""
    at = 0
    while len(text) - at > AT_ONCE:
        # The first blank from there on; a word longer than a part stays whole.
        end = at + AT_ONCE
        while end < len(text) and CLASS[text[end]] != BLANK:
            end += 1
        if end == len(text):
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def count_long(text: bytes) -> np.ndarray:
    """``count_parts`` of one long text: parts are added up, their distinct words united."""
    total, seen, n = np.zeros(5, np.int64), set(), 0
    for part in cuts(text):
        counts, spans, _, kept = count_parts([part])
        total += counts[:, 0]
        seen.update(map(spans.one, kept.tolist()))
        n += 1
    total[1] = len(seen)
    total[3] += n - 1  # the blanks between parts
    return total


def count_texts(some: list[bytes]) -> np.ndarray:
    """The five counts of each text, a column per text."""
    out = np.zeros((5, len(some)), np.int64)
    run, total = [], 0
    for i, t in enumerate(some):
        if len(t) > AT_ONCE:
            out[:, i] = count_long(t)
            continue
        run.append(i)
        total += len(t)
        if total > AT_ONCE:
            out[:, run] = count_parts([some[j] for j in run])[0]
            run, total = [], 0
    if run:
        out[:, run] = count_parts([some[j] for j in run])[0]
    return out


def measure(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns plus the five counts and a 128-bit ``digest`` of the text, per row.

    Words are runs without ASCII white space, told apart by case; capitals are A-Z, symbols
    ``#$%&*|``. A missing text counts as an empty one: zeros. Texts are read whole.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_audit_text"))
    schema = T.StructType(
        [source.schema[c] for c in carry]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("digest", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = texts(b, "_audit_text")
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in some]
            cells = [*map(pa.array, count_texts(some)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *cells], schema.names)

    return source.mapInArrow(run, schema)


def failures(min_words: int, min_distinct: int, max_capitals: int) -> Column:
    """Filters A to D that a measured row fails, as bits."""
    failed = (
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
        100 * F.col("n_capitals") > max_capitals * F.col("n_chars"),
        F.col("n_symbols") > 0,
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def combinations(measured: DataFrame, labels: DataFrame, failed: Column) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the filters they fail, E included.

    ``measured`` holds ``doc_id, part, digest`` and what ``failed`` reads. A text's first document
    is the one with its smallest id; it is found by a join on text and id together, so copies of one
    text never meet in one task. Of repeated labels any that says so counts. A missing id is no
    copy, is nobody's original and has no label.
    """
    rows = measured.groupBy("doc_id", "digest", "part", failed.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    first = measured.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    whole = rows.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    full = F.col("mask") + F.when(copy, 16).otherwise(0)
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return whole.groupBy("part", full.alias("mask")).agg(
        F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic")
    )


def interactions(found: DataFrame) -> DataFrame:
    """All orders and steps from sums per part and combination: at most 32 rows a part."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (
        found.groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sums"))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    bit = "shiftleft(1, instr('ABCDE', substring(filter_order, {0}, 1)) - 1)"
    before = f"aggregate(sequence(1, 5), 0, (b, i) -> b + if(i < step, {bit.format('i')}, 0))"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(before))

    def total(which: str, value: str = "s.n") -> Column:
        return F.expr(f"aggregate(sums, 0L, (t, s) -> t + if({which}, {value}, 0L))")

    here = "(s.mask & own) > 0 and (s.mask & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("(s.mask & (own | before)) = 0").alias("kept"),
        total(here).alias("removed"),
        total("(s.mask & own) > 0 and (s.mask & before) > 0").alias("redundant"),
        total("s.mask = own").alias("unique_fails"),
        total(here, "s.good").alias("good_lost"),
        total(here, "s.toxic").alias("toxic_lost"),
        # A document that fails k filters is removed by each of them in 1 of k orders.
        total("(s.mask & own) > 0", "s.n * cast(120 div bit_count(s.mask) as long)").alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    min_words: int = 50,
    min_distinct: int = 65,
    max_capitals: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """A row per part, order of the filters A to E and step: what that filter does there.

    A: fewer than ``min_words`` words; B: distinct words below ``min_distinct`` percent of them; C:
    capitals above ``max_capitals`` percent of the code points; D: holds a symbol; E: some document
    with a smaller id has the same text. Every row is a document, repeated rows too; rows of one id
    and text are no copies of each other. A missing part is the empty one, a missing text an empty
    text. An empty table gives no row. ``labels`` holds ``doc_id, quality, toxic``; documents
    without a label count as neither good nor toxic. Other columns are not read.
    """
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).alias("text"),
    )
    failed = failures(min_words, min_distinct, max_capitals).cast("int")
    measured = stage(
        measure(source, ["doc_id", "part"]).select("doc_id", "part", "digest", failed.alias("mask")), "measured"
    )
    return interactions(combinations(measured, labels, F.col("mask")))
