"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class, token before). The first factor's
background is a softmax over a fixed number of classes with hashed n-gram and skip features, trained
by iterative scaling under a Gaussian prior until its constraints are met: each round sums expected
counts over all tasks, so the weights do not depend on how the texts are dealt. On top of it, and within a class, every pair of neighbours
that training has seen is a hashed feature. These features do not overlap, so their constraint, that
a pair's expected count is its discounted observed one, is met in closed form. Their table grows with
the corpus; it is dealt by hash, and texts ask it through a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import batches, checkpointed, stage

ALPHA = 0.1
END = b""  # the end of a text; no word is empty

HEAD = 1 << 17  # tokens whose counts every task holds; the others' counts are joined
TOP = 4096  # most frequent tokens, each a unit of its own
SUFFIXES = 4096  # all other tokens are units by the hash of their last three bytes
UNITS = TOP + SUFFIXES
NEAR = 32  # frequent tokens whose company, before and after, describes a unit
GROUPS, BANDS = 8, 2
# Classes: groups x frequency bands of top tokens, groups of other tokens, and the end.
CLASSES = GROUPS * (BANDS + 1) + 1
END_CLASS = CLASSES - 1
STOP = -(1 << 30)  # the code of a text's end
START = CLASSES  # the class, only as context, of what lies before a text
PAIRS = (CLASSES + 1) ** 2
HASHED = 8192
# Feature rows: the word before; classes of the two before; of the third and fourth before (a
# skip); the hashed pair of words before.
OFFSETS = (0, UNITS + 1, UNITS + 1 + PAIRS, UNITS + 1 + 2 * PAIRS)
ROWS = UNITS + 1 + 2 * PAIRS + HASHED
FEATURES = len(OFFSETS)  # of every place
BATCH, ADDED = 8192, 32768
# Iterative scaling: its exponent while that helps, else 1 / FEATURES, which always does; the prior's
# variance; and the share of the observed counts by which the constraints may be missed in the end.
STEP, VARIANCE, MISSED = 0.4, 1.0, 0.02
PSEUDO = 4.0  # counts that keep a first guess finite
# Pairs of neighbours: bits of the word before and of the class in a key; what is taken off counts.
BEFORE_BITS, CLASS_BITS, TOKEN_BITS = 34, 6, 24
ALONE = (1 << CLASS_BITS) - 1  # the class that marks the key of a token by itself
DISCOUNT, CLASS_DISCOUNT = 0.75, 0.5
SHARD_TOKENS = 1 << 20
ROWS_AT_ONCE = 512  # rows of the table of class sums that travel together
RUN_WORDS = 1 << 19  # of a run of texts, which is read and asks the table at once
TEXT_BYTES = 1 << 22  # of texts that are split at once, a longer text alone
COUNTED = 300_000  # distinct tokens that a task counts before it hands them on


def suffix_unit(token: bytes) -> int:
    return TOP + zlib.crc32(token[-3:]) % SUFFIXES


def suffix_column(token: Column) -> Column:
    return F.crc32(F.substring(token, -3, 3)) % SUFFIXES + TOP


@dataclass
class Lexicon:
    """What every task knows: bounded by HEAD tokens and UNITS units."""

    tokens: list[bytes]  # most frequent first, without the end
    counts: np.ndarray
    ends: int
    total: int
    distinct: int
    classes: np.ndarray = field(default_factory=lambda: np.zeros(UNITS, np.int64))
    # log10 of P(token | class) of head tokens; of the denominator per class.
    inside: np.ndarray = field(default_factory=lambda: np.zeros(0))
    below: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.float32))

    @property
    def base_below(self) -> float:
        return math.log10(self.total + ALPHA * (self.distinct + 1))


class Coder:
    """Token to its rank in the head; the code of any other is minus its suffix unit."""

    def __init__(self, tokens: list[bytes]):
        self.known = pa.array(tokens, pa.binary())

    def code(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """Codes of words; those of rare ones are below zero."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        found = np.array(pc.fill_null(pc.index_in(words, value_set=self.known), -1))
        rare = np.flatnonzero(found < 0)
        found[rare] = [-suffix_unit(w) for w in words.take(pa.array(rare)).to_pylist()]
        return found


def words_of(b: pa.RecordBatch, name: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Lower-cased words of the texts of a batch, and how many each text has, TEXT_BYTES at a time.

    A missing text has none. Only A-Z are lower-cased, and only the six ASCII blanks part words.
    """
    column = pc.fill_null(b.column(name).cast(pa.binary()), b"").view(pa.string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin = starts(np.cumsum(sizes, dtype=np.int64) // TEXT_BYTES).tolist()
    for first, end in zip(begin, [*begin[1:], len(column)]):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(first, end - first)))
        words = parts.flatten().view(pa.binary())  # with empty ones at blank ends
        real = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        yield words.filter(real), np.diff(before[parts.offsets.to_numpy()])


def head_units(tokens: list[bytes]) -> np.ndarray:
    """The unit of each head token, by rank."""
    return np.array([i if i < TOP else suffix_unit(t) for i, t in enumerate(tokens)], np.int64)


def stream(codes: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, units, tokens per text) of texts laid end to end, given their words' codes.

    There is one more place after each text, its end: code STOP, unit UNITS.
    """
    sizes = lengths + 1
    ends = np.cumsum(sizes) - 1
    out = np.full(sizes.sum(), STOP, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = codes
    own = np.where(out >= 0, units[np.maximum(out, 0)] if len(units) else 0, -out)
    own[ends] = UNITS
    return out, own, sizes


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(token, n)`` over all texts, summed in the tasks before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
        ends, held = 0, schema.empty_table()
        for b in parts:
            ends += len(b)
            for words, _ in words_of(b, "text"):
                new = pa.Table.from_arrays(words.value_counts().flatten(), schema=schema)
                held = pa.concat_tables([held, new])
                if len(held) > 2 * COUNTED:
                    sums = held.group_by("token", use_threads=False).aggregate([("n", "sum")])
                    held = sums.select(["token", "n_sum"]).rename_columns(schema.names)
                if len(held) > COUNTED:
                    yield from held.to_batches(1 << 16)
                    held = schema.empty_table()
        yield from held.to_batches(1 << 16)
        if ends:
            yield from batches({"token": [END], "n": [ends]}, schema)

    rows = docs.mapInArrow(run, "token binary, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals, and the tokens above a count that at most HEAD tokens reach."""
    total, distinct, ends = counts.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("token") == END, F.col("n")))
    ).first()
    words = counts.where(F.col("token") != END)
    # Sixteen steps per doubling, so the histogram has at most a thousand rows.
    step = F.floor(16 * F.log2("n"))
    sizes = words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, room = None, HEAD
    for row in sizes:
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    head = [] if least is None else words.where(step >= least).collect()
    head.sort(key=lambda r: (-r.n, bytes(r.token)))
    return Lexicon(
        [bytes(r.token) for r in head], np.array([r.n for r in head], np.int64), ends or 0, total or 0, distinct or 0
    )


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of all of them, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(cell: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind)[:, 0] if raw.size else np.zeros(0, kind)


def code_texts(
    docs: DataFrame, tokens: list[bytes], carry: list[str], text: str, learns: Column | None = None
) -> DataFrame:
    """Texts as codes, stored in runs of bounded bytes, a row each; a longer text is a run of its own.

    ``run`` is the run's number, ``kept`` the ``carry`` columns and the row number ``_lm_row`` of its
    texts, ``learns`` which of them teach (all if not given), ``lengths`` their words, ``codes`` the
    words' codes, ``sums`` the checksums of the rare ones, and ``tails`` those words with their rows.
    Words are looked up once; all passes read the codes. The stored row number stands for the row
    wherever its parts meet again.
    """
    taught = F.lit(True) if learns is None else F.coalesce(learns, F.lit(False))
    source = docs.select(
        *[F.col(f"`{c}`") for c in carry], taught.alias("_lm_learns"), F.col(text).alias("_lm_text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    row_of = T.StructField("_lm_row", T.LongType())
    listed = T.StructType([*[source.schema[c] for c in carry], row_of])
    tail = T.StructType([T.StructField("_lm_of", T.LongType()), T.StructField("token", T.BinaryType())])
    schema = T.StructType(
        [T.StructField("run", T.LongType()), T.StructField("kept", T.ArrayType(listed))]
        + [T.StructField("learns", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("codes", "sums")]
        + [T.StructField("tails", T.ArrayType(tail))]
    )
    tail_type = pa.struct([("_lm_of", pa.int64()), ("token", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = Coder(shared.value), TaskContext.get().partitionId() << 40

        def flush(b: pa.RecordBatch, first: int, held: list[tuple]) -> pa.RecordBatch:
            codes, lengths = (np.concatenate(x) for x in list(zip(*held))[:2])
            words = pa.concat_arrays([rare for *_, rare in held])
            part = b.slice(first, len(lengths))
            rows = np.arange(row + first, row + first + len(lengths))
            kept = pa.StructArray.from_arrays([*[part.column(c) for c in carry], pa.array(rows)], [*carry, "_lm_row"])
            sums = np.array([*map(zlib.crc32, words.to_pylist())], "<u4")
            of = pa.array(np.repeat(rows, lengths)[codes < 0])
            tails = pa.StructArray.from_arrays([of, words], fields=list(tail_type))
            ends = pa.array([0, len(lengths)], pa.int32())
            cells = [
                pa.array([row + first]),
                pa.ListArray.from_arrays(ends, kept),
                pa.ListArray.from_arrays(ends, part.column("_lm_learns")),
                pa.ListArray.from_arrays(ends, pa.array(lengths)),
                pa.array([pack(codes.astype("<i4"))]),
                pa.array([pack(sums)]),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), tails),
            ]
            return pa.RecordBatch.from_arrays(cells, schema.names)

        for b in parts:
            first, total, held = 0, 0, []
            for words, lengths in words_of(b, "_lm_text"):
                codes, ends, i = coder.code(words), np.cumsum(lengths), 0
                while i < len(lengths):
                    # Up to the text with which the run is full.
                    at = int(ends[i] - lengths[i])
                    j = min(int(np.searchsorted(ends, at + RUN_WORDS - total)) + 1, len(lengths))
                    own, n = codes[at : ends[j - 1]], int(ends[j - 1]) - at
                    held.append((own, lengths[i:j], words.slice(at, n).filter(pa.array(own < 0))))
                    total, i = total + n, j
                    if total >= RUN_WORDS:
                        yield flush(b, first, held)
                        first += sum(len(x) for _, x, _ in held)
                        total, held = 0, []
            if held:
                yield flush(b, first, held)
            row += len(b)

    return stage(source.mapInArrow(run, schema), "codes")


def read_texts(b: pa.RecordBatch, i: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, units, tokens per text, and which places belong to texts that teach, of one run."""
    lengths = b.column("lengths")[i].values.to_numpy(zero_copy_only=False)
    codes, units, sizes = stream(unpack(b.column("codes")[i].as_py(), "<i4"), lengths, head)
    taught = np.repeat(b.column("learns")[i].values.to_numpy(zero_copy_only=False).astype(bool), sizes)
    return codes, units, sizes, taught


def company(coded: DataFrame, lex: Lexicon) -> np.ndarray:
    """For each unit, how often each of the NEAR most frequent tokens stands before and after it."""
    shared = coded.sparkSession.sparkContext.broadcast(head_units(lex.tokens))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(UNITS * 2 * NEAR, np.int64)
        for b in parts:
            for i in range(len(b)):
                codes, units, _, taught = read_texts(b, i, shared.value)
                codes, units = codes[taught], units[taught]
                for mine, other, side in ((units[1:], codes[:-1], 0), (units[:-1], codes[1:], NEAR)):
                    met = np.flatnonzero((other >= 0) & (other < NEAR) & (mine < UNITS))
                    np.add.at(sums, mine[met] * 2 * NEAR + other[met] + side, 1)
        rows = sums.reshape(UNITS, 2 * NEAR)
        used = np.flatnonzero(rows.any(1))
        schema = pa.schema([("unit", pa.int64()), ("met", pa.list_(pa.float64()))])
        yield from batches({"unit": used, "met": list(rows[used].astype(float))}, schema)

    met = coded.select("learns", "lengths", "codes").mapInArrow(run, "unit long, met array<double>")
    sums = met.groupBy("unit").agg(Summarizer.sum(array_to_vector("met")).alias("met"))
    out = np.zeros((UNITS, 2 * NEAR))
    for row in sums.select("unit", vector_to_array("met").alias("met")).collect():
        out[row.unit] = row.met
    return out


def cluster(met: np.ndarray, weight: np.ndarray, seed: int = 7, rounds: int = 20) -> np.ndarray:
    """Weighted k-means of the units' square-rooted profiles into GROUPS."""
    x = np.sqrt(met / np.maximum(met.sum(1, keepdims=True), 1))
    weight, rng = np.maximum(weight, 1e-9), np.random.default_rng(seed)
    centres = x[[int(np.argmax(weight))]]
    for _ in range(GROUPS - 1):
        far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1) * weight
        pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0
        centres = np.vstack([centres, x[pick]])
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for g in range(GROUPS):
            if (w := weight * (own == g)).sum() > 0:
                centres[g] = (x * w[:, None]).sum(0) / w.sum()
    return own


def with_classes(lex: Lexicon, counts: DataFrame, met: np.ndarray) -> Lexicon:
    """Assign classes to units and fill in the closed-form second factor."""
    top = min(TOP, len(lex.tokens))
    named = counts.sparkSession.createDataFrame([(bytearray(t),) for t in lex.tokens[:top]], "token binary")
    # All tokens but the top ones, by suffix unit: at most SUFFIXES rows.
    rest = (
        counts.where(F.col("token") != END)
        .join(F.broadcast(named), "token", "left_anti")
        .groupBy(suffix_column(F.col("token")).alias("unit"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
        .collect()
    )
    n, v = np.zeros(UNITS), np.zeros(UNITS)
    n[:top], v[:top] = lex.counts[:top], 1
    for row in rest:
        n[row.unit], v[row.unit] = row.n, row.v
    group = cluster(met, n)
    classes = GROUPS * BANDS + group
    for g in range(GROUPS):
        own = np.flatnonzero(group[:top] == g)
        mass = np.cumsum(lex.counts[own])
        if len(own):
            band = np.minimum(BANDS * (mass - lex.counts[own]) // mass[-1], BANDS - 1)
            classes[own] = g * BANDS + band
    size = np.bincount(classes, n, CLASSES)
    kinds = np.bincount(classes, v, CLASSES)
    open_ = np.zeros(CLASSES)
    open_[GROUPS * BANDS : END_CLASS] = 1  # classes that take unknown tokens
    lex.below = np.log10(np.maximum(size + ALPHA * (kinds + open_), 1e-300))
    lex.classes = classes
    units = head_units(lex.tokens)
    lex.inside = np.log10(lex.counts + ALPHA) - lex.below[classes[units]] if len(units) else np.zeros(0)
    size[END_CLASS] = lex.ends
    lex.bias = np.log((size + 1) / (size + 1).sum()).astype(np.float32)
    return lex


def encode(units: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, feature rows) of a stream of units; nothing before a text's start is seen."""
    own = classes_of(units, classes)
    begin = np.concatenate([[0], np.flatnonzero(units == UNITS) + 1])
    begin = begin[begin < len(units)]

    def back(x: np.ndarray, start: int) -> np.ndarray:
        """One place back, ``start`` where that leaves the text."""
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[begin] = start
        return before

    one = back(own, START)
    two = back(one, START)
    three = back(two, START)
    four = back(three, START)
    word = back(units, UNITS)
    second = back(word, UNITS)
    wide = CLASSES + 1
    mixed = second.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
    hashed = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(51)
    rows = np.stack(
        [
            word + OFFSETS[0],
            one * wide + two + OFFSETS[1],
            three * wide + four + OFFSETS[2],
            hashed.astype(np.int64) + OFFSETS[3],
        ]
    )
    return own, rows


def odds_of(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What each feature row multiplies the classes' odds by; rows of the word before hold the bias.

    Weights are logs of bounded counts, far from where exp overflows.
    """
    out = np.exp(weights)
    out[: OFFSETS[1]] *= np.exp(bias)
    return out


def softmax(odds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class probabilities of places, given ``odds_of`` the weights and the places' feature rows."""
    out = np.take(odds, rows[0], axis=0)
    for r in rows[1:]:
        out *= np.take(odds, r, axis=0)
    out /= np.einsum("ij->i", out)[:, None]
    return out


def add_up(sums: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
    """Add each place's cells to the sums of its feature rows; ``sums`` has a row per class."""
    by_class = np.ascontiguousarray(cells.T, np.float64)
    for r, first, end in zip(rows, OFFSETS, (*OFFSETS[1:], ROWS)):
        at = r - first
        for total, cell in zip(sums, by_class):
            total[first:end] += np.bincount(at, cell, end - first)


def class_sums(coded: DataFrame, lex: Lexicon, weights: np.ndarray | None) -> np.ndarray:
    """Per feature row and class, how often the class came (no weights), or was expected to come.

    Every task hands on a table of fixed size, so the runs are dealt to as many tasks as keep the
    cluster busy, whatever the corpus.
    """
    context = coded.sparkSession.sparkContext
    shared = context.broadcast((head_units(lex.tokens), lex.classes, lex.bias, weights))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, known, bias, weights = shared.value
        odds = None if weights is None else odds_of(weights, bias)
        sums = np.zeros((ROWS, CLASSES))
        told = np.zeros((CLASSES, ROWS))
        for b in parts:
            for i in range(len(b)):
                _, units, _, taught = read_texts(b, i, head)
                classes, rows = encode(units[taught], known)
                if odds is None:
                    for r in rows:
                        sums += np.bincount(r * CLASSES + classes, minlength=sums.size).reshape(sums.shape)
                    continue
                for at in range(0, len(classes), ADDED):
                    part = rows[:, at : at + ADDED]
                    add_up(told, part, softmax(odds, part))
        sums += told.T
        schema = pa.schema([("chunk", pa.int32()), ("cell", pa.binary())])
        parts = [sums[at : at + ROWS_AT_ONCE].astype(kept) for at in range(0, ROWS, ROWS_AT_ONCE)]
        yield from batches({"chunk": range(len(parts)), "cell": [*map(pack, parts)]}, schema)

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in parts:
            for chunk, cell in zip(b.column("chunk").to_pylist(), b.column("cell").to_pylist()):
                held[chunk] = held.get(chunk, 0) + unpack(cell, kept).astype("<f8")
        schema = pa.schema([("chunk", pa.int32()), ("cell", pa.binary())])
        yield from batches({"chunk": list(held), "cell": [*map(pack, held.values())]}, schema)

    kept = "<f8" if weights is None else "<f4"  # counts are exact, expected ones of that precision
    kind = "chunk int, cell binary"
    dealt = coded.select("learns", "lengths", "codes").coalesce(2 * context.defaultParallelism)
    found = dealt.mapInArrow(run, kind)
    # A table of fixed size, ROWS x CLASSES, whatever the corpus.
    rows = found.repartition("chunk").mapInArrow(total, kind).collect()
    cells = [unpack(bytes(r.cell), "<f8") for r in sorted(rows, key=lambda r: r.chunk)]
    return np.concatenate(cells).reshape(ROWS, CLASSES) if cells else np.zeros((ROWS, CLASSES))


def scaled(seen: np.ndarray, told: np.ndarray, weights: np.ndarray, step: float, share: np.ndarray) -> np.ndarray:
    """What to add to each weight: the d at which told * exp(d / step) + (weight + d) / VARIANCE is seen."""
    d = step * np.log((seen + PSEUDO * share) / (told + PSEUDO * share))
    for _ in range(12):  # Newton's method; the sum grows with d and is convex
        grown = told * np.exp(d / step)
        d -= np.clip((grown + (weights + d) / VARIANCE - seen) / (grown / step + 1 / VARIANCE), -1, 1)
    return d


def missed(seen: np.ndarray, told: np.ndarray, weights: np.ndarray) -> float:
    """By how much of the observed counts the constraints are missed."""
    return float(np.abs(told + weights / VARIANCE - seen).sum() / max(1.0, seen.sum()))


def scale_weights(coded: DataFrame, lex: Lexicon) -> np.ndarray:
    """Class weights by iterative scaling over all coded texts.

    Maximum entropy under a Gaussian prior: a feature's expected count plus its weight over the
    variance is its observed count. Rounds go on until all counts together miss that by less than
    MISSED; each asks every training place for its expected classes. Before the first one the weights
    are zero and the classes expected at their overall rates.
    """
    share = np.exp(lex.bias.astype(np.float64))
    seen = class_sums(coded, lex, None)
    told, weights, step, last = seen.sum(1, keepdims=True) * share, np.zeros((ROWS, CLASSES)), STEP, math.inf
    while (off := missed(seen, told, weights)) > MISSED:
        if off > last:
            step = 1 / FEATURES
        last = off
        weights += scaled(seen, told, weights, step, share)
        told = class_sums(coded, lex, weights.astype(np.float32))
    return weights.astype(np.float32)


# ------------------------------------------------------------------------- pairs of neighbours


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes: the finaliser of SplitMix64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(
    codes: np.ndarray, classes: np.ndarray, sizes: np.ndarray, sums: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all places (word before, class, token), and of the rare tokens by themselves.

    The upper bits are the word's before, so the pairs of one word lie together when sorted. The
    lower ones are a head token's rank, which packs closer than a hash, or another bit and a hash.
    """
    name = codes.astype(np.int64)
    rare = (codes < 0) & (codes != STOP)
    name[rare] = sums.astype(np.int64) + (1 << 40)
    token = mixed(name)
    before = np.concatenate([token[:1], token[:-1]])
    before[np.cumsum(sizes) - sizes] = mixed(np.array([1 << 50]))[0]
    high, place = np.uint64(64 - BEFORE_BITS), np.uint64(TOKEN_BITS)
    hashed = np.uint64(1 << (TOKEN_BITS - 1))
    low = np.maximum(name, 0).astype(np.uint64)
    own = token[rare]
    low[rare] = hashed | own & (hashed - np.uint64(1))
    pairs = (before >> high << high) | (classes.astype(np.uint64) << place) | low
    return pairs, (own >> high << high) | (np.uint64(ALONE) << place) | low[rare]


def distinct(values: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values; the order of all, and where among the distinct each of them is."""
    order = np.argsort(values, kind=kind)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], order, place


def starts(of: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the words before as differences, how many keys each has, and their lower bits as
    differences within a word."""
    bits = np.uint64(64 - BEFORE_BITS)
    words = keys >> bits
    at = starts(words)
    steps = np.diff(words[at], prepend=np.uint64(0))
    lower = keys.astype("<u4") & np.uint32((1 << int(bits)) - 1)
    inner = lower.copy()
    inner[1:] -= lower[:-1]
    inner[at] = lower[at]
    parts = [[len(at)], np.diff(at, append=len(keys)), steps, steps >> np.uint64(32)]
    return pack(np.concatenate([*(np.asarray(p).astype("<u4") for p in parts), inner]))


def unpack_keys(cell: bytes) -> np.ndarray:
    numbers = unpack(cell, "<u4")
    n = int(numbers[0])
    sizes, lower, upper, inner = np.split(numbers[1:], [n, 2 * n, 3 * n])
    words = np.cumsum(lower | upper.astype(np.uint64) << np.uint64(32)) << np.uint64(64 - BEFORE_BITS)
    sizes = sizes.astype(np.int64)
    at = np.cumsum(sizes) - sizes
    run = np.cumsum(inner, dtype=np.uint64)
    return run + np.repeat(words - run[at] + inner[at], sizes)


def classes_of(units: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.append(classes, END_CLASS)[units]


def shard_bits(shards: int) -> np.uint64:
    """How far a key is shifted to give its shard: shards are ranges of a power of two."""
    return np.uint64(64 - max(1, (shards - 1).bit_length()))


ASKED = "shard int, run long, keys binary, counts binary"


def ask(coded: DataFrame, lex: Lexicon, shards: int) -> DataFrame:
    """A row per run and shard: the run's distinct keys there, and how often its teaching texts have each."""
    shared = coded.sparkSession.sparkContext.broadcast(lex)
    bits = shard_bits(shards)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        head = head_units(lex.tokens)
        schema = pa.schema([("shard", pa.int32()), ("run", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for b in parts:
            for i in range(len(b)):
                codes, units, sizes, taught = read_texts(b, i, head)
                sums = unpack(b.column("sums")[i].as_py(), "<u4")
                pairs, own = pair_keys(codes, classes_of(units, lex.classes), sizes, sums)
                keys, _, place = distinct(np.concatenate([pairs, own]))
                learned = np.concatenate([taught, taught[(codes < 0) & (codes != STOP)]])
                counts = np.bincount(place, learned, len(keys)).astype("<u4")
                shard = (keys >> bits).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                ends = np.r_[at[1:], len(shard)]
                yield from batches(
                    {
                        "shard": shard[at],
                        "run": np.full(len(at), b.column("run")[i].as_py()),
                        "keys": [pack_keys(keys[x:y]) for x, y in zip(at, ends)],
                        "counts": [pack(counts[x:y]) for x, y in zip(at, ends)],
                    },
                    schema,
                    64,
                )

    return coded.select("run", "learns", "lengths", "codes", "sums").mapInArrow(run, ASKED)


def levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, among sorted keys, a word before with a class begins, and where a word before does."""
    group = keys >> np.uint64(TOKEN_BITS)
    return starts(group), starts(group >> np.uint64(CLASS_BITS))


def sums_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each sorted key is told, five rows: its count; the counts and kinds of its word before
    and class together; the counts and kinds of classes of its word before."""
    alone = (keys >> np.uint64(TOKEN_BITS) & np.uint64(ALONE)) == ALONE
    groups, words = levels(keys)
    out = np.zeros((5, len(keys)), "<u4")
    out[0] = n
    if not len(keys):
        return out
    counted = np.where(alone, 0, n)
    in_class, kinds = np.add.reduceat(counted, groups), np.add.reduceat((counted > 0).astype(np.int64), groups)
    upper = np.searchsorted(groups, words)
    in_word, classes = np.add.reduceat(in_class, upper), np.add.reduceat((in_class > 0).astype(np.int64), upper)
    for at, rows, values in ((groups, (1, 2), (in_class, kinds)), (words, (3, 4), (in_word, classes))):
        length = np.diff(at, append=len(keys))
        for r, v in zip(rows, values):
            out[r] = np.repeat(v, length)
    return out


def pack_told(told: np.ndarray, keys: np.ndarray) -> bytes:
    """Replies, with what keys have in common told once."""
    groups, words = levels(keys)
    return pack(np.concatenate([told[0], told[1, groups], told[2, groups], told[3, words], told[4, words]]))


def unpack_told(cell: bytes, keys: np.ndarray) -> np.ndarray:
    groups, words = levels(keys)
    sizes = [len(keys), len(groups), len(groups), len(words), len(words)]
    parts = np.split(unpack(cell, "<u4"), np.cumsum(sizes)[:-1])
    by_group, by_word = np.diff(groups, append=len(keys)), np.diff(words, append=len(keys))
    return np.stack([parts[0], *(np.repeat(p, by_group) for p in parts[1:3]), *(np.repeat(p, by_word) for p in parts[3:])])


def mix(told: np.ndarray) -> np.ndarray:
    """Four rows: a and b of a token, and of its class. A probability is a + b * its background."""
    n, in_class, kinds, in_word, classes = told.astype(np.float64)
    return np.stack(
        [
            np.maximum(n - DISCOUNT, 0) / np.maximum(in_class, 1),
            np.where(in_class > 0, DISCOUNT * kinds / np.maximum(in_class, 1), 1),
            np.maximum(in_class - CLASS_DISCOUNT, 0) / np.maximum(in_word, 1),
            np.where(in_word > 0, CLASS_DISCOUNT * classes / np.maximum(in_word, 1), 1),
        ]
    )


def answer(asked: DataFrame, shards: int) -> DataFrame:
    """``(run, shard, said)``: what the keys of each run say, shard by shard.

    A shard is a range of key hashes of bounded size, as there are the more of them the more tokens.
    """
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartition(max(least, shards), "shard").sortWithinPartitions("shard")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("said", pa.binary())])
        held: list[tuple] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            each = [unpack_keys(k) for _, k, _ in held]
            keys, _, place = distinct(np.concatenate(each), "stable")  # which merges sorted ones
            counts = np.concatenate([unpack(c, "<u4") for _, _, c in held])
            said = sums_of(keys, np.bincount(place, counts, len(keys)).astype(np.int64))
            ends = np.cumsum([len(k) for k in each])
            for (number, _, _), end, own in zip(held, ends, each):
                if number is not None:
                    cell = pack_told(said[:, place[end - len(own) : end]], own)
                    yield from batches({"run": [number], "shard": [now], "said": [cell]}, schema)

        for b in parts:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "run", "keys", "counts"))):
                if shard != now and held:
                    yield from flush()
                    held = []
                now = shard
                held.append(tuple(row))
        if held:
            yield from flush()

    return dealt.mapInArrow(run, "run long, shard int, said binary")


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    counts: DataFrame  # (token, n) of all training tokens
    coded: DataFrame  # the coded training texts
    shards: int


def count(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Lexicon]:
    """The stored counts of all tokens of the training texts, and their lexicon."""
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stage(count_tokens(source), "counts")
    return counts, lexicon(counts)


def fit(coded: DataFrame, counts: DataFrame, lex: Lexicon) -> Model:
    """Find classes and their weights from all coded texts that teach; their pairs are counted later."""
    lex = with_classes(lex, counts, company(coded, lex))
    shards = 1 << max(0, (lex.total // SHARD_TOKENS).bit_length())
    return Model(lex, scale_weights(coded, lex), counts, coded, shards)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Learn from all texts of ``docs``. Missing texts count as empty ones."""
    counts, lex = count(docs, text)
    return fit(code_texts(docs, lex.tokens, [], text), counts, lex)


def place_scores(
    codes: np.ndarray, units: np.ndarray, told: np.ndarray, alone: np.ndarray, lex: Lexicon, weights: np.ndarray
) -> np.ndarray:
    """log10 of the probability of every token of a run, ends included.

    ``told`` holds what every place's pair is told, ``alone`` the counts of the rare tokens.
    """
    own, rows = encode(units, lex.classes)
    known, stop = codes >= 0, codes == STOP
    rare = ~known & ~stop
    inside = np.zeros(len(own))
    if len(lex.inside):
        inside[known] = lex.inside[codes[known]]
    inside[rare] = np.log10(alone + ALPHA) - lex.below[own[rare]]
    out, odds = np.empty(len(own)), odds_of(weights, lex.bias)
    for at in range(0, len(own), BATCH):
        part = slice(at, at + BATCH)
        x = softmax(odds, rows[:, part])
        a, b, a_class, b_class = mix(told[:, part])
        a[stop[part]], b[stop[part]] = 1, 0  # the end is alone in its class
        background = x[np.arange(len(x)), own[part]]
        out[part] = np.log10(a_class + b_class * background) + np.log10(a + b * 10 ** inside[part])
    return out


def score_run(codes: np.ndarray, sizes: np.ndarray, scores: np.ndarray, lex: Lexicon) -> dict:
    """Scores of a run's texts; the base still without log10(count + ALPHA) of rare tokens."""
    known, stop = codes >= 0, codes == STOP
    base = np.full(len(codes), -lex.base_below)
    base[stop] += math.log10(lex.ends + ALPHA)
    if len(lex.inside):
        base[known] += np.log10(lex.counts[codes[known]] + ALPHA)
    begin = np.cumsum(sizes) - sizes
    return {
        "n_tokens": sizes,
        "n_known": np.add.reduceat(known, begin, dtype=np.int64) + int(lex.ends > 0),
        "base_score": np.add.reduceat(base, begin),
        "score": np.add.reduceat(scores, begin),
    }


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """``score_coded`` of the texts of ``docs``, none of which teaches."""
    coded = code_texts(docs, model.lexicon.tokens, carry, text, F.lit(False))
    return score_coded(coded, model, carry)


def score_coded(coded: DataFrame, model: Model, carry: list[str], taught: bool = False) -> DataFrame:
    """The ``carry`` columns plus ``n_tokens, n_known, train_tokens, base_score, score``, per row.

    Scores are log10 probabilities of the whole text and its end; a missing or empty text is its
    end alone. ``base_score`` is the smoothed unigram model of the same counts. Repeated rows are
    scored each; rare tokens meet their exact counts in a join, by the row's own number. ``taught``
    says that the model learned from those of these very texts that teach: then their pairs are
    asked for and counted at once.
    """
    kept = [*carry, "_lm_row"]
    numbers = [("n_tokens", T.LongType()), ("n_known", T.LongType())]
    numbers += [("base_score", T.DoubleType()), ("score", T.DoubleType())]
    fields = coded.schema["kept"].dataType.elementType
    schema = T.StructType([fields[c] for c in kept] + [T.StructField(n, t) for n, t in numbers])
    asked = ask(coded, model.lexicon, model.shards)
    if not taught:
        learned = ask(model.coded, model.lexicon, model.shards)
        asked = asked.union(learned.withColumn("run", F.lit(None).cast("long")))
    replies = answer(asked, model.shards).groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("shard", "said"))).alias("said")
    )
    shared = coded.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    shards, bits = model.shards, shard_bits(model.shards)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights = shared.value
        head = head_units(lex.tokens)
        for b in parts:
            for i in range(len(b)):
                codes, units, sizes, _ = read_texts(b, i, head)
                sums = unpack(b.column("sums")[i].as_py(), "<u4")
                pairs, own = pair_keys(codes, classes_of(units, lex.classes), sizes, sums)
                keys, _, place = distinct(np.concatenate([pairs, own]))
                shard = (keys >> bits).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                cuts = np.split(keys, starts(shard)[1:])
                said = [unpack_told(x["said"], k) for x, k in zip(b.column("said")[i].as_py(), cuts)]
                told = np.concatenate(said, axis=1)
                alone, told = told[0, place[len(pairs) :]], told[:, place[: len(pairs)]]
                scores = place_scores(codes, units, told, alone, lex, weights)
                got = score_run(codes, sizes, scores, lex)
                rows = b.column("kept")[i].values
                new = [pa.array(got[n]) for n, _ in numbers]
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in kept], *new], schema.names)

    needed = coded.select("run", "kept", "learns", "lengths", "codes", "sums")
    scored = needed.join(replies, "run").mapInArrow(run, schema)
    seen = coded.select(F.inline("tails")).join(model.counts, "token", "left")
    sums = seen.groupBy("_lm_of").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("_lm_more"),
        F.count("n").alias("_lm_seen"),
    )
    joined = scored.join(sums, scored["_lm_row"] == sums["_lm_of"], "left")
    more = F.coalesce("_lm_more", F.lit(0.0))
    return joined.select(
        *[F.col(f"`{c}`") for c in carry],
        "n_tokens",
        (F.col("n_known") + F.coalesce("_lm_seen", F.lit(0))).alias("n_known"),
        F.lit(model.lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        "score",
    )
