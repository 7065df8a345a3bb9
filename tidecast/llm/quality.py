"""Text quality from a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over every byte of the whole text, and each filter's
largest response is taken per chunk of the text; chunks overlap by half. Mean and maximum over the
chunks go through a small dense layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import texts

DEPTH, WIDTH, FILTERS, HIDDEN = 8, 8, 32, 16
BLOCK = 128  # bytes; a chunk is two blocks, and the next chunk begins a block later
AT_ONCE = 1 << 19  # bytes of text worked on together
SLAB = 64  # blocks multiplied at once
STEPS, BATCH, RATE, DECAY, SEED = 300, 32, 0.006, 1e-4, 11
DRAWN_CHUNKS = 32  # chunks of a text that training keeps, spread evenly over the whole text
STEP_CHUNKS = 6  # of those, how many one step reads

Weights = dict[str, np.ndarray]


def start(seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    made = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {
        "embed": made(256, DEPTH) * 8,
        "filters": made(WIDTH * DEPTH, FILTERS),
        "offset": np.zeros(FILTERS, np.float32),
        "dense": made(2 * FILTERS, HIDDEN),
        "dense_offset": np.zeros(HIDDEN, np.float32),
        "out": made(HIDDEN, 1)[:, 0],
        "out_offset": np.zeros(1, np.float32),
    }


def windows(embedded: np.ndarray) -> np.ndarray:
    """All runs of WIDTH bytes of each chunk, a row per first byte."""
    view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=-2)
    return np.ascontiguousarray(np.swapaxes(view, -1, -2)).reshape(*view.shape[:2], WIDTH * DEPTH)


def laid(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each filled up with at least WIDTH - 1 zeros to whole blocks; and the
    blocks of each."""
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    blocks = (sizes + WIDTH - 1 + BLOCK - 1) // BLOCK
    out = b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(some, blocks))
    return np.frombuffer(out, np.uint8), blocks


def pool_blocks(letters: np.ndarray, blocks: np.ndarray, weights: Weights) -> np.ndarray:
    """Each filter's largest response per block, at least 0.

    Every byte of a text begins a run; runs that would reach into the next text do not count.
    """
    out = np.empty((len(letters) // BLOCK, FILTERS), np.float32)
    last = np.cumsum(blocks) - 1
    padded = np.concatenate([letters, np.zeros(WIDTH - 1, np.uint8)])
    for at in range(0, len(out), SLAB):
        n = min(SLAB, len(out) - at)
        embedded = weights["embed"][padded[at * BLOCK : (at + n) * BLOCK + WIDTH - 1]]
        # Bytes are side by side, so a run of them is a view; it is copied slab by slab.
        shape, steps = (n * BLOCK, WIDTH * DEPTH), (embedded.strides[0], embedded.itemsize)
        runs = np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, shape, steps))
        got = (runs @ weights["filters"]).reshape(n, BLOCK, FILTERS)
        got[last[(last >= at) & (last < at + n)] - at, BLOCK - WIDTH + 1 :] = -np.inf
        out[at : at + n] = got.max(1)
    return np.maximum(out + weights["offset"], 0)


def combine(pooled: np.ndarray, blocks: np.ndarray, weights: Weights) -> np.ndarray:
    """The probability of each text from its blocks' responses."""
    at = np.cumsum(blocks) - blocks
    nth = np.arange(len(pooled)) - np.repeat(at, blocks)
    last = nth == np.repeat(blocks, blocks) - 1
    following = np.concatenate([pooled[1:], pooled[-1:]])
    chunks = np.where(last[:, None], pooled, np.maximum(pooled, following))
    # A text of several blocks has a chunk less than blocks; the last one is in the chunk before.
    counted = ~last | (np.repeat(blocks, blocks) == 1)
    n = np.add.reduceat(counted, at, dtype=np.int64)
    mean = np.add.reduceat(chunks * counted[:, None], at, axis=0, dtype=np.float64) / n[:, None]
    most = np.maximum.reduceat(chunks, at, axis=0)
    return dense(np.concatenate([mean, most], axis=1), weights)[0]


def dense(features: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(features @ weights["dense"] + weights["dense_offset"])
    value = hidden @ weights["out"] + weights["out_offset"][0]
    return 1 / (1 + np.exp(-np.clip(value, -30, 30))), hidden


def predict(some: list[bytes], weights: Weights) -> np.ndarray:
    """Probabilities of whole texts; those of an empty one come from a block of zeros."""
    out, run, total, at = [], [], 0, 0

    def flush() -> None:
        letters, blocks = laid(run)
        out.append(combine(pool_blocks(letters, blocks, weights), blocks, weights))

    for t in some:
        run.append(t)
        total += len(t)
        if total >= AT_ONCE:
            flush()
            run, total = [], 0
    if run:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def drawn_chunks(text: bytes) -> np.ndarray:
    """At most DRAWN_CHUNKS chunks of a text, spread evenly from its first to its last."""
    letters, blocks = laid([text])
    rows = np.concatenate([letters.reshape(-1, BLOCK), np.zeros((1, BLOCK), np.uint8)])
    n = max(1, int(blocks[0]) - 1)
    first = np.unique(np.linspace(0, n - 1, min(n, DRAWN_CHUNKS)).round().astype(int))
    return np.concatenate([rows[first], rows[first + 1]], axis=1)


def gradients(chunks: np.ndarray, owner: np.ndarray, label: np.ndarray, weights: Weights) -> tuple[Weights, float]:
    """Gradients of the mean log-loss; ``owner`` is each chunk's text, in order."""
    size, c = len(label), np.arange(len(chunks))[:, None]
    x = windows(weights["embed"][chunks])
    got = x @ weights["filters"]
    place = got.argmax(1)
    top = np.take_along_axis(got, place[:, None], axis=1)[:, 0] + weights["offset"]
    pooled = np.maximum(top, 0)
    at = np.searchsorted(owner, np.arange(size))
    n = np.bincount(owner, minlength=size)[:, None]
    mean = np.add.reduceat(pooled, at, axis=0) / n
    most = np.maximum.reduceat(pooled, at, axis=0)
    features = np.concatenate([mean, most], axis=1)
    p, hidden = dense(features, weights)
    error = ((p - label) / size).astype(np.float32)
    grad = {"out": hidden.T @ error, "out_offset": error.sum(keepdims=True)}
    back = np.outer(error, weights["out"]) * (1 - hidden**2)
    grad |= {"dense": features.T @ back, "dense_offset": back.sum(0)}
    features_back = back @ weights["dense"].T
    to_mean, to_most = features_back[:, :FILTERS] / n, features_back[:, FILTERS:]
    first = pooled == most[owner]
    share = np.add.reduceat(first.astype(np.float32), at, axis=0)
    pooled_back = (to_mean[owner] + first * (to_most / share)[owner]) * (top > 0)
    picked = x[c, place]  # chunks x filters x window
    grad["offset"] = pooled_back.sum(0)
    grad["filters"] = np.einsum("cfw,cf->wf", picked, pooled_back)
    moved = (pooled_back[:, :, None] * weights["filters"].T[None]).reshape(*place.shape, WIDTH, DEPTH)
    where = place[:, :, None] + np.arange(WIDTH)
    letters = np.take_along_axis(chunks, where.reshape(len(chunks), -1), axis=1)
    embed = np.zeros_like(weights["embed"])
    np.add.at(embed, letters.reshape(where.shape), moved)
    grad["embed"] = embed
    loss = -np.mean(np.log(np.where(label > 0, p, 1 - p) + 1e-12))
    return grad, float(loss)


def learn(kept: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Weights:
    """Adam on batches that hold as many texts of either label; the offset is set right in the end.

    Repeatable: the same texts in the same order give the same weights.
    """
    weights, rng = start(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    kinds = [k for k in (np.flatnonzero(labels == v) for v in (0, 1)) if len(k)]
    first = {k: np.zeros_like(w) for k, w in weights.items()}
    second = {k: np.zeros_like(w) for k, w in weights.items()}
    for t in range(1, steps + 1 if len(kinds) == 2 else 1):
        rows = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        picked = [kept[r] if len(kept[r]) <= STEP_CHUNKS else kept[r][np.sort(rng.choice(len(kept[r]), STEP_CHUNKS, False))] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in picked])
        grad, _ = gradients(np.concatenate(picked), owner, labels[rows], weights)
        rate = RATE * min(1.0, 2 * (1 - (t - 1) / steps))
        for k, w in weights.items():
            g = grad[k] + DECAY * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    # Batches were half and half; the labels' own odds come back into the offset.
    good = (labels.sum() + 0.5) / (len(labels) + 1)
    weights["out_offset"] += np.float32(np.log(good / (1 - good)))
    if len(kinds) < 2:
        weights["out"][:] = 0
    return weights


@dataclass
class Model:
    weights: Weights
    rows: int  # labelled rows it learned from


def flat(weights: Weights) -> bytes:
    return b"".join(weights[k].astype("<f4").tobytes() for k in start())


def unflat(cell: bytes) -> Weights:
    out, at = {}, 0
    for k, w in start().items():
        out[k] = np.frombuffer(cell, "<f4", w.size, at).reshape(w.shape).copy()
        at += 4 * w.size
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled rows, drawn by a hash of id and text.

    ``labels`` holds ``doc_id`` and ``label`` (0 or 1; others teach nothing). The bounds, ``rows``
    and DRAWN_CHUNKS chunks of each text, are on the training sample alone. Labels are drawn before
    they meet the texts, so no text is shuffled that is not drawn; the sample, of bounded bytes,
    goes to one task that trains on it. Missing ids meet no label; missing texts teach as empty
    ones.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    met = source.join(F.broadcast(known), "doc_id").withColumn("draw", F.xxhash64("doc_id", "text"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            cells = [drawn_chunks(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("label"), pa.array(cells, pa.binary())], ["draw", "label", "chunks"]
            )

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, marks = [], []
        for b in parts:
            kept += [np.frombuffer(c, np.uint8).reshape(-1, 2 * BLOCK) for c in b.column("chunks").to_pylist()]
            marks += b.column("label").to_pylist()
        cells = [pa.array([flat(learn(kept, np.array(marks)))], pa.binary()), pa.array([len(marks)], pa.int64())]
        yield pa.RecordBatch.from_arrays(cells, ["weights", "rows"])

    sample = met.select("draw", "label", "text").mapInArrow(cut, "draw long, label int, chunks binary")
    # Repeated ids can bring more rows than labels: the bound holds for them too.
    sample = sample.orderBy("draw", "label", "chunks").limit(rows)
    done = sample.coalesce(1).mapInArrow(train, "weights binary, rows long").first()
    return Model(unflat(bytes(done.weights)) if done else learn_nothing(), done.rows if done else 0)


def learn_nothing() -> Weights:
    return learn([], np.zeros(0))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows, the ``carry`` columns (all if not given) plus ``score`` and ``predicted``.

    ``score`` is the probability of label 1 for the whole text, a missing text scored as an empty
    one; ``predicted`` is 1 from ``threshold`` on. Repeated rows are scored each, equal texts alike.
    Columns of these names are replaced. An empty table gives no row. A model without labels, or
    with one kind alone, gives every text the same score.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_quality_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = predict(texts(b, "_quality_text"), shared.value).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found)], schema.names)

    scored = source.mapInArrow(run, schema)
    decided: Column = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.withColumn("predicted", decided)
