"""Exact top-k inner products by columnar branch-and-bound over blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import batches, checkpointed

BLOCK = "block long, n long, dims long, ids binary, keys binary, cells binary"
ARROW = pa.schema(
    [("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int64())]
    + [(c, pa.binary()) for c in ("ids", "keys", "cells")]
)


def quantise(vectors: list, scale: int) -> list:
    """floor(scale * x) per component; None for a vector that takes no part."""
    out = []
    for v in vectors:
        x = None if v is None else np.array(v, np.float64)
        fine = x is not None and len(x) and np.isfinite(x).all()
        out.append(np.floor(scale * x) if fine else None)
    return out


def pack(ids: list, keys: list, rows: list[np.ndarray], block: int) -> dict:
    """One table row: the vectors as a dims x n matrix, so that a dimension is contiguous."""
    dims = max(map(len, rows))
    cells = np.zeros((dims, len(rows)), np.int64)
    for i, r in enumerate(rows):
        cells[: len(r), i] = r
    small = np.abs(cells).max(initial=0) < 1 << 15
    return {
        "block": block,
        "n": len(rows),
        "dims": dims,
        "ids": np.array(ids, "<i8").tobytes(),
        "keys": np.array(keys, "<i8").tobytes(),
        "cells": cells.astype("<i2" if small else "<i8").tobytes(),
    }


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = row["dims"], row["n"]
    kind = "<i2" if len(row["cells"]) == 2 * shape[0] * shape[1] else "<i8"
    cells = np.frombuffer(row["cells"], kind).reshape(shape)
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["keys"], "<i8"), cells


def best_of_block(queries: np.ndarray, cells: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, step: int):
    """For each query the positions and scores of its ``k`` best candidates in one block.

    ``queries`` is n x dims, ``cells`` dims x m, ``own`` the position of the query's own row or -1.
    Scores grow by ``step`` dimensions at a time; after each, a candidate stays if its score plus
    the product of the norms that remain reaches the k-th best lower bound (Cauchy-Schwarz).
    """
    dims, m = cells.shape
    top = max(float(np.abs(queries).max(initial=0)), 1.0) * max(float(np.abs(cells).max(initial=0)), 1.0) * dims
    # Every partial sum is an integer that the chosen type holds exactly.
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    q, c = queries.astype(kind), cells.astype(kind)
    cuts = list(range(0, dims, step)) + [dims]

    def rest(x: np.ndarray, axis: int) -> list[np.ndarray]:
        squares = np.square(x.astype(np.float64))
        return [np.sqrt(squares.take(range(b, dims), axis).sum(axis)) * (1 + 1e-9) for b in cuts[1:]]

    rest_q, rest_c = rest(q, 1), rest(c, 0)
    first = q[:, : cuts[1]] @ c[: cuts[1]]
    for i in range(len(q)):
        alive, score = None, first[i]
        if own[i] >= 0:
            alive = np.delete(np.arange(m), own[i])
            score = score[alive]
        for j in range(1, len(cuts) - 1):
            left = rest_c[j - 1] if alive is None else rest_c[j - 1][alive]
            slack = rest_q[j - 1][i] * left
            if len(score) > k:
                floor = np.partition(score - slack, len(score) - k)[len(score) - k]
                keep = np.flatnonzero(score + slack >= floor - 1e-6 * abs(floor))
                alive = keep if alive is None else alive[keep]
                score = score[keep]
            part = c[cuts[j] : cuts[j + 1]]
            # Compacted columns once few are left; a gather of most of them costs more than it saves.
            if alive is None or len(alive) == m:
                score = score + q[i, cuts[j] : cuts[j + 1]] @ part
            elif 2 * len(alive) > m:
                score = score + (q[i, cuts[j] : cuts[j + 1]] @ part)[alive]
            else:
                score = score + q[i, cuts[j] : cuts[j + 1]] @ part[:, alive]
        alive = np.arange(m) if alive is None else alive
        order = np.lexsort((ids[alive], -score))[:k]
        yield alive[order], score[order].astype(np.int64)


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: int = 64,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block: int = 4096,
    query_block: int = 1024,
    step: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row with id % every == 0.

    Exact integer inner products of ``floor(scale * x)``; ties go to the smaller id. Candidates are
    all rows but the query's own: a repeated row is a candidate, and a query, of its own. Vectors
    that are missing or empty, hold a missing or non-finite component or have no id take no part;
    a shorter vector counts as padded with zeros. Products must fit a long. Empty tables give no
    row; other columns are not read.

    Vectors are packed into blocks of a fixed number, queries into smaller ones, and every block of
    queries meets every block of vectors; a pair yields at most ``k`` rows per query, which are
    reduced before the final shuffle. Nothing is broadcast or collected.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("x"))

    def packed(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, ids, cells = TaskContext.get().partitionId() << 32, 0, [], []

        def flush():
            nonlocal made
            keys = [base + made + i for i in range(len(ids))]
            row = pack(ids, keys, cells, base + made)
            made += len(ids)
            ids.clear()
            cells.clear()
            return pa.RecordBatch.from_pylist([row], ARROW)

        for b in parts:
            for i, v in zip(b.column("id").to_pylist(), quantise(b.column("x").to_pylist(), scale)):
                if v is not None and i is not None:
                    ids.append(i)
                    cells.append(v)
                    if len(ids) == size:
                        yield flush()
        if ids:
            yield flush()

    stored = checkpointed(rows.mapInArrow(lambda p: packed(p, block), BLOCK))

    def chosen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in b.to_pylist():
                ids, keys, cells = unpack(row)
                mine = np.flatnonzero(ids % every == 0)
                for at in range(0, len(mine), query_block):
                    some = mine[at : at + query_block]
                    made = pack(list(ids[some]), list(keys[some]), list(cells[:, some].T), row["block"])
                    yield pa.RecordBatch.from_pylist([made], ARROW)

    asked = stored.mapInArrow(chosen, BLOCK)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("query_key", "query_id", "key", "vec_id", "score")])
        for b in parts:
            for row in b.to_pylist():
                ids, keys, cells = unpack(row)
                q_ids, q_keys, q = unpack({c: row[f"q_{c}"] for c in ("n", "dims", "ids", "keys", "cells")})
                wide = max(len(cells), len(q))
                cells = np.pad(cells.astype(np.int64), ((0, wide - len(cells)), (0, 0)))
                q = np.pad(q.astype(np.int64), ((0, wide - len(q)), (0, 0))).T
                at = np.searchsorted(keys, q_keys)
                own = np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == q_keys), at, -1)
                found = list(best_of_block(q, cells, ids, own, k, step))
                sizes = [len(p) for p, _ in found]
                hit = np.concatenate([p for p, _ in found])
                yield from batches(
                    {
                        "query_key": np.repeat(q_keys, sizes),
                        "query_id": np.repeat(q_ids, sizes),
                        "key": keys[hit],
                        "vec_id": ids[hit],
                        "score": np.concatenate([s for _, s in found]),
                    },
                    schema,
                    1 << 16,
                )

    # Blocks of the stated queries against blocks of all rows.
    pairs = stored.crossJoin(asked)
    met = pairs.mapInArrow(meet, "query_key long, query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "key")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
