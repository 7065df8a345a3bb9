"""Sequence packing by lexical retrieval: a sharded BM25 index finds what to pack together."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import batches, stage

K1, B = 1.2, 0.75
FULL, REST, STATS = 0, 1, 2
SHARDS_PER_TASK = 16
WIDE = 16  # a token in more than one of so many units of a shard gets a row of its own

# Texts that need no Unicode rule beyond Latin-1.
SIMPLE = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ]*").fullmatch
# Sorts of lower-case Latin-1 characters: blanks, letters, punctuation; digits and ends.
ALONE = 3
SORTS = np.full(256, 2, np.uint8)
SORTS[[9, 10, 13, 32]] = 0
SORTS[[*range(97, 123), *range(223, 247), *range(248, 256)]] = 1
SORTS[48:58] = ALONE
SORTS[1] = ALONE + 1
PROBES = (
    "It's Örtlich, they'll SAY \"x1-22\"!", "a,b;c... été ÇA ß ¿", "«no» AKIA99/+=_ ''d 'M", "  Mixed\tUP\nline  ",
)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it can be shown,
    else the next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts, the tokenizer's own, with a memory of what recurs where that is exact.

    Where white space only separates, the ids of a text are those of its words; where pieces are
    cut by the usual rule, a plain text's are those of its pieces, which are cut for a run of texts
    at once. Both are found out by probing. Any other tokenizer gets whole texts, and any text
    beyond the rule goes through the tokenizer word by word.
    """

    LIMIT = 500_000
    END = b"\x01"  # stands for a text's end among the pieces

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.letters = byte_letters()
        self.vocabulary = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.words = Memory(self.whole)
        self.by_word, self.by_piece = True, False
        self.by_word = self.exact()
        self.by_piece = self.by_word
        self.by_piece = self.by_word and self.exact()

    def exact(self) -> bool:
        self.forget()
        right = all(i.tolist() == [*self.whole(p), self.end_id] for p, i in zip(PROBES, self.encode(PROBES)))
        self.forget()
        return right

    def forget(self) -> None:
        """Pieces by number; the ids of piece k are flat[start[k] : start[k] + size[k]]."""
        self.words.clear()
        self.index = {self.END: 0}
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.end_id], self.kind)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: Iterable[bytes]) -> None:
        ids, sizes = [], []
        cut = self.tokenizer.model.tokenize
        for p in pieces:
            text = p.decode("latin-1")
            if not text.isascii():
                text = "".join(self.letters[b] for b in text.encode())
            tokens = cut(text)
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
            self.index[p] = len(self.index)
        size = np.array(sizes, np.int64)
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.r_[self.flat, np.array(ids, self.kind)]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text and its end."""
        if not self.by_word:
            return [np.array([*self.whole(t), self.end_id], self.kind) for t in texts]
        if len(self.index) > self.LIMIT or len(self.words) > self.LIMIT:
            self.forget()
        plain = [self.by_piece and SIMPLE(t) is not None and "'" not in t and "<|" not in t for t in texts]
        fast = iter(self.encode_plain([t for t, p in zip(texts, plain) if p]))
        return [next(fast) if p else self.encode_words(t) for t, p in zip(texts, plain)]

    def encode_words(self, text: str) -> np.ndarray:
        ids = chain.from_iterable(map(self.words.__getitem__, text.split(" ")))
        return np.fromiter(chain(ids, (self.end_id,)), self.kind)

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        end = self.END.decode()
        letters = np.frombuffer((end.join(texts) + end).lower().encode("latin-1"), np.uint8)
        sort = SORTS[letters]
        # A piece ends where the sort changes; digits and ends stand alone.
        apart = np.zeros(len(letters), np.int64)
        apart[1:] = (sort[1:] != sort[:-1]) | (sort[1:] >= ALONE)
        spaced = np.full(len(letters) + apart.sum(), 32, np.uint8)
        spaced[np.arange(len(letters)) + np.cumsum(apart)] = letters
        pieces = spaced.tobytes().split()
        found = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self.learn(dict.fromkeys(pieces[i] for i in new))
            found[new] = [self.index[pieces[i]] for i in new]
        size = self.size[found]
        past = np.cumsum(size)
        at = np.arange(past[-1]) + np.repeat(self.start[found] - past + size, size)
        return np.split(self.flat[at], past[found == 0][:-1])


def runs(texts: list[str | None], size: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` characters; a longer text is a run of its own."""
    some, total = [], 0
    for t in texts:
        some.append(t or "")
        total += len(some[-1])
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


class Memory(dict):
    """Remembers what a function gave."""

    def __init__(self, make: Callable[[str], list[int]]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> list[int]:
        value = self[key] = self.make(key)
        return value


def tokenise(docs: DataFrame, path: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Pieces of documents: full windows, and what is left of each document.

    A row per piece, ``unit`` numbering them; and one row per task with its token statistics (the
    number of documents that hold each token), so that texts are read once.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("unit", "kind", "start", "length", "doc_tokens")]
        + [T.StructField(c, T.BinaryType()) for c in ("ids", "stats")]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, unit, rows = Encoder(path, end_id), TaskContext.get().partitionId() << 40, 0
        holding = np.zeros(encoder.vocabulary, np.int64)
        total, id_type, out = 0, None, None

        def flush():
            fields = [pa.array(out[0], id_type)]
            fields += [pa.array(c, pa.int64()) for c in out[1:6]]
            fields += [pa.array(c, pa.binary()) for c in out[6:]]
            return pa.RecordBatch.from_arrays(fields, schema.names)

        for b in parts:
            id_type, out = b.schema.field("doc_id").type, [[] for _ in schema]
            coded = chain.from_iterable(map(encoder.encode, runs(b.column("text").to_pylist())))
            for key, ids in zip(b.column("doc_id").to_pylist(), coded):
                holding[ids] += 1  # once for an id, however often it comes
                rows, total, n = rows + 1, total + len(ids), len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    whole = FULL if len(part) == window else REST
                    for c, v in zip(out, (key, unit, whole, at, len(part), n, part.tobytes(), None)):
                        c.append(v)
                    unit += 1
                if len(out[0]) >= 2000:
                    yield flush()
                    out = [[] for _ in schema]
            if out[0]:
                yield flush()
        if rows:
            out = [[None], [unit], [STATS], [rows], [0], [total], [None], [holding.tobytes()]]
            yield flush()

    return source.mapInArrow(run, schema)


def statistics(tokens: DataFrame, end_id: int) -> tuple[int, int, dict[int, int]]:
    """Documents, tokens, and documents per token, over all documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in parts:
            for cell in b.column("stats").to_pylist():
                own = np.frombuffer(cell, np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "docs"])

    rows = tokens.where(F.col("kind") == STATS)
    docs, length = rows.agg(F.sum("start"), F.sum("doc_tokens")).first()
    # At most one row per token of the vocabulary.
    counts = rows.select("stats").mapInArrow(run, "token long, docs long").groupBy("token")
    return docs or 0, length or 0, {r[0]: r[1] for r in counts.agg(F.sum("docs")).collect()}


class Index:
    """BM25 postings of a shard's units, ordered by token."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None):
        lengths = np.array([len(u) for u in units])
        key = np.repeat(np.arange(len(units)) * len(idf), lengths) + np.concatenate(units)
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        owner, token = np.divmod(key[at], len(idf))
        tf = np.diff(at, append=len(key)).astype(np.float64)
        norm = K1 * (1 - B + B * lengths / mean)
        weight = idf[token] * tf * (K1 + 1) / (tf + norm[owner])
        # Numbers of 16 bits are sorted by digits.
        order = np.argsort(token.astype(np.uint16) if len(idf) <= 1 << 16 else token, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.at = np.r_[0, np.cumsum(np.bincount(token, minlength=len(idf)))]
        self.own = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(units)))]
        self.token, self.heavy, self.query_terms = token, weight, query_terms
        # Tokens of many units have a weight for every unit, most of them zero.
        self.wide: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(np.diff(self.at) * WIDE > len(units)).tolist():
            row = self.wide[t] = np.zeros(len(units))
            a, b = self.at[t], self.at[t + 1]
            row[self.owner[a:b]] = self.weight[a:b]

    def query(self, unit: int) -> list[int]:
        """A unit's tokens, heaviest first."""
        a, b = self.own[unit], self.own[unit + 1]
        return self.token[a:b][np.argsort(-self.heavy[a:b], kind="stable")[: self.query_terms]].tolist()

    def scores(self, unit: int) -> np.ndarray:
        """Sums of the query's weights, added token by token in its order."""
        out, at, some = np.zeros(len(self.own) - 1), self.at, []

        def flush():
            owner = np.concatenate([self.owner[a:b] for a, b in some])
            np.add.at(out, owner, np.concatenate([self.weight[a:b] for a, b in some]))
            some.clear()

        for t in self.query(unit):
            row = self.wide.get(t)
            if row is None:
                some.append((at[t], at[t + 1]))
                continue
            if some:
                flush()
            out += row
        if some:
            flush()
        return out


def pack_units(
    units: list[np.ndarray], idf: np.ndarray, mean: float, window: int, query_terms: int | None
) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (unit, begin, end).

    The seed is what the last window had to cut off, else the first unused unit; its best unused
    neighbours follow, best first, and the last of them is cut to fit. Only the last window of a
    shard can be short. Ties go to the earlier unit.
    """
    index = Index(units, idf, mean, query_terms)
    begin = [0] * len(units)
    free = np.ones(len(units), bool)
    seed = 0
    while True:
        while seed < len(units) and not free[seed]:
            seed += 1
        if seed == len(units):
            return
        first, rest = seed, None
        while first is not None:
            free[first] = False
            out, space = [(first, begin[first], len(units[first]))], window
            space -= len(units[first]) - begin[first]
            rest = None
            if space:
                score = np.where(free, index.scores(first), -1.0)
                near = min(64, len(units))
                top = np.argpartition(-score, near - 1)[:near]
                order = top[np.lexsort((top, -score[top]))]
                if sum(len(units[u]) for u in order if free[u]) < space:
                    order = np.argsort(-score, kind="stable")
                for u in order:
                    if not free[u]:
                        break
                    take = min(space, len(units[u]))
                    out.append((int(u), 0, take))
                    free[u] = False
                    space -= take
                    if take < len(units[u]):
                        begin[u], rest = take, int(u)
                    if not space:
                        break
            yield out
            first = rest


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    units_per_shard: int = 2048,
    query_terms: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, a row per piece.

    A document is its token ids and ``end_id``; a missing or empty text is ``end_id`` alone. Every
    id of every row, repeated rows included, lies in one piece; ``ids`` holds them as little-endian
    unsigned 32-bit numbers. A sequence has at most ``window`` tokens, gapless from offset 0, to be
    padded to ``window``; at most one sequence per shard is not full. An empty table gives no row.

    Full windows of long documents are sequences of their own. The rest of each document joins a
    shard, by a hash of its number, of about ``units_per_shard`` units, so a task indexes a bounded
    number of bounded units. A seed asks its shard's BM25 index with all its tokens, or only the
    ``query_terms`` heaviest if that is given; weights use document counts over all documents. Other
    shards are not asked, so the best neighbours of a seed are those of its shard, not of the table.
    ``tokenizer`` must be a path that every executor can read.
    """
    tokens = stage(tokenise(docs, tokenizer, window, end_id, doc_id, text), "tokens")
    n_docs, n_tokens, holding = statistics(tokens, end_id)
    idf = np.zeros(max(holding, default=0) + 1)
    for token, n in holding.items():
        idf[token] = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
    rests = tokens.where(F.col("kind") == REST)
    units = rests.agg(F.count(F.lit(1)), F.sum("length")).first()
    mean = max(1.0, (units[1] or 0) / max(1, units[0]))
    shards = max(1, -(-units[0] // units_per_shard))
    dealt = rests.select(
        F.pmod(F.xxhash64("unit"), F.lit(shards)).alias("shard"),
        "unit", "doc_id", "start", "doc_tokens", "ids", "length",
    )
    schema = T.StructType(
        [T.StructField("doc_id", tokens.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )
    shared = tokens.sparkSession.sparkContext.broadcast(idf)

    def width(b: pa.RecordBatch, i: int) -> str:
        return f"<u{len(b.column('ids')[i].as_py()) // b.column('length')[i].as_py()}"

    def alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            wide = [
                np.frombuffer(x, width(b, i)).astype("<u4").tobytes()
                for i, x in enumerate(b.column("ids").to_pylist())
            ]
            zero = pa.array(np.zeros(len(wide), np.int64))
            number = pa.array(2 * b.column("unit").to_numpy())
            cells = [b.column("doc_id"), b.column("start"), b.column("length"), pa.array(wide, pa.binary())]
            cells += [b.column("doc_tokens"), number, zero]
            yield pa.RecordBatch.from_arrays(cells, schema.names)

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, shard, id_type = shared.value, [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            fields = [(n, id_type if n == "doc_id" else pa.int64()) for n in schema.names]
            made = pa.schema([(n, pa.binary() if n == "ids" else t) for n, t in fields])
            rows: dict[str, list] = {n: [] for n in schema.names}
            ids = [h[3] for h in held]
            windows = pack_units(ids, weights, mean, window, query_terms)
            for nth, pieces in enumerate(windows):
                number, offset = 2 * (shard << 32 | nth) + 1, 0
                for u, a, b in pieces:
                    key, start, doc_tokens, own = held[u]
                    cut = own[a:b].astype("<u4").tobytes()
                    for n, v in zip(rows, (key, start + a, b - a, cut, doc_tokens, number, offset)):
                        rows[n].append(v)
                    offset += b - a
                if len(rows["start"]) >= 2000:
                    yield from batches(rows, made)
                    rows = {n: [] for n in schema.names}
            yield from batches(rows, made)

        for b in parts:
            id_type = b.schema.field("doc_id").type
            columns = [b.column(c).to_pylist() for c in ("shard", "doc_id", "start", "doc_tokens", "ids")]
            for i, (own, key, start, doc_tokens, ids) in enumerate(zip(*columns)):
                if own != shard and held:
                    yield from flush()
                    held = []
                shard = own
                held.append((key, start, doc_tokens, np.frombuffer(ids, width(b, i))))
        if held:
            yield from flush()

    full = tokens.where(F.col("kind") == FULL).mapInArrow(alone, schema)
    # Shards stream through a task one by one; a task gets a bounded number of them.
    least = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-shards // SHARDS_PER_TASK))
    sorted_ = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "unit")
    return full.union(sorted_.mapInArrow(together, schema))
