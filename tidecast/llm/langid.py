"""Language identification by mixture inference over character n-grams.

A document is a mixture of languages: each word is drawn from one of them with the likelihood of
its n-grams, and expectation-maximisation estimates the shares. The set of languages is the one
with the best penalised likelihood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII that is no letter separates words; what is not ASCII belongs to them.
APART = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
ORDERS, BUCKETS, PRIOR = 4, 1 << 16, 0.5
UNKNOWN = "und"
# The n-gram orders of a word overlap, so their joint evidence counts only in part.
TEMPER, EM_STEPS, PENALTY = 0.4, 10, 3.0
MAX_LANGUAGES = 256
DRAWS = 1 << 30  # the range of the hash that rows are drawn by
AT_ONCE = 1 << 21  # characters of text worked on together; a longer text is a group of its own


@dataclass
class Model:
    languages: list[str]
    # Log-probabilities, a row per order and bucket, a column per language.
    table: np.ndarray


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(APART).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the words, one line per order, and where words begin.

    Every character ends one n-gram of each order, and so does the gap after the word; what lies
    before the word's first letter is one gap.
    """
    spaced = (b" " + b" ".join(words) + b" ").decode().encode("utf-32-le")
    codes = np.frombuffer(spaced, "<u4").astype(np.uint64)
    gap = codes == 32
    end = np.arange(1, len(codes))
    out, key, open_ = [], codes[end], np.ones(len(end), bool)
    for order in range(ORDERS):
        mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        out.append(mixed.astype(np.int64) + order * BUCKETS)
        before = np.maximum(end - order - 1, 0)
        # Beyond the gap before the word there is nothing more to add.
        key = key * np.uint64(0x100000001B3) + np.where(open_, codes[before], 0) + np.uint64(1)
        open_ &= ~gap[before]
    starts = np.flatnonzero(gap[:-1])
    return np.stack(out), starts


def groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``AT_ONCE`` characters, with the position of the first."""
    some, at, total = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        some.append(t or "")
        total += len(some[-1])
        if total >= AT_ONCE:
            yield at, some
            some, at, total = [], i + 1, 0
    if some:
        yield at, some


def fit(
    labelled: DataFrame, rows: int = 60_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> Model:
    """N-gram counts per language from about ``rows`` labelled rows of each.

    The bound is on the classifier's training sample alone: a language with more rows is drawn from
    by a hash of id and text (of the text alone if there is no such id column), any other is used
    whole. Rows without text or label teach nothing, and a language without a word in its sample is
    no candidate. The counts are summed on the executors; a table of fixed size, times the languages
    (at most 256), reaches the driver.
    """
    keys = [F.col(c) for c in (doc_id, text) if c == text or c in labelled.columns]
    place_in_draw = F.pmod(F.xxhash64(*keys), F.lit(DRAWS)).alias("draw")
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), place_in_draw).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    counts = np.full((ORDERS * BUCKETS, len(names)), PRIOR)
    if names:
        # The part of a language's rows that is drawn, for those with more than enough.
        cut = {n: int(rows / size * DRAWS) for n, size in sizes.items() if size > rows}
        drawn = known
        if cut:
            limits = F.create_map(*[F.lit(x) for x in chain.from_iterable(cut.items())])
            drawn = known.where(F.col("draw") < F.coalesce(limits[F.col("lang")], F.lit(DRAWS)))
        drawn = drawn.select("text", "lang")
        place = {n: i for i, n in enumerate(names)}
        schema = pa.schema([("row", pa.int64()), ("lang", pa.int64()), ("n", pa.int64())])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(names), ORDERS * BUCKETS), np.int64)
            for b in parts:
                labels = b.column("lang").to_pylist()
                for at, some in groups(b, "text"):
                    by: dict[str, Counter] = {}
                    for t, label in zip(some, labels[at : at + len(some)]):
                        by.setdefault(label, Counter()).update(words_of(t))
                    for label, words in by.items():
                        if words:
                            found, starts = grams(list(words))
                            length = np.diff(np.r_[starts, found.shape[1]])
                            often = np.repeat(list(words.values()), length)
                            for line in found:
                                sums[place[label]] += np.bincount(line, often, sums.shape[1]).astype(np.int64)
            lang, row = np.nonzero(sums)
            for i in range(0, len(row), 1 << 16):
                part = slice(i, i + (1 << 16))
                cells = [pa.array(x) for x in (row[part], lang[part], sums[lang[part], row[part]])]
                yield pa.RecordBatch.from_arrays(cells, schema=schema)

        total = drawn.mapInArrow(run, "row long, lang long, n long").groupBy("row", "lang")
        got = total.agg(F.sum("n").alias("n")).toPandas()
        counts[got["row"], got["lang"]] += got["n"]
        seen = sorted(got["lang"].unique())
        names, counts = [names[i] for i in seen], counts[:, seen]
    by_order = counts.reshape(ORDERS, BUCKETS, len(names))
    table = np.log(by_order / by_order.sum(1, keepdims=True)).astype(np.float32)
    return Model(names, table.reshape(ORDERS * BUCKETS, len(names)))


def mixture(
    p: np.ndarray, weight: np.ndarray, size: np.ndarray, shares: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """EM shares (languages x documents) and the log-likelihood per document.

    ``p`` is languages x distinct words, document after document, ``size`` the words of each and
    ``weight`` how often each occurs. A share that starts at 0 stays 0.
    """
    at = np.cumsum(size) - size
    total = np.add.reduceat(weight, at)
    for _ in range(EM_STEPS):
        joint = np.repeat(shares, size, axis=1)
        joint *= p
        joint *= weight / joint.sum(0)
        shares = np.add.reduceat(joint, at, axis=1) / total
    like = np.log((np.repeat(shares, size, axis=1) * p).sum(0)) * weight
    return shares, np.add.reduceat(like, at)


def ceiling(
    p: np.ndarray, weight: np.ndarray, size: np.ndarray, shares: np.ndarray, like: np.ndarray
) -> np.ndarray:
    """What the log-likelihood per document cannot exceed, whatever the shares.

    The log is concave: other shares gain at most n log(max slope / n) on these of n words, where a
    language's slope is the sum of its words' p over their mixture. Nothing, once EM has converged.
    """
    at = np.cumsum(size) - size
    n = np.add.reduceat(weight, at)
    mixed = (np.repeat(shares, size, axis=1) * p).sum(0)
    slope = np.add.reduceat(p * (weight / mixed), at, axis=1)
    return like + n * np.log(np.maximum(slope.max(0) / n, 1))


def infer(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages (docs x languages) and the posterior of the single best.

    Zero shares for a document without words.
    """
    languages = len(model.languages)
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    shares = np.zeros((len(texts), languages))
    alone = np.zeros((len(texts), languages))
    if not flat or not languages:
        return shares, alone
    index = dict.fromkeys(flat)
    index = dict(zip(index, range(len(index))))
    found, starts = grams(list(index))
    like = np.take(model.table, found[0], axis=0)
    for line in found[1:]:
        like += np.take(model.table, line, axis=0)
    words = TEMPER * np.add.reduceat(like, starts, axis=0, dtype=np.float64).T
    # Equal words of a document go together.
    ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    ids += np.repeat(np.arange(len(texts)) * len(index), lengths)
    key, weight = np.unique(ids, return_counts=True)
    doc, word = key // len(index), key % len(index)
    with_words = np.flatnonzero(lengths)
    size = np.bincount(doc, minlength=len(texts))[with_words]
    at, n = np.cumsum(size) - size, lengths[with_words]
    weight = weight.astype(np.float64)
    every = np.take(words, word, axis=1)
    single = np.add.reduceat(every * weight, at, axis=1)
    top = every.max(0)
    p = np.exp(every - top) + 1e-30
    base = np.add.reduceat(top * weight, at)
    full, joint = mixture(p, weight, size, np.full((languages, len(n)), 1 / languages))
    price = PENALTY * 0.5 * np.log(n + 1)
    best, value = single.argmax(0), single.max(0)
    chosen = np.zeros((languages, len(n)))
    chosen[best, np.arange(len(n))] = 1
    # No set is more likely than the best shares of all languages, so only these need a look.
    most = ceiling(p, weight, size, full, joint)
    open_ = np.flatnonzero(most + base - value > price)
    if languages > 1 and len(open_):
        rows = np.repeat(np.isin(np.arange(len(n)), open_), size)
        p, weight, size = p[:, rows], weight[rows], size[open_]
        order = np.argsort(-full[:, open_], axis=0, kind="stable")
        for k in range(2, languages + 1):
            start = np.zeros((languages, len(open_)))
            np.put_along_axis(start, order[:k], 1 / k, axis=0)
            part, joint = mixture(p, weight, size, start)
            gain = joint + base[open_] - (k - 1) * price[open_]
            better = gain > value[open_]
            value[open_[better]] = gain[better]
            chosen[:, open_[better]] = part[:, better]
    shares[with_words] = chosen.T
    posterior = np.exp(single - single.max(0))
    alone[with_words] = (posterior / posterior.sum(0)).T
    return shares, alone


def identify(
    docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """All rows, the ``carry`` columns (all if not given) plus ``lang_pred``, ``score``, ``languages``.

    ``lang_pred`` is the language with the largest share, ``und`` (score 0) for a text that is
    missing or has no letter, or if no language is known. ``score`` is the share if several
    languages were chosen, else the posterior among single languages. ``languages`` lists the
    chosen set with shares, largest first. Ties go to the first name. Columns of these names are
    replaced. Whole texts are read.
    """
    own = ("lang_pred", "score", "languages")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in own]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_langid_text"))
    places = source.sparkSession.sparkContext.broadcast(model)
    listed = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType(
        [source.schema[c] for c in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("languages", listed)]
    )
    cells = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = places.value
        for b in parts:
            pred, score, sets = [], [], []
            for _, some in groups(b, "_langid_text"):
                for t, share, alone in zip(some, *infer(some, model)):
                    first = int(share.argmax()) if len(share) else 0
                    if not len(share) or not share[first] or not has_letter(t):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        sets.append([])
                        continue
                    pred.append(model.languages[first])
                    one = np.count_nonzero(share) == 1
                    score.append(min(1.0, float(alone[first] if one else share[first])))
                    used = [j for j in np.argsort(-share, kind="stable") if share[j]]
                    sets.append([{"lang": model.languages[j], "share": float(share[j])} for j in used])
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, cells)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], [*kept, *own])

    return source.mapInArrow(run, schema)
