"""Spelling variants by a relational trie frontier.

States (word, position, node, edits) are joined with the edges of a trie over all words, a level at
a time; a state that reaches the end of a word after one edit has found a neighbour. The trie holds
every word forwards and backwards, and edits are made in the second half of either: above it a node
has many children, and the frontier would grow by all of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import batches, stage

# A-Z to a-z; letters a-z and Latin-1 from C0 on stay, all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
SEGMENT = 1 << 20  # characters of a text worked on at once; cuts lie between words
DISTINCT = 300_000  # words that a task counts before it hands them on
SALTS = 4
FORWARDS, BACKWARDS = ">", "<"
STATE = "text string, pos int, node string, edits int, found string"


def segments(text: str) -> Iterator[bytes]:
    """Lower-cased runs of letters, Latin-1 coded, blanks between them."""
    at = 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        # A run that goes on past the cut belongs to this segment.
        while end < len(text) and LETTERS[ord(text[end]) if ord(text[end]) < 256 else 32] != 32:
            end += 1
        yield text[at:end].encode("latin-1", "replace").translate(LETTERS)
        at = end


def damaged(run: bytes, seed: int, every: int) -> bytes:
    """The run without one letter if ``every`` divides the checksum that ``seed`` begins."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, damage: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(word, n)`` of all runs of letters in all texts, summed in the tasks before the shuffle.

    With ``damage``, a run loses a letter where the crc32 of ``<doc_id>:<run>`` is divisible by it,
    the letter at that checksum modulo the run's length; a missing id is empty there.
    """
    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            words = [w.decode("latin-1") for w in counts]
            yield from batches({"word": words, "n": list(counts.values())}, schema, 1 << 16)
            counts.clear()

        for b in parts:
            for key, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                seed = zlib.crc32(f"{key or ''}:".encode())
                for segment in segments(t or ""):
                    own = Counter(segment.split())
                    if damage is None:
                        counts.update(own)
                        continue
                    for w, n in own.items():
                        counts[damaged(w, seed, damage)] += n
                    if len(counts) > DISTINCT:
                        yield from flush()
        yield from flush()

    rows = source.mapInArrow(run, "word string, n long")
    return rows.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def oriented(word: Column, forwards: Column) -> Column:
    """A word as it runs through the trie, and back."""
    return F.when(forwards, word).otherwise(F.reverse(word))


def advance(states: DataFrame) -> DataFrame:
    """One level: states and the trie's edges below their nodes give the states of the next level.

    States without an edit are at once the trie: they say which edges a node has, and how many
    words are below an edge. An edge with one word is a leaf, where the rest is compared at once.
    ``edits`` 2 marks what has found a word. Edges of a node are a row of at most one per letter;
    it is repeated per salt, so that a node that many states share is joined in several tasks.
    """
    own = F.expr("substring(text, pos + 1, 1)")
    edges = (
        states.where("edits = 0")
        .groupBy("node", own.alias("letter"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("sole"))
        .groupBy("node")
        .agg(F.collect_list(F.struct("letter", "n", "sole")).alias("edges"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # A letter is replaced in the word's own second half forwards, in its first half backwards; a gap
    # is filled likewise. A letter is put in behind its equals, in the word's own direction, so that
    # each longer word is met once.
    placed = (
        states.where("edits < 2")
        .withColumn("salt", F.expr(f"cast(pmod(xxhash64(text, pos), {SALTS}) as int)"))
        .withColumn("own", own)
        .withColumn("forwards", F.col("text").startswith(FORWARDS))
        .withColumn("past", F.expr("pos - 1 - if(forwards, 0, 1)"))
        .withColumn("half", F.expr("(char_length(text) - if(forwards, 1, 0)) div 2"))
        .withColumn("may_replace", F.expr("own <> '' and pos - 1 >= half"))
        .withColumn("may_insert", F.expr("past >= half"))
        .withColumn("behind", F.expr("if(forwards, own, substring(node, -1, 1))"))
    )
    met = placed.join(edges, ["node", "salt"])
    step = "struct(pos + {move} as pos, {edits} as edits, e.letter as letter, e.n as n, e.sole as sole)"

    def take(which: str, move: int, edits: int) -> str:
        return f"transform(filter(edges, e -> {which}), e -> {step.format(move=move, edits=edits)})"

    moves = f"""case when edits = 1 then {take("e.letter = own", 1, 1)}
      else concat(
        {take("e.letter = own and own <> '' and e.n > 1", 1, 0)},
        {take("may_replace and e.letter > own", 1, 1)},
        {take("may_insert and e.letter <> '' and e.letter <> behind", 0, 1)})
      end"""
    next_ = met.select("text", "node", F.expr(f"inline({moves})")).select(
        "text", "pos", F.concat("node", "letter").alias("node"), "edits", "letter", "n", "sole"
    )
    # At a leaf, or at a word's end, the state has found its word or nothing.
    last = F.expr("edits = 1 and (n = 1 or letter = '')")
    rest = F.expr("substring(sole, char_length(node) + 1) = substring(text, pos + 1)")
    ended = F.expr("letter = ''")
    return next_.where(~last | ended | rest).select(
        "text",
        "pos",
        "node",
        F.when(last, 2).otherwise(F.col("edits")).alias("edits"),
        F.when(last, F.col("sole")).alias("found"),
    )


def neighbours(words: DataFrame, min_chars: int = 6) -> DataFrame:
    """``(word, near)`` for all pairs of words that one inserted, deleted or replaced letter parts.

    ``words`` holds distinct words of at least ``min_chars`` letters. Each pair comes both ways. A
    level is a table in the shared folder; there are as many as the longest beginning, or ending,
    that two words share.
    """
    directions = F.explode(F.array(F.lit(FORWARDS), F.lit(BACKWARDS)))
    spread = words.select("word", directions.alias("way")).select(
        F.concat("way", oriented(F.col("word"), F.col("way") == FORWARDS)).alias("text")
    )
    begun = 1 + min_chars // 2  # no edit lies before half of the shortest word
    states = spread.select(
        "text",
        F.lit(begun).alias("pos"),
        F.substring("text", 1, begun).alias("node"),
        F.lit(0).alias("edits"),
        F.lit(None).cast("string").alias("found"),
    )
    levels = []
    while not levels or not states.where("edits < 2").isEmpty():
        states = stage(advance(states), "frontier")
        levels.append(states.where("edits = 2").select("text", "found"))
    hits = levels[0]
    for more in levels[1:]:
        hits = hits.union(more)
    forwards = F.col("text").startswith(FORWARDS)
    pairs = hits.select(
        oriented(F.expr("substring(text, 2)"), forwards).alias("word"),
        oriented(F.expr("substring(found, 2)"), forwards).alias("near"),
    )
    return pairs.union(pairs.select("near", "word"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: where ``(word, link)`` leads, followed to a word that links to itself.

    Every round follows twice as many links as the one before.
    """
    links = stage(links, "links")
    while True:
        ahead = links.select(F.col("word").alias("link"), F.col("link").alias("further"))
        moved = stage(
            links.join(ahead, "link").select(
                "word", F.col("further").alias("link"), (F.col("further") != F.col("link")).alias("moved")
            ),
            "links",
        )
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links.withColumnRenamed("link", "root")


def spelling_variants(
    docs: DataFrame,
    min_chars: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    damage: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for all words of ``min_chars`` letters.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, that occur ``min_count`` times
    over all texts; missing and empty texts hold none, every row counts, repeated ones too, and
    texts are read whole. Near words differ by one inserted, deleted or replaced letter. ``form`` is
    the near word that occurs most (ties: the smallest in code-point order) if that is at least
    ``ratio`` times as often as the word itself; ``root`` follows forms to the last one. ``damage``
    is that of ``count_words``. An empty table gives no row; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("forms lead to their root only if each occurs more often than the last")
    counts = count_words(docs, damage, doc_id, text)
    kept = stage(
        counts.where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)), "words"
    )
    near = neighbours(kept.select("word"), min_chars)
    often = near.join(kept.withColumnRenamed("word", "near"), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    )
    enough = F.expr(f"-best.less >= {ratio} * n")
    formed = stage(
        kept.join(often, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(formed.select("word", F.coalesce("form", "word").alias("link")))
    return formed.join(last, "word").select("word", "form", "root", "n", "n_near", "form_n")
