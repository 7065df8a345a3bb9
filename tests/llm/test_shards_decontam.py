import re

import pytest
from pyspark.sql import functions as F

from tidecast.llm import decontam, shards


def assigned(docs, n, **more):
    sized = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)) + 16, "group": F.xxhash64("text")})
    return shards.assign_shards(sized, n, "size", ["group", "doc_id"], **more).collect()


def check_shards(rows, n, largest):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    total = sum(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) < 2 * largest


@pytest.mark.parametrize("ranges", [1, 16])
def test_shards_are_even(documents, ranges):
    texts = ["same text"] * 200 + [f"text {i} " * (i % 13) for i in range(400)] + [None, "", ""]
    rows = assigned(documents(texts), 7, ranges_per_shard=ranges)
    assert len(rows) == 603
    check_shards(rows, 7, max(r.size for r in rows))


def test_shards_do_not_depend_on_sampling(documents):
    docs = documents([f"text {i % 50}" for i in range(300)])
    one = {(r.doc_id, r.shard, r.slot) for r in assigned(docs, 5)}
    assert one == {(r.doc_id, r.shard, r.slot) for r in assigned(docs, 5, ranges_per_shard=3, seed=99)}


def test_shards_edges(documents):
    assert assigned(documents([]), 4) == []
    same = documents([(1, "a"), (1, "a"), (None, None), (None, None), (2, "x" * 5000)])
    rows = assigned(same.selectExpr("*", "5 AS shard", "6 AS row", "7 AS `range`"), 3)
    assert len(rows) == 5 and all(r.row == 6 and r.range == 7 for r in rows)
    check_shards(rows, 3, 5016)
    with pytest.raises(ValueError):
        shards.assign_shards(same, 0, "n_chars", ["doc_id"])


def test_write_shards(spark, documents, tmp_path):
    docs = documents([f"t{i}" for i in range(40)])
    made = shards.assign_shards(docs, 4, "n_chars", ["doc_id"])
    shards.write_shards(made, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 4


def slow_overlap(texts, items, width):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, item in items:
            x = words(item)
            n = min(width, len(x))
            for win in {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if x else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == win:
                        hit |= set(range(s, s + n))
                        found |= {i} - {None}
        out[d] = (len(w), len(hit), sorted(found))
    return out


TEXTS = [
    "The quick brown fox jumps over the lazy dog",
    "a quick, brown FOX; jumps over! and over",
    "quick brown fox", "one two", "one", None, "", "!!", "É été one two three two one two",
    "the the the the the the", "one two three four five six seven " * 300,
]
ITEMS = [
    (1, "quick brown fox jumps over"), (2, "one two"), (3, "the the the"), (4, None), (5, "..."),
    (None, "lazy dog"), (7, "One, two"), (8, "two three four five six seven one two"), (9, "été"),
]


@pytest.mark.parametrize("width", [1, 2, 4, 10])
def test_overlap(spark, documents, width):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_overlap(documents(TEXTS), bench, window=width).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == slow_overlap(TEXTS, ITEMS, width)
    assert len(got) == len(TEXTS)


def test_overlap_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_overlap(documents(TEXTS), bench, window=4).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == slow_overlap(TEXTS, ITEMS, 4)


def test_overlap_edges(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)])
    docs = docs.selectExpr("*", "1 AS words", "2 AS id", "3 AS n_hit")
    got = decontam.find_overlap(docs, bench, window=10).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in got) == [("1", 2), ("1", 2), ("None", 0), ("None", 2)]
    assert decontam.find_overlap(documents([]), bench).count() == 0
    empty = bench.limit(0)
    assert [r.n_hit for r in decontam.find_overlap(documents(["one two"]), empty).collect()] == [0]
