import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import DOCS

from tidecast.llm import audit, variants
from tidecast.llm.queries import OP12_SQL

# ------------------------------------------------------------------------------------- the audit

BITS = ["a", "B", "é", "漢", "😀", " ", "\n", "\x0b", "\x1c", "\xa0", "#", "|", "the ", " the", "x" * 300, "abcdefgh"]


def slow_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(words), len(set(words)), capitals, len(text), sum(c in "#$%&*|" for c in text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=40).map("".join), min_size=1, max_size=6))
@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_transducer(at_once, texts):
    before, audit.AT_ONCE = audit.AT_ONCE, at_once
    try:
        got = audit.count_texts([t.encode() for t in texts]).T.tolist()
    finally:
        audit.AT_ONCE = before
    assert got == [slow_counts(t) for t in texts]


def test_transducer_forgets_its_state():
    # What lets all bytes be looked up at once: the next state depends on the byte alone.
    assert (audit.NEXT[0] == audit.NEXT[1]).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(audit.Spans, "hashes", lambda self: self.size.astype("uint64") % 2)
    text = b"ab cd ab ef gh cd abcdefghij abcdefghik " + b"y" * 400 + b" " + b"y" * 399 + b"z " + b"y" * 400
    assert audit.count_texts([text, b"ab"]).T.tolist() == [slow_counts(t.decode()) for t in (text, b"ab")]


ODD = [(1, "w " * 60, "p"), (2, "w " * 60, "p"), (2, "w " * 60, "p"), (None, "w " * 60, None), (3, None, "q"),
       (4, "", "q"), (5, " ".join(f"w{i}" for i in range(60)), "q"), (6, "A" * 70, ""), (6, "# " + "Ab " * 70, None),
       (7, " ".join(f"w{i}" for i in range(60)), "p")]


def odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in ODD], DOCS)
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 1), (7, 1, 1), (99, 1, 1), (4, 0, 0)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_equals_sql(spark):
    documents, labels = (t.toPandas() for t in odd_tables(spark))
    documents["doc_id"], labels["doc_id"] = (t["doc_id"].astype("Int64") for t in (documents, labels))
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels)
    cursor = con.execute(OP12_SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    docs, marks = odd_tables(spark)
    clashing = docs.selectExpr("*", "1 AS mask", "2 AS digest", "3 AS n", "'x' AS part", "4 AS step")
    got = audit.audit(clashing, marks.selectExpr("*", "1 AS good", "2 AS n"))
    assert sorted(map(tuple, got.select(*names).collect())) == want
    assert len(want) == 600 * 3


def test_audit_by_hand(spark):
    """Plain loops over documents and orders."""
    docs, labels = odd_tables(spark)
    rows = [(i, t or "", s or "") for i, t, s in ODD]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}

    def fails(i, t):
        n_words, n_distinct, capitals, chars, marks = slow_counts(t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        flags = (n_words < 50, 100 * n_distinct < 65 * n_words, 100 * capitals > 5 * chars, marks > 0, copy)
        return {f for f, bad in zip("ABCDE", flags) if bad}

    failed = [(s, fails(i, t), i in good) for i, t, s in rows]
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(docs, labels).collect()}
    removed, own = Counter(), [f for f in failed if f[0] == "p"]
    for order in map("".join, permutations("ABCDE")):
        for k, f in enumerate(order):
            before = set(order[:k])
            here = [x for x in own if f in x[1] and not before & x[1]]
            row = got["p", order, k + 1]
            assert row.removed == len(here) and row.good_lost == sum(x[2] for x in here)
            assert row.kept == sum(not (before | {f}) & x[1] for x in own)
            assert row.redundant == sum(f in x[1] and bool(before & x[1]) for x in own)
            removed[f] += row.removed
    assert all(got["p", "ABCDE", k + 1].shapley == removed[f] for k, f in enumerate("ABCDE"))


def test_audit_of_nothing(spark):
    docs, labels = odd_tables(spark)
    assert audit.audit(docs.limit(0), labels).count() == 0
    alone = audit.audit(docs, labels.limit(0))
    assert alone.count() == 1800 and alone.where("good_lost + toxic_lost > 0").count() == 0


# ----------------------------------------------------------------------------- spelling variants


def slow_words(rows, damage):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows, least, often, ratio, damage):
    n = {w: k for w, k in slow_words(rows, damage).items() if len(w) >= least and k >= often}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found_variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows)


@pytest.mark.parametrize("least, letters", [(6, "ab"), (6, "aé×z"), (2, "abc"), (1, "ab")])
def test_variants(spark, documents, least, letters):
    rng = random.Random(least)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    some = [rng.choice(words) for _ in range(4000)]
    some += [w for w in words[:6] for _ in range(300)] + ["AaA", "ÉZ", "漢", "3", "-"] * 3
    rng.shuffle(some)
    rows = [(i, " ".join(some[40 * i : 40 * i + 40])) for i in range(len(some) // 40 + 1)]
    rows += [(7, rows[0][1]), (None, "abab ababab"), (None, None), (8, "")]
    docs = documents(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS node")
    got = variants.spelling_variants(docs, min_chars=least, min_count=3, ratio=2, damage=7)
    assert found_variants(got) == slow_variants(rows, least, 3, 2, 7)


def test_long_words_and_hot_beginnings(documents):
    stem = "q" * 60
    words = [stem + x for x in ("", "q", "qq", "a", "ab")] + [x + stem for x in ("a", "b")] + ["x" * 40_000]
    words += ["prefix" + a + b for a in "abcdefgh" for b in "klmn"]
    rows = [(i, " ".join(words)) for i in range(5)] + [(9, "prefixak " * 50)]
    got = variants.spelling_variants(documents(rows), damage=None)
    assert found_variants(got) == slow_variants(rows, 6, 5, 5, None)


def test_segments_cut_between_words(monkeypatch):
    text = "Ab " * 50 + "é" * 30 + " c"
    whole = b" ".join(variants.segments(text)).split()
    monkeypatch.setattr(variants, "SEGMENT", 7)
    assert b" ".join(variants.segments(text)).split() == whole


def test_no_words(documents):
    assert variants.spelling_variants(documents([]), damage=199).count() == 0
    assert variants.spelling_variants(documents([None, "", "a b c"])).count() == 0
    lonely = variants.spelling_variants(documents(["lonely " * 5]))
    assert found_variants(lonely) == [("lonely", "", "lonely", 5, 0, 0)]
    with pytest.raises(ValueError):
        variants.spelling_variants(documents([]), ratio=1)
