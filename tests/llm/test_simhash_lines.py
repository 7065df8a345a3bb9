import re

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidecast.llm import components, lines, simhash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\né ß", max_size=60))
def test_fingerprint(text):
    assert simhash.simhash(text.encode(), 3) % (1 << 64) == slow_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(200))
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 16)
    assert simhash.simhash(text.encode(), 3) % (1 << 64) == slow_fingerprint(text)


def slow_groups(prints, distance):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_reach_every_pair(spark, distance):
    base = 0x0123456789ABCDEF
    flips = [0, 1, 2, 3, 7, 15, 31, 1 << 63, 3 << 62, 7 << 61, 0xFF, 0xFF00, 0xF0F0 << 30]
    prints = sorted({base ^ f for f in flips})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = components.components(simhash.links(nodes, distance)).collect()
    root = {r.node: r.root for r in found}
    groups = slow_groups(prints, distance)
    for i, a in enumerate(signed):
        for j, b in enumerate(signed):
            assert (root.get(a, a) == root.get(b, b)) == (groups[i] == groups[j])


def test_near_duplicates(documents):
    long = " ".join(f"word{i}" for i in range(400))
    texts = ["", None, long, long + " more", "x y", "x y", "other words than these here", " \t"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [rows[i].fingerprint % (1 << 64) for i in range(8)] == prints
    assert [rows[i].component_id for i in range(8)] == slow_groups(prints, 2)
    assert rows[1].component_id == rows[7].component_id == 0


def test_near_duplicates_edges(documents, spark):
    assert simhash.near_duplicates(documents([])).count() == 0
    same = documents([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "alone here it is")])
    got = sorted(simhash.near_duplicates(same).collect(), key=str)
    assert len(got) == 4
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "None"]
    clash = documents(["p q r"]).selectExpr("*", "1 AS fingerprint", "2 AS component_id", "3 AS root")
    assert simhash.near_duplicates(clash).first().component_id == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(same, distance=5)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (3, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def slow_lines(texts, least):
    strip = " \t\n\x0b\x0c\r"
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    seen = {}
    for d, ls in enumerate(split):
        for k in map(key, ls):
            seen.setdefault(k, set()).add(d)
    drop = {k for k, ds in seen.items() if k and len(ds) >= least}
    return [("\n".join(x for x in ls if key(x) not in drop), len(ls), sum(key(x) in drop for x in ls)) for ls in split]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAé É\n\t\x0b ", max_size=12)), min_size=1, max_size=8))
def test_lines(documents, texts):
    got = lines.drop_common_lines(documents(texts), min_documents=3).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in got] == slow_lines(texts, 3)


def test_lines_keep_rows_and_columns(documents):
    docs = documents(["a\nb", "a\nc", "a", None]).selectExpr("*", "7 AS _row", "8 AS n_lines", "9 AS `_key.x`")
    got = lines.drop_common_lines(docs.union(docs.limit(1)), min_documents=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "_key.x", "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 5 and all(r._row == 7 for r in rows)
    assert sorted(r.text for r in rows) == ["", "", "b", "b", "c"]
    assert lines.drop_common_lines(documents([])).count() == 0


def test_lines_of_a_long_text(documents):
    body = "\n".join(f"own {i}" if i % 2 else "shared" for i in range(4000))
    got = lines.drop_common_lines(documents([body, "shared", "SHARED "]), min_documents=3).collect()
    long = next(r for r in got if r.doc_id == 0)
    assert (long.n_lines, long.n_dropped) == (4000, 2000)
    assert long.text.split("\n") == [f"own {i}" for i in range(1, 4000, 2)]


def test_lines_count_documents_not_rows(documents):
    """Rows of one id are one document, and so are all rows without an id."""
    docs = documents([(1, f"same\nown {i}") for i in range(10)] + [(None, "none\nx")] * 10 + [(2, "none"), (3, "none")])
    got = lines.drop_common_lines(docs, min_documents=3).collect()
    assert [r.n_dropped for r in got if r.doc_id == 1] == [0] * 10
    assert [(r.text, r.n_dropped) for r in got if r.doc_id is None] == [("x", 1)] * 10
    assert all(r.n_dropped == 1 for r in got if r.doc_id in (2, 3))
