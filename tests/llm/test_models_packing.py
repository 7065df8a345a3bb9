import dataclasses
import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecast.llm import langid, lm, packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")

SAMPLES = {
    "en": "the quick dog and the other house were with them when that happened there",
    "fr": "le chien rapide et la maison étaient avec eux quand cela est arrivé ici",
    "de": "der schnelle hund und das haus waren mit ihnen als das dort geschehen ist",
}


def corpus(documents, n=60):
    rng, rows = np.random.default_rng(1), []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words, 30)), lang, "s", 0))
    return rows


def test_language(spark, documents):
    from llm_tables import DOCS

    known = spark.createDataFrame(corpus(documents) + [(99, None, "xx", "s", 0), (98, "a b", None, "s", 0)], DOCS)
    model = langid.fit(known)
    assert model.languages == ["de", "en", "fr"]
    asked = ["the house and the dog", "la maison et le chien rapide", "", None, "12 !? ²", "und das haus"]
    mixed = SAMPLES["en"] + " " + SAMPLES["fr"]
    docs = documents([*asked, mixed, SAMPLES["de"] * 3000]).selectExpr("*", "1 AS score", "2 AS languages")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "fr", "und", "und", "und", "de"]
    assert got[2].score == 0 and got[2].languages == [] and got[7].lang_pred == "de"
    assert {x.lang for x in got[6].languages} == {"en", "fr"}
    assert abs(sum(x.share for x in got[6].languages) - 1) < 1e-6
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(documents):
    model = langid.fit(documents([]))
    assert model.languages == []
    assert [r.lang_pred for r in langid.identify(documents(["abc", None]), model).collect()] == ["und"] * 2
    assert langid.identify(documents([]), model).count() == 0


def test_every_language_is_drawn(spark):
    from llm_tables import DOCS

    rows = [(i, SAMPLES["en"], "en", "s", 0) for i in range(3000)]
    rows += [(5000 + i, f"{SAMPLES[x]} {i}", x, "s", 0) for x in ("de", "fr") for i in range(3)]
    rows += [(None, "12 34", "xx", "s", 0)]
    known = spark.createDataFrame(rows, DOCS)
    model = langid.fit(known, rows=30)
    assert model.languages == ["de", "en", "fr"]
    # A language that is not drawn has a flat table.
    assert (np.ptp(model.table, axis=0) > 1).all()
    rare = langid.fit(known.where("lang <> 'en'"))
    assert np.allclose(model.table[:, [0, 2]], rare.table)
    asked = spark.createDataFrame([(1, "the house and the dog"), (2, "la maison et le chien")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {1: "en", 2: "fr"}


def test_mixture_never_loses_likelihood():
    rng = np.random.default_rng(0)
    p, size = rng.random((3, 50)) + 1e-3, np.array([20, 30])
    weight, flat = rng.integers(1, 5, 50).astype(float), np.full((3, 2), 1 / 3)
    before = np.add.reduceat(np.log(p.mean(0)) * weight, [0, 20])
    shares, after = langid.mixture(p, weight, size, flat)
    assert np.allclose(shares.sum(0), 1) and (after >= before).all()


def test_ceiling_is_above_every_mixture():
    """Ten steps over many languages stay below a set of two."""
    rng = np.random.default_rng(1)
    p = rng.random((60, 80)) * 0.9 + 0.05
    p[0, :40], p[1, 40:] = 1, 1
    weight, size = np.ones(80), np.array([80])
    shares, early = langid.mixture(p, weight, size, np.full((60, 1), 1 / 60))
    two = np.zeros((60, 1))
    two[:2] = 0.5
    _, late = langid.mixture(p, weight, size, two)
    assert early[0] < late[0] <= langid.ceiling(p, weight, size, shares, early)[0]
    _, best = langid.mixture(p[:2], weight, size, np.full((2, 1), 0.5))
    assert langid.ceiling(p[:2], weight, size, np.full((2, 1), 0.5), best)[0] < best[0] + 20


@pytest.mark.parametrize("n", [60, 80])
def test_documents_near_the_limit_are_searched(n, monkeypatch):
    """The choice is that of a search of all documents."""
    names = [f"l{i:02}" for i in range(40)]
    rng = np.random.default_rng(n)
    table = np.log(rng.random((langid.ORDERS * langid.BUCKETS, 40)) * 0.9 + 0.05).astype(np.float32)
    made = langid.Model(names, table)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, n)) for _ in range(200)]
    got = langid.infer(texts, made)[0]
    monkeypatch.setattr(langid, "ceiling", lambda *a: np.full(len(texts), np.inf))
    assert np.allclose(got, langid.infer(texts, made)[0])


@pytest.fixture(scope="module")
def model(spark):
    from llm_tables import DOCS

    return lm.train(spark.createDataFrame(corpus(None, 240), DOCS))


def test_lm_base_counts(spark, documents, model):
    train = Counter()
    for _, text, *_ in corpus(None, 240):
        train.update([*text.encode().split(), None])
    n, v = sum(train.values()), len(train)
    texts = ["the dog", "The DOG unseen", "", None, " \t ", "haus " * 5000]
    got = {r.doc_id: r for r in lm.score(documents(texts), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        tokens = [*(t or "").lower().encode().split(), None]
        want = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9)
        assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n
        assert got[i].n_known == sum(train[x] > 0 for x in tokens) and got[i].score < 0


def places(model, some):
    """Codes, units and sizes of texts, and the keys of their places and rare tokens."""
    lex, coder = model.lexicon, lm.Coder(model.lexicon.tokens)
    words = [t.lower().encode().split() for t in some]
    flat = [w for own in words for w in own]
    coded = coder.code(flat)
    codes, units, sizes = lm.stream(coded, np.array([*map(len, words)]), lm.head_units(lex.tokens))
    sums = np.array([zlib.crc32(flat[i]) for i in np.flatnonzero(coded < 0)], "<u4")
    return codes, units, sizes, *lm.pair_keys(codes, lm.classes_of(units, lex.classes), sizes, sums)


def slow_scores(model, train, some):
    """Scores of every place from counts in memory, and the sizes."""
    *_, pairs, own = places(model, train)
    codes, units, sizes, asked, alone = places(model, some)
    keys = np.unique(np.concatenate([pairs, own, asked, alone]))
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, np.searchsorted(keys, np.concatenate([pairs, own])), 1)
    told = lm.sums_of(keys, n)
    at, rare = np.searchsorted(keys, asked), np.searchsorted(keys, alone)
    return codes, sizes, lm.place_scores(codes, units, told[:, at], told[0, rare], model.lexicon, model.weights)


TRAIN = [t for _, t, *_ in corpus(None, 240)]


def test_lm_is_a_distribution(model):
    """After any history the probabilities of all tokens sum to one, but for classes without any."""
    lex = model.lexicon
    words = [t.decode() for t in lex.tokens]
    # Of unseen tokens, one per class that takes them.
    fresh = {int(lex.classes[lm.suffix_unit(w.encode())]): w for w in (f"zz{i}q" for i in range(3000))}
    for history in ("the", "der hund", ""):
        at = len(history.split())
        some = [f"{history} {w}" for w in [*words, *fresh.values()]] + [history]
        _, sizes, scores = slow_scores(model, TRAIN, some)
        total = (10 ** scores[np.cumsum(sizes) - sizes + at]).sum()
        assert 0.9 < total < 1.001


def test_lm_weights_meet_their_constraints(spark):
    """Expected counts, from plain softmax in float64, are the observed ones less the prior's share."""
    from llm_tables import DOCS

    made = lm.train(spark.createDataFrame(corpus(None, 240), DOCS).repartition(3))
    head = lm.head_units(made.lexicon.tokens)
    seen, told = np.zeros((2, lm.ROWS, lm.CLASSES))
    for row in made.coded.select("lengths", "codes").collect():
        _, units, _ = lm.stream(lm.unpack(bytes(row.codes), "<i4"), np.array(row.lengths), head)
        own, rows = lm.encode(units, made.lexicon.classes)
        odds = np.exp(made.lexicon.bias + made.weights.astype(np.float64)[rows].sum(0))
        for r in rows:
            np.add.at(seen, (r, own), 1)
            np.add.at(told, r, odds / odds.sum(1, keepdims=True))
    off = np.abs(told + made.weights - seen).sum() / seen.sum()
    assert off < 0.025


def test_lm_replies_equal_plain_counts(documents, model):
    """Scores through the sharded table against counts in memory."""
    some = ["the dog and", "", "der hund unseen ist", "x", "la maison the dog", "the dog and the dog and"]
    codes, sizes, scores = slow_scores(model, TRAIN, some)
    want = lm.score_run(codes, sizes, scores, model.lexicon)["score"].tolist()
    for shards in (model.shards, 16):
        asked = dataclasses.replace(model, shards=shards)
        got = {r.doc_id: r.score for r in lm.score(documents(some), asked, ["doc_id"]).collect()}
        assert [got[i] for i in range(len(some))] == pytest.approx(want)


def test_lm_does_not_depend_on_the_tasks(spark, documents):
    """The same model and scores from 1, 8 and 64 training tasks."""
    from llm_tables import DOCS

    train, asked = spark.createDataFrame(corpus(None, 160), DOCS), documents([t for _, t, *_ in corpus(None, 200)][160:])
    results = []
    for n in (1, 8, 64):
        made = lm.train(train.repartition(n))
        rows = lm.score(asked.repartition(n), made, ["doc_id"]).collect()
        results.append({r.doc_id: r.score for r in rows})
    for other in results[1:]:
        assert other == pytest.approx(results[0], rel=1e-6)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_lm_beats_a_bigram(spark):
    """Per held-out token, against a textbook bigram with absolute discounting."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: [None, *r.text.lower().encode().split(), None] for r in docs.collect()}
    held = {i for i in texts if i % 5 == 0}
    ones, pairs, kinds, before = Counter(), Counter(), Counter(), Counter()
    for i in texts.keys() - held:
        ones.update(texts[i][1:])
        for pair in zip(texts[i], texts[i][1:]):
            kinds[pair[0]] += pair not in pairs
            pairs[pair] += 1
            before[pair[0]] += 1
    n, v = sum(ones.values()), len(ones)

    def bigram(a, b):
        base = (ones[b] + 0.1) / (n + 0.1 * (v + 1))
        if not before[a]:
            return base
        return max(pairs[a, b] - 0.75, 0) / before[a] + 0.75 * kinds[a] / before[a] * base

    plain = sum(math.log10(bigram(a, b)) for i in held for a, b in zip(texts[i], texts[i][1:]))
    made = lm.train(docs.where("doc_id % 5 <> 0"))
    got = lm.score(docs.where("doc_id % 5 = 0"), made, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > plain > got[1]


def test_lm_keys_survive_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    assert (lm.unpack(lm.pack(keys), "<u8") == keys).all()


def test_lm_keys_pack_closely():
    """Head tokens are told by rank, so a run's keys take less than differences of hashes do."""
    codes = np.random.default_rng(3).zipf(1.2, 300_000) % 50_000
    sizes = np.full(100, 3000)
    codes[np.cumsum(sizes) - 1] = lm.STOP
    pairs, own = lm.pair_keys(codes, np.zeros(len(codes), np.int64), sizes, np.zeros(0, np.int64))
    assert (pairs.astype(np.int64)[codes >= 0] % (1 << lm.TOKEN_BITS) == codes[codes >= 0]).all() and not len(own)
    keys = np.unique(pairs)
    cell = lm.pack_keys(keys)
    assert (lm.unpack_keys(cell) == keys).all()
    assert (lm.unpack_keys(lm.pack_keys(keys[:1])) == keys[:1]).all()
    steps = lm.pack(np.diff(np.unique(lm.mixed(pairs)), prepend=np.uint64(0)))
    assert len(cell) < 0.8 * len(steps)


def test_lm_words_are_plain_splits(monkeypatch):
    """However many texts are split at once; only ASCII blanks part words, only A-Z are lower-cased."""
    rng = np.random.default_rng(2)
    some = ["", None, " \t\n\x0b\x0c\r", "AÉ b\x1cd\x85E\u3000f ", "\x00 x\x00Y", "Haus " * 40]
    some += ["".join(rng.choice([*"aB \t\n\r\x0b\x0c\x1c\x1fÉ\u2003\u3000"], n)) for n in rng.integers(0, 40, 300)]
    want = [(t or "").encode().lower().split() for t in some]
    for column in (pa.array(some), pa.array(["x y", *some]).slice(1), pa.array(some).cast(pa.binary())):
        for size in (1, 60, 1 << 22):
            monkeypatch.setattr(lm, "TEXT_BYTES", size)
            got = []
            for words, lengths in lm.words_of(pa.record_batch([column], ["t"]), "t"):
                ends = np.cumsum(lengths).tolist()
                got += [words.to_pylist()[e - n : e] for e, n in zip(ends, lengths.tolist())]
            assert got == want


def test_lm_coding_costs_less_than_asking_a_dictionary():
    """Of a head as large as in use; the two are measured in turns, their best times compared."""
    rng = np.random.default_rng(4)
    tokens = [b"w%d" % i for i in rng.permutation(lm.HEAD)]
    text = b" ".join(tokens[i] for i in rng.integers(0, lm.HEAD, 300_000)).decode()
    coder, rank, times = lm.Coder(tokens), {t: i for i, t in enumerate(tokens)}, ([], [])
    batch = pa.record_batch([pa.array([text])], ["t"])
    for _ in range(5):
        begin = time.process_time()
        words = text.encode().lower().split()
        want = np.fromiter((rank.get(w, -1) for w in words), np.int32, len(words))
        middle = time.process_time()
        got = np.concatenate([coder.code(words) for words, _ in lm.words_of(batch, "t")])
        times[0].append(middle - begin), times[1].append(time.process_time() - middle)
        assert (got == want).all()
    assert min(times[1]) < min(times[0])


def test_lm_runs_are_cut_where_they_are_full(spark):
    """Runs go on over the parts in which a batch is split; rare words keep their rows."""
    words = 300_000
    some = [*["haus " * words] * 5, None, "der hund rar", "", *["haus " * words] * 3, "seltsam"]
    docs = spark.createDataFrame([*enumerate(some)], "doc_id int, text string").coalesce(1)
    rows = sorted(lm.code_texts(docs, [b"haus", b"der"], ["doc_id"], "text").collect(), key=lambda r: r.run)
    assert [[k.doc_id for k in r.kept] for r in rows] == [[0, 1], [2, 3], [4, 5, 6, 7, 8], [9, 10], [11]]
    flat = [n for r in rows for n in r.lengths]
    assert flat == [len((t or "").split()) for t in some]
    number = {k._lm_row: k.doc_id for r in rows for k in r.kept}
    tails = [(number[t._lm_of], bytes(t.token)) for r in rows for t in r.tails]
    assert tails == [(6, b"hund"), (6, b"rar"), (11, b"seltsam")]
    sums = [x for r in rows for x in lm.unpack(bytes(r.sums), "<u4").tolist()]
    assert sums == [zlib.crc32(t) for _, t in tails]
    codes = np.concatenate([lm.unpack(bytes(r.codes), "<i4") for r in rows])
    assert codes[codes != 0].tolist() == [1, *(-lm.suffix_unit(t) for _, t in tails)]


def test_lm_softmax_is_that_of_summed_weights():
    rng = np.random.default_rng(6)
    weights = rng.normal(0, 3, (lm.ROWS, lm.CLASSES)).astype(np.float32)
    bias = rng.normal(-3, 1, lm.CLASSES).astype(np.float32)
    rows = np.stack([rng.integers(x, y, 500) for x, y in zip(lm.OFFSETS, (*lm.OFFSETS[1:], lm.ROWS))])
    odds = np.exp(bias + weights.astype(np.float64)[rows].sum(0))
    assert np.allclose(lm.softmax(lm.odds_of(weights, bias), rows), odds / odds.sum(1, keepdims=True), rtol=1e-5)


def test_lm_learns_from_context(documents, model):
    rng = np.random.default_rng(5)
    own = [" ".join(rng.choice(SAMPLES[x].split(), 30)) for x in SAMPLES for _ in range(5)]
    rows = lm.score(documents(own), model, ["doc_id"]).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_edges(documents):
    none = lm.train(documents([]))
    row = lm.score(documents(["a b", None]), none, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in row] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    same = documents([(1, "a"), (1, "a"), (None, "a")]).selectExpr("*", "1 AS n_tokens", "2 AS token")
    assert len(lm.score(same, none, ["doc_id", "lang"]).collect()) == 3
    assert lm.score(documents([]), none, ["doc_id"]).count() == 0


TEXTS = [
    "The quick brown fox, it's 123 OK?!", "", None, "été Ça naïve ﬁ İstanbul Ünïcode ß ΑΣ́ x́y 　 日本語",
    "tab\tand\nline\x0b \x1c  nbsp", "<|endoftext|> don't ''s we'll", "a" * 500, "½ ² ª º × ÷ µ ÿ Þ",
]


def test_encoder_is_the_tokenizer():
    encoder = packing.Encoder(PATH, 2)
    assert encoder.by_word and encoder.by_piece and encoder.kind == "<u2"
    texts = [t or "" for t in [*TEXTS, *[x + " " + y for x in TEXTS[:1] for y in TEXTS if y]]]
    for _ in range(2):
        got = encoder.encode(texts)
        assert [g.tolist() for g in got] == [[*encoder.whole(t), 2] for t in texts]
    encoder.LIMIT = 3
    assert [g.tolist() for g in encoder.encode(texts)] == [[*encoder.whole(t), 2] for t in texts]
    bytes_ = packing.Encoder(public.path("byte_bpe_50k.json"), 7)
    assert not bytes_.by_word and bytes_.encode(["a  b c"])[0].tolist() == [*bytes_.whole("a  b c"), 7]
    assert encoder.encode([]) == []


def check_packing(rows, ids, window):
    seen, filled = {}, {}
    for r in rows:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length > 0
        seen.setdefault(r.doc_id, []).append((r.start, own, r.doc_tokens))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, pieces in seen.items():
        pieces.sort()
        assert sum((p[1] for p in pieces), []) == ids[key]
        assert all(p[2] == len(ids[key]) for p in pieces)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert set(seen) == set(ids)
    return [sum(n for _, n in parts) for parts in filled.values()]


@pytest.mark.parametrize("per_shard", [5, 2048])
def test_packing(documents, per_shard):
    encoder = packing.Encoder(PATH, 2)
    texts = TEXTS + [f"doc {i} " * (i % 40) for i in range(60)] + ["long text here " * 400]
    docs = documents(texts).selectExpr("*", "1 AS unit", "2 AS ids", "3 AS shard")
    rows = packing.pack(docs, PATH, window=64, units_per_shard=per_shard).collect()
    ids = {i: [*encoder.whole(t or ""), 2] for i, t in enumerate(texts)}
    sizes = check_packing(rows, ids, 64)
    shards = max(1, -(-len(texts) // per_shard))
    assert sum(s < 64 for s in sizes) <= shards


def test_neighbours_come_first():
    a, b = np.arange(10, 18), np.arange(50, 58)
    units = [np.r_[a, 2], np.r_[b, 2], np.r_[a[::-1], 2], np.r_[b[1:], 2]]
    windows = list(packing.pack_units(units, np.ones(60), 9.0, 18, 64))
    assert windows[0] == [(0, 0, 9), (2, 0, 9)]
    assert [u for u, _, _ in windows[1]] == [1, 3]


@pytest.mark.parametrize("wide", [1, 16, 10**6])
@pytest.mark.parametrize("terms", [None, 7])
def test_scores_equal_plain_bm25(monkeypatch, wide, terms):
    """Whether a token of many units has a row of its own or postings; no unit's tokens are sorted
    before it asks."""
    monkeypatch.setattr(packing, "WIDE", wide)
    rng = np.random.default_rng(4)
    units = [(rng.zipf(1.3, n) % 300).astype("<u2") for n in rng.integers(1, 80, 60)]
    idf, mean = rng.random(300), float(np.mean([len(u) for u in units]))
    index = packing.Index(units, idf, mean, terms)
    counts = [Counter(u.tolist()) for u in units]

    def weight(t, u):
        norm = packing.K1 * (1 - packing.B + packing.B * len(units[u]) / mean)
        return idf[t] * counts[u][t] * (packing.K1 + 1) / (counts[u][t] + norm)

    for asks in (0, 17, 59):
        query = sorted(counts[asks], key=lambda t: (-weight(t, asks), t))[:terms]
        assert index.query(asks) == query
        want = [sum(weight(t, u) for t in query if counts[u][t]) for u in range(len(units))]
        assert index.scores(asks).tolist() == pytest.approx(want)


def test_seeds_ask_with_all_tokens(documents):
    """Here the tokens shared with the neighbour are lighter than 100 others of the seed."""
    encoder = packing.Encoder(PATH, 2)
    known = sorted(w for w in encoder.tokenizer.get_vocab() if len(w) > 5 and w.isascii() and w.isalpha() and w.islower())
    known = [w for w in known if len(encoder.whole(w)) == 1][:1000]
    own, shared, rest = known[:100], known[100:110], known[110:]
    other = [rest[50 * i : 50 * i + 50] for i in range(6)]
    texts = [own + shared, *other, shared * 10]
    rows = packing.pack(documents([" ".join(t) for t in texts]).coalesce(1), PATH, window=212).collect()
    place = {r.doc_id: r.sequence_id for r in rows}
    assert place[0] == place[7] and sum(s == place[0] for s in place.values()) == 2


def test_packing_edges(documents):
    assert packing.pack(documents([]), PATH).count() == 0
    rows = packing.pack(documents([(1, "x"), (1, "x"), (None, None)]), PATH, window=8).collect()
    assert sum(r.length for r in rows) == 5 and len({r.sequence_id for r in rows}) == 1
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]


def test_pipeline(spark, documents, tmp_path):
    lines = [f"sentence number {i} is unlike the others {i * 7}" for i in range(12)]
    texts = [f"shared line\n{x}" for x in lines] + ["12 34", None, "shared line\n" + lines[0]]
    texts += ["word " + " ".join(f"bench{i}" for i in range(10)) + " tail"]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, " ".join(f"Bench{i}" for i in range(10)))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = packing.Encoder(PATH, 2)
    check_packing(rows, {i: [*encoder.whole(lines[i]), 2] for i in range(12)}, 4096)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_edges(spark, documents, tmp_path):
    docs = documents([(1, "some words here"), (1, "some words here"), (None, "other words there"), (2, "")])
    docs = docs.selectExpr("*", "1 AS component_id", "'x' AS lang_pred", "2 AS n_hit")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]


def test_pipeline_tells_rows_apart_without_ids(spark, documents, tmp_path):
    bench = " ".join(f"bench{i}" for i in range(10))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit, clean = f"head {bench} tail", "a clean text about quite other things than that"
    docs = documents([(None, hit), (None, clean), (None, None), (7, hit), (7, clean)])
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, clean), (None, None), (7, clean)}

    texts = [f"{w} text number {w}{w} of its own kind {w}{w}{w}" for w in ("red", "green", "blue", "grey")]
    pairs = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (2, texts[2])]
    docs = documents(pairs + [(None, texts[3])] * 3 + [(None, texts[0])])
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3])]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)


def test_pipeline_keeps_a_corpus_without_labels(spark, documents):
    kept = corpus_pipeline.language(spark, documents(["some words", "日本", "12 ²", "", None], None), "").collect()
    assert [r.text for r in kept] == ["some words", "日本"]
