import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import quality

WORDS = "the of and a house river garden walks slowly under bright morning light".split()


def sample(n, seed):
    """(text, label): prose, and the same words with marks behind them."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        words = rng.choice(WORDS, rng.integers(3, 200))
        out.append((" ".join(w + "###" if i % 4 == 0 else w for w in words), int(i % 4 != 0)))
    return out


@pytest.fixture(scope="module")
def weights():
    texts = sample(160, 1)
    return quality.learn([quality.drawn_chunks(t.encode()) for t, _ in texts], np.array([y for _, y in texts]), steps=80)


def slow_score(text, w):
    """A byte at a time, chunk by chunk."""
    blocks = -(-(len(text) + quality.WIDTH - 1) // quality.BLOCK)
    letters = text.ljust(blocks * quality.BLOCK, b"\0")
    responses = []
    for i in range(len(letters) - quality.WIDTH + 1):
        seen = w["embed"][list(letters[i : i + quality.WIDTH])].ravel()
        responses.append(np.maximum(seen @ w["filters"] + w["offset"], 0))
    responses += [np.zeros(quality.FILTERS)] * (quality.WIDTH - 1)
    pools = np.array(responses).reshape(blocks, quality.BLOCK, -1).max(1)
    chunks = [np.maximum(pools[j], pools[j + 1]) for j in range(blocks - 1)] or [pools[0]]
    features = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    value = np.tanh(features @ w["dense"] + w["dense_offset"]) @ w["out"] + w["out_offset"][0]
    return 1 / (1 + np.exp(-value))


def test_score_of_whole_texts(weights, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"x" * 121, b"y" * 122, b"z" * 128, *(rng.bytes(n) for n in (129, 700, 5000))]
    want = [slow_score(t, weights) for t in texts]
    assert quality.predict(texts, weights) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(quality, "AT_ONCE", 1)
    monkeypatch.setattr(quality, "SLAB", 3)
    assert quality.predict(texts, weights) == pytest.approx(want, abs=1e-5)
    # What lies at the far end of a long text counts.
    long = (" ".join(WORDS) * 3000).encode()
    ends = quality.predict([long, long + b"###" * 4000], weights)
    assert ends[0] > 0.9 and ends[1] < ends[0]


def test_gradients(weights):
    rng = np.random.default_rng(5)
    chunks = np.stack([rng.integers(97, 123, 2 * quality.BLOCK).astype(np.uint8) for _ in range(5)])
    owner, label = np.array([0, 0, 1, 1, 1]), np.array([0.0, 1.0])
    exact = {k: v.astype(np.float64) for k, v in quality.start(4).items()}
    grad, _ = quality.gradients(chunks, owner, label, exact)
    for name in exact:
        at = tuple(np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape))
        losses = []
        for move in (1e-3, -1e-3):
            moved = {k: v.copy() for k, v in exact.items()}
            moved[name][at] += move
            losses.append(quality.gradients(chunks, owner, label, moved)[1])
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[name][at], rel=0.05)


def test_fit_and_score(spark, documents):
    texts = sample(400, 2)
    docs = documents([(i, t) for i, (t, _) in enumerate(texts)] + [(None, "no id"), (900, None), (901, "")])
    marks = [(i, y) for i, (_, y) in enumerate(texts) if i % 5] + [(None, 1), (1, None), (2, 7), (5000, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    model = quality.fit(docs, labels)
    assert model.rows == 320
    clashing = docs.selectExpr("*", "'a' AS score", "5 AS predicted", "7 AS _text")
    got = quality.score(clashing, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r._text == 7 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == texts[r.doc_id][1] for r in held]) >= 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901]
    # The same weights however the rows lie.
    again = quality.fit(docs.repartition(7), labels.repartition(3))
    assert all((again.weights[k] == w).all() for k, w in model.weights.items())


def test_bounds_hold_for_repeated_ids(spark, documents):
    docs = documents([(1, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "doc_id long, label int")
    assert quality.fit(docs, labels, rows=20).rows == 20
    assert len(quality.drawn_chunks(b"x" * 10_000_000)) == quality.DRAWN_CHUNKS


def test_little_to_learn_from(spark, documents):
    docs = documents(["a", "b"])
    none = spark.createDataFrame([], "doc_id long, label int")
    blank = quality.fit(docs, none)
    assert blank.rows == 0 and quality.score(docs, blank).select("score").distinct().count() == 1
    one = quality.fit(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, label int"))
    assert quality.score(docs, one).where(F.col("predicted") == 1).count() == 2
    assert quality.score(documents([]), one).count() == 0
