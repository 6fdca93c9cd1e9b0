import random
import re
import zlib

import numpy as np

from finsieve.llm import toxicity as t
from finsieve.llm.queries import op8_toxicity_chain


def made(n, seed):
    draw = random.Random(seed)
    clean = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        words = [draw.choice(clean) for _ in range(draw.randint(3, 60))]
        junk, toxic = draw.random() < 0.3, False
        if junk:
            words += ["spam!!"] * 3
        elif draw.random() < 0.3:
            toxic = True
            words.insert(draw.randrange(len(words)), draw.choice(["Scumwort", "scumbag", "idiot"]))
        texts.append(" ".join(words))
        labels.append((junk, toxic))
    return texts, labels


def chain(texts, labels):
    return t.train([t.features(x) for x in texts], {"junk": np.array([a for a, _ in labels], float), "toxic": np.array([b for _, b in labels], float)})


def test_held_out_rows_and_feeding_forward():
    texts, labels = made(1200, 1)
    fitted = chain(texts[:800], labels[:800])
    got = np.array([t.predict(x, fitted) for x in texts[800:]])
    want = np.array(labels[800:])
    assert ((got > 0.5) == want).mean() > 0.9
    assert fitted.categories == ["junk", "toxic"] and len(fitted.models[0].earlier) == 0
    assert fitted.models[1].earlier[0] < 0  # junk is never toxic here, and the second model was told


def test_prediction_equals_the_fitted_matrix_form():
    texts, labels = made(300, 2)
    sets, y = [t.features(x) for x in texts], np.array([a for a, _ in labels], float)
    model = t.fit(sets, y, np.zeros((300, 0)))
    want = t.applied(sets, model, np.zeros((300, 0)))
    got = [t.predict(x, t.train(sets, {"junk": y}))[0] for x in texts[:5]]
    assert np.allclose(got, want[:5])


def test_training_is_repeatable():
    texts, labels = made(200, 3)
    assert chain(texts, labels) == chain(texts, labels)


def test_one_class_and_no_rows():
    assert 0 <= t.predict("x", t.train([t.features("a b")] * 3, {"toxic": np.zeros(3)}))[0] < 0.5
    assert 0 <= t.predict("x", t.train([], {"toxic": np.zeros(0)}))[0] <= 0.5


def test_odd_rows(spark, docs_of):
    texts, labels = made(400, 4)
    long = "clean words " * 40_000 + " idiot"
    docs = docs_of(texts + [None, "", long, "a"], ids=[*range(400), 400, 401, 402, None])
    table = spark.createDataFrame([(i, int(not a), int(b)) for i, (a, b) in enumerate(labels)] + [(3, None, None), (None, 1, 1), (3, int(not labels[3][0]), int(labels[3][1]))], "doc_id long, quality int, toxic int")
    got = t.toxicity(docs, table)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == [*docs.columns, "low_quality_probability", "toxic_probability", "toxic"] and len(rows) == 404
    assert rows[400]["toxic_probability"] == rows[401]["toxic_probability"] and not rows[400]["toxic"]
    assert rows[402]["toxic"]
    assert t.toxicity(docs.limit(0), table).count() == 0
    assert t.toxicity(docs, table.limit(0)).where("toxic").count() == 0


def test_bound_of_the_sample(spark, docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(t, "train", lambda sets, labels: seen.append(len(sets)) or t.Chain((), 0))
    table = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    t.train_on(docs_of(["x"] * 50), table, t.CATEGORIES, labelled_rows=20)
    assert seen == [20]


def test_repeated_ids_leave_the_sample_whole(spark, docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(t, "train", lambda sets, labels: seen.append((len(sets), sum(labels["low_quality"]))) or t.Chain((), 0))
    table = spark.createDataFrame([(i, int(i == 0), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = docs_of([f"text {i}" for i in range(100)], ids=[0] * 80 + list(range(20)))
    t.train_on(docs, table, t.CATEGORIES, labelled_rows=20)
    assert seen == [(20, 19)]


def test_whole_query(spark):
    """Labelled rows of the table; half of them are in the sample at this size, as the bound is above their number."""
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["toxic"] == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r["toxic"] for r in op8_toxicity_chain(spark, sf).collect()}
    assert len(got) == 1000
    assert np.mean([got[i] for i, y in want.items() if y]) > 0.9 and np.mean([got[i] for i, y in want.items() if not y]) < 0.01


def dense(labels, texts):
    """The procedure once more, over one dense matrix of all features: {category: function of (row of features, earlier)}."""
    def held(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return {zlib.crc32(p.encode()) % t.BUCKETS for w in words for p in [w, *(w[:n] + "-" for n in (4, 5, 6) if n < len(w))]}

    order = sorted(set().union(*map(held, texts)))

    def row(text):
        return np.isin(order, list(held(text))).astype(float)

    matrix = np.array([row(x) for x in texts]).reshape(len(texts), len(order))

    def regression(x, y, earlier):
        there, inside = x.sum(axis=0), y @ x
        expected = there * y.mean()
        tells = np.where(there >= t.LEAST_ROWS, (inside - expected) ** 2 / np.maximum(expected, 1e-9), -1)
        best = [i for i in np.argsort(-tells, kind="stable")[: t.FEATURES] if tells[i] >= 0]
        whole = np.hstack([x[:, best], np.ones((len(x), 1)), earlier])
        decay = np.r_[np.full(len(best), t.DECAY / np.sqrt(len(x))), np.zeros(1 + earlier.shape[1])]
        w, m, v = np.zeros(whole.shape[1]), np.zeros(whole.shape[1]), np.zeros(whole.shape[1])
        w[len(best)] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        for step in range(1, t.STEPS + 1):
            slope = whole.T @ (1 / (1 + np.exp(-np.clip(whole @ w, -30, 30))) - y) / len(x) + decay * w
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return lambda rows, e: 1 / (1 + np.exp(-np.clip(np.hstack([rows[:, best], np.ones((len(rows), 1)), e]) @ w, -30, 30)))

    earlier, models = np.zeros((len(texts), 0)), []
    for y in labels:
        models.append(regression(matrix, y, earlier))
        outside = np.zeros(len(texts))
        for f in range(t.FOLDS):
            out = np.arange(len(texts)) % t.FOLDS == f
            outside[out] = regression(matrix[~out], y[~out], earlier[~out])(matrix[out], earlier[out])
        earlier = np.column_stack([earlier, outside])

    def predicted(text):
        known = np.zeros((1, 0))
        for model in models:
            known = np.column_stack([known, model(row(text)[None, :], known)])
        return known[0]

    return predicted


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = sorted((r["doc_id"], r["quality"] == 0, r["toxic"] == 1) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect())
    assert len(known) <= t.LABELLED_ROWS and len({k[0] for k in known}) == len(known)
    predicted = dense([np.array([float(k[i]) for k in known]) for i in (1, 2)], [docs[k[0]] for k in known])
    got = {r["doc_id"]: r for r in op8_toxicity_chain(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        want = predicted(text)
        assert np.allclose([got[i]["low_quality_probability"], got[i]["toxic_probability"]], want, atol=1e-6)
        assert got[i]["toxic"] == (want[1] >= t.THRESHOLD)


def test_stage_keeps_columns_of_any_name(spark, docs_of):
    texts, labels = made(200, 5)
    table = spark.createDataFrame([(i, int(not a), int(b)) for i, (a, b) in enumerate(labels)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts).withColumnsRenamed({"fp": "toxic", "row": "toxic_probability", "digest": "a.b", "shard": "low_quality_probability"})
    kept = t.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.where("toxic = 'x' and toxic_probability = 1").count() == kept.count()
    judged = {r["doc_id"] for r in t.toxicity(docs_of(texts), table).where("not toxic").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged and len(judged) < 200
    assert t.drop_toxic(docs.limit(0), table).count() == 0
