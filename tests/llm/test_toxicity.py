import random

import numpy as np
from corpusloom.llm import queries
from corpusloom.llm import toxicity_chain as tc


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "awful!", "stinkerone", "stinkertwo", "stinkerthree"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_linear_model_is_at_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (rng.uniform(size=300) < tc.sigmoid(x @ np.array([2.0, -1, 0, 0.5]) - 0.3)).astype(float)
    w = tc.fit_linear(x, y, steps=60)
    p = tc.sigmoid(np.hstack([x, np.ones((300, 1))]) @ w)
    gradient = np.hstack([x, np.ones((300, 1))]).T @ (p - y) + np.array([tc.RIDGE] * 4 + [1e-6]) * w
    assert np.abs(gradient).max() < 1e-3


def test_chain_is_fitted_out_of_fold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    first = (x[:, 0] > 0).astype(float)
    second = ((first > 0) & (x[:, 1] > 0)).astype(float)
    folds = rng.integers(0, 4, 600)
    chain = tc.fit_chain(x, np.stack([first, second], axis=1), folds, ("a", "b", "c"), ("one", "two"))
    assert len(chain.weights[0]) == 4 and len(chain.weights[1]) == 5  # the second sees the first's probability
    # brute force: the first model without each fold says what the second one sees
    told = np.zeros(600)
    for f in range(4):
        at = folds == f
        w = tc.fit_linear(x[~at], first[~at])
        told[at] = tc.sigmoid(x[at] @ w[:-1] + w[-1])
    assert np.allclose(chain.weights[1], tc.fit_linear(np.hstack([x, told[:, None]]), second)) and np.allclose(chain.weights[0], tc.fit_linear(x, first))
    p = chain.probabilities(x)
    assert ((p > 0.5) == np.stack([first, second], axis=1)).mean() > 0.95
    assert chain.weights[1][3] > 0


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    split = 280
    chain = tc.fit(spark.createDataFrame(docs[:split], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = tc.predict(spark.createDataFrame(docs[split:], "doc_id long, text string"), chain).collect()
    right = [(r.toxic >= tc.THRESHOLD) == bool(labels[r.doc_id][1]) for r in rows]
    assert len(rows) == 120 and np.mean(right) >= 0.95
    assert "stink*" in chain.words


def test_bound_on_the_sample(spark):
    docs, labels = corpus()
    chain = tc.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=100)
    assert len(chain.words) > 0
    # a labelled row that repeats forty times in each table is one row
    many = [docs[0]] * 40 + docs[1:]
    table, told = spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame([labels[0]] * 40 + labels[1:], "doc_id long, toxic int")
    for bound in (1, 100, 10_000):
        rows, names = tc.training_rows(table, told, train_rows=bound)
        assert names == ["toxic"] and rows.count() == min(bound, len(docs))
    # of a document with several labels the smallest come first
    told = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (1, None, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert [tc.training_rows(one, told, train_rows=n)[0].count() for n in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 4]


def test_awkward_rows(spark, awkward, empty):
    docs, labels = corpus(100)
    chain = tc.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), (999, 1)], "doc_id long, toxic int"))
    rows = tc.predict(awkward, chain).collect()
    assert len(rows) == 11 and all(0 <= r.toxic <= 1 for r in rows)
    kept = tc.keep_clean(awkward, chain)
    assert kept.columns == awkward.columns and kept.count() == 11
    bad = spark.createDataFrame([(1, "vile nasty vile stinkerone"), (2, None)], "doc_id long, text string")
    assert [r.doc_id for r in tc.keep_clean(bad, chain).collect()] == [2]
    nothing = tc.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert tc.keep_clean(awkward, nothing).count() == 11 and tc.predict(empty, nothing).count() == 0


def brute_words(rows, category, left_out):
    """The words of :func:`tc.choose_words` by counting."""
    inside = [r for r in rows if r["fold"] != left_out and r[category] is not None]
    positives = sum(r[category] for r in inside)
    seen = {}
    for r in inside:
        words = set(tc._WORD.findall(r["text"].lower()))
        for f in words | {f"{w[:k]}*" for w in words for k in tc.STEMS if len(w) >= k}:
            p, n = seen.get(f, (0, 0))
            seen[f] = (p + r[category], n + 1)
    scored = []
    for f, (p, n) in seen.items():
        odds = np.log((p + 0.5) / (positives + 1) / ((n - p + 0.5) / (len(inside) - positives + 1)))
        if p >= tc.LEAST_POSITIVES and odds >= tc.LEAST_ODDS:
            scored.append((-round(odds * p, 9), f))
    return [f for _, f in sorted(scored)]


def test_words_are_chosen_without_the_fold(spark):
    docs, labels = corpus(120)
    rows = [{"text": t, "fold": i % tc.FOLDS, "toxic": y, "low_quality": None if i % 7 == 0 else int(i % 3 == 0)} for (i, t), (_, y) in zip(docs, labels, strict=True)]
    df = spark.createDataFrame([(r["text"], r["fold"], r["low_quality"], r["toxic"]) for r in rows], "text string, fold int, low_quality int, toxic int")
    got = tc.choose_words(df, ["low_quality", "toxic"], 1000)
    for c in ("low_quality", "toxic"):
        for f in (None, *range(tc.FOLDS)):
            assert sorted(got[c][f]) == sorted(brute_words(rows, c, f))
    assert "nasty" in got["toxic"][None]


def test_query_on_held_out_documents(spark, small, tmp_path):
    """The registered query, fitted on two thirds of the labels, judged on the others."""
    small = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    chain = tc.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert chain.categories == ("low_quality", "toxic")
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    said = {r.doc_id: r.toxic >= tc.THRESHOLD for r in tc.predict(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id"), chain).collect()}
    right = [said[d] for d, t in toxic.items() if t]
    assert np.mean(right) >= 0.6 and not any(said[d] for d, t in toxic.items() if not t)
    rows = queries.op5_toxicity(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    whole = tc.fit(docs, labels)
    told = {r.doc_id: r for r in tc.predict(docs, whole).collect()}
    assert all(abs(r.p_toxic - told[r.doc_id].toxic) < 1e-5 and r.toxic == int(told[r.doc_id].toxic >= tc.THRESHOLD) for r in rows)


def test_query_against_a_plain_chain(spark, small):
    """The registered query on whole tables: folds, words, out-of-fold probabilities and weights by a chain written out plainly."""
    import xxhash
    from corpusloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    told = {r.doc_id: {"low_quality": int(r.quality == 0), "toxic": int(r.toxic > 0)} for r in spark.read.parquet(f"{small}/labels.parquet").collect()}

    def fold_of(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return (h - 2**64 if h >= 2**63 else h) % tc.FOLDS

    rows = [{"text": texts[d], "fold": fold_of(texts[d]), **told[d]} for d in sorted(told) if texts.get(d) is not None]
    assert len(rows) <= tc.TRAIN_ROWS

    def features(text, words):
        found = tc._WORD.findall((text or "").lower())
        return [np.log1p(sum(w == f if not f.endswith("*") else len(w) >= len(f) - 1 and w.startswith(f[:-1]) for w in found)) for f in words]

    def model(x, y):
        """Zero of the gradient of the penalised likelihood, by Newton steps that are halved until the loss falls."""
        x = np.column_stack([np.array(x, dtype=float).reshape(len(y), -1), np.ones(len(y))])
        y, ridge, w = np.array(y, dtype=float), np.append(np.full(x.shape[1] - 1, tc.RIDGE), 1e-6), np.zeros(x.shape[1])
        loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + (ridge * v * v).sum() / 2
        for _ in range(500):
            p = 1 / (1 + np.exp(-x @ w))
            step, size = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w), 1.0
            while loss(w - size * step) > loss(w) and size > 1e-9:
                size /= 2
            w = w - size * step
            if np.abs(step).max() < 1e-9:
                break
        return lambda v: 1 / (1 + np.exp(-(np.array(v) @ w[:-1] + w[-1])))

    final, earlier = [], [[] for _ in rows]
    for category in ("low_quality", "toxic"):
        held_out = [0.0] * len(rows)
        for fold in range(tc.FOLDS):
            words = brute_words(rows, category, fold)[: tc.VOCABULARY]
            inside = [i for i, r in enumerate(rows) if r["fold"] != fold]
            own = model([features(rows[i]["text"], words) + earlier[i] for i in inside], [rows[i][category] for i in inside])
            for i, r in enumerate(rows):
                if r["fold"] == fold:
                    held_out[i] = float(own(features(r["text"], words) + earlier[i]))
        words = brute_words(rows, category, None)[: tc.VOCABULARY]
        final.append((words, model([features(r["text"], words) + e for r, e in zip(rows, earlier, strict=True)], [r[category] for r in rows])))
        earlier = [e + [p] for e, p in zip(earlier, held_out, strict=True)]
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, small).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        first = float(final[0][1](features(text, final[0][0])))
        second = float(final[1][1](features(text, final[1][0]) + [first]))
        assert abs(got[d].p_low_quality - first) < 1e-4 and abs(got[d].p_toxic - second) < 1e-4
        assert got[d].toxic == (second >= tc.THRESHOLD) or abs(second - tc.THRESHOLD) < 1e-4
