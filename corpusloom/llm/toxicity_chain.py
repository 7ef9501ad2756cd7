"""Toxicity categories by a classifier chain of linear models.

The chain predicts its categories one after the other: the model of a category sees its words in the
document and the probabilities of all earlier categories. While fitting, those probabilities are
out-of-fold predictions, by models whose words were chosen without the fold too, so a later model
learns from what an earlier one says of documents that it has not seen; equal texts lie in one fold.
All targets are columns of the labels: low quality, then toxic. Word statistics and vectors are
computed by Spark; only the vectors of a bounded sample of labelled rows and the chosen words reach
the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, map_rows, place_of

#: Labelled rows that the chain is fitted on, at most (those with the smallest hash of their id and text).
TRAIN_ROWS = 12_000
#: Words that the model of a category sees, at most.
VOCABULARY = 384
#: Labelled positive documents that a word must be in, and its least log odds.
LEAST_POSITIVES, LEAST_ODDS = 3, 1.0
#: Beside whole words, their beginnings of these lengths are features (marked with ``*``).
STEMS = (5, 6, 7, 8)
FOLDS = 4
RIDGE = 0.05
#: Probability of the last category from which a document counts as toxic.
THRESHOLD = 0.35
#: Categories in the order of the chain: the column of the labels, and which values are positive ones.
CATEGORIES = {"low_quality": ("quality", "= 0"), "toxic": ("toxic", "> 0")}
#: Words, and runs of marks, in which low quality shows.
_WORD = re.compile(r"\w+|[^\w\s]+")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; the last weight is the intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (p - y) + penalty * w
        hess = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass(frozen=True)
class Chain:
    """Words, categories in the order of the chain, the words that each category's model uses, and its weights in their order."""

    words: tuple[str, ...]
    categories: tuple[str, ...]
    uses: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column a category; each model sees its words' columns of ``x`` and the columns before."""
        out = np.zeros((len(x), 0))
        for use, w in zip(self.uses, self.weights, strict=True):
            out = np.hstack([out, sigmoid(np.hstack([x[:, use], out]) @ w[:-1] + w[-1])[:, None]])
        return out


def fit_chain(
    x: np.ndarray, labels: np.ndarray, folds: np.ndarray, words: tuple[str, ...], categories: tuple[str, ...], chosen: list[dict] | None = None
) -> Chain:
    """Fit one model a category; ``labels`` has one column a category (negative: unknown), ``folds`` a fold for each row.

    ``chosen`` gives the columns of each category's words by the fold that they were chosen without, and
    under None those of the final model; without it all columns are used.
    """
    everything = np.arange(x.shape[1])
    seen, uses, weights = np.zeros((len(x), 0)), [], []
    for k in range(labels.shape[1]):
        known, held_out = labels[:, k] >= 0, np.zeros(len(x))
        own = chosen[k] if chosen else {}
        for fold in np.unique(folds):
            at = folds == fold
            inputs = np.hstack([x[:, own.get(int(fold), everything)], seen])
            w = fit_linear(inputs[~at & known], labels[~at & known, k])
            held_out[at] = sigmoid(inputs[at] @ w[:-1] + w[-1])
        uses.append(np.asarray(own.get(None, everything), dtype=np.int64))
        weights.append(fit_linear(np.hstack([x[:, uses[-1]], seen])[known], labels[known, k]))
        seen = np.hstack([seen, held_out[:, None]])
    # the columns that only models of folds use are left out
    kept = np.unique(np.concatenate(uses))
    return Chain(tuple(words[c] for c in kept), categories, tuple(np.searchsorted(kept, u) for u in uses), tuple(weights))


class Index(dict):
    """Features and their numbers; ``heads`` holds how words with a listed beginning start."""

    def __init__(self, words: tuple[str, ...]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.heads = {w[: STEMS[0]] for w in words if w.endswith("*")}


def count_words(text: str | None, index: Index) -> dict[int, int]:
    """How often each feature of the index occurs: whole words, and beginnings of words."""
    out: dict[int, int] = {}
    heads = index.heads
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        if word in index:
            out[index[word]] = out.get(index[word], 0) + n
        if word[: STEMS[0]] in heads:
            for k in STEMS:
                if len(word) >= k and (at := index.get(f"{word[:k]}*")) is not None:
                    out[at] = out.get(at, 0) + n
    return out


def vectors(counts: list[dict[int, int]], width: int) -> np.ndarray:
    out = np.zeros((len(counts), width))
    for row, c in zip(out, counts, strict=True):
        for k, n in c.items():
            row[k] = np.log1p(n)
    return out


def choose_words(labelled: DataFrame, categories: list[str], size: int = VOCABULARY) -> dict[str, dict[int | None, list[str]]]:
    """By category, and by the fold that is left out (None: no fold), the words most over-represented in positive rows.

    ``labelled`` has a text, a fold and one column a category (0, 1 or null, which does not count). Ties
    go by the word; texts that are null or have no words choose none; an empty table gives empty lists.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+|[^\w\s]+)")))

    def stems(k: int):
        return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    def sums() -> list:
        out = []
        for c in categories:
            for f in range(FOLDS):
                inside = F.when(F.col("fold") == f, F.col(c))
                out += [F.coalesce(F.sum(inside), F.lit(0)).alias(f"p_{c}_{f}"), F.count(inside).alias(f"n_{c}_{f}")]
        return out

    features = F.array_distinct(F.concat("words", *map(stems, STEMS)))
    rows = labelled.select("fold", *categories, words.alias("words")).select("fold", *categories, F.explode(features).alias("word"))
    counts = checkpointed(rows.groupBy("word").agg(*sums()).where(" or ".join(f"{' + '.join(f'p_{c}_{f}' for f in range(FOLDS))} >= {LEAST_POSITIVES}" for c in categories)))
    total = labelled.agg(*sums()).first().asDict()
    tops = []
    for k, c in enumerate(categories):
        for left_out in (None, *range(FOLDS)):
            inside = [f for f in range(FOLDS) if f != left_out]
            p, n = (sum((F.col(f"{x}_{c}_{f}") for f in inside), F.lit(0)) for x in "pn")
            positives, known = (sum(total[f"{x}_{c}_{f}"] for f in inside) for x in "pn")
            odds = F.log((p + 0.5) / (positives + 1) / ((n - p + 0.5) / (known - positives + 1)))
            best = counts.where(p >= LEAST_POSITIVES).select(F.lit(k).alias("category"), F.lit(left_out).cast("int").alias("fold"), "word", odds.alias("odds"), (odds * p).alias("score"))
            tops.append(best.where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("score"), "word").limit(size))
    out: dict[str, dict[int | None, list[str]]] = {c: {f: [] for f in (None, *range(FOLDS))} for c in categories}
    for r in reduce(DataFrame.unionByName, tops).orderBy("category", "fold", F.desc("score"), "word").collect():  # at most `size` rows a list
        out[categories[r.category]][r.fold].append(r.word)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5) -> tuple[DataFrame, list[str]]:
    """``fold, text`` and a column of 0, 1 or null for each category, and the categories' names: at most ``train_rows`` distinct labelled rows.

    They are those with the smallest hash of id and text, then the smallest labels.
    """
    known = {name: rule for name, rule in CATEGORIES.items() if rule[0] in labels.columns}
    names = list(known)
    marks = [F.expr(f"CAST(`{column}` {rule} AS INT)").alias(name) for name, (column, rule) in known.items()]
    rows = labels.select(F.col("doc_id").alias("_id"), *marks).where(" or ".join(f"{n} is not null" for n in names)).distinct()
    # hashes are made before the join, so that only the texts of the cut are exchanged
    hashed = docs.where("text is not null").select(
        "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text"
    )
    # the cut is found on the hashes alone, so texts stay where they are
    told = hashed.select("doc_id", "h").distinct().join(rows, F.col("doc_id") == F.col("_id")).select("h", *names)
    place = ["h", *[F.coalesce(n, F.lit(-1)).alias(n) for n in names]]
    last = told.select(*place).orderBy("h", *names).limit(train_rows).agg(F.max(F.struct("h", *names)).alias("l")).first().l
    if last is None:
        return hashed.where("false").join(rows, F.col("doc_id") == F.col("_id")).select("fold", *names, "text"), names
    within = F.struct(*place) <= F.struct(*[F.lit(v).alias(n) for n, v in last.asDict().items()])
    chosen = hashed.where(F.col("h") <= last.h).join(rows, F.col("doc_id") == F.col("_id")).where(within)
    return chosen.dropDuplicates(["doc_id", "h", *names]).select("fold", *names, "text"), names


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5) -> Chain:
    """A chain of the categories that ``labels (doc_id, quality, toxic)`` has, from ``docs (doc_id, text)``.

    It is fitted on the rows of :func:`training_rows`, at most ``train_rows``. Rows without text, id,
    any label or partner are not used; a label that is null is not used for its category; documents
    and labels that repeat count once. Other columns are not read. Without any labelled row, or any
    word, the chain says 0.
    """
    sample, names = training_rows(docs, labels, train_rows, seed)
    sample = checkpointed(sample)
    chosen = choose_words(sample, names)
    words = tuple(sorted({w for lists in chosen.values() for own in lists.values() for w in own}))

    def make():
        index = Index(words)

        def work(fold, text, *labels):
            found = count_words(text, index)
            return ((fold, list(labels), list(found), list(found.values())),)

        return work

    held = map_rows(sample.select("fold", "text", *names), "fold int, labels array<int>, ids array<int>, counts array<int>", make).collect()
    if not held or not words:
        return Chain((), tuple(names), tuple(np.zeros(0, dtype=np.int64) for _ in names), tuple(np.array([0.0] * k + [-30.0]) for k in range(len(names))))
    held.sort(key=lambda r: (r.fold, r.ids, r.counts, str(r.labels)))  # the same sums in whatever order the rows came
    at = {w: k for k, w in enumerate(words)}
    columns = [{f: np.array([at[w] for w in own], dtype=np.int64) for f, own in chosen[c].items()} for c in names]
    x = vectors([dict(zip(r.ids, r.counts, strict=True)) for r in held], len(words))
    targets = np.array([[-1 if v is None else v for v in r.labels] for r in held], dtype=float)
    return fit_chain(x, targets, np.array([r.fold for r in held]), words, tuple(names), columns)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and a double for each category of the chain, from whole texts.

    A null or empty text has no words. Repeated rows and null ids are kept; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most VOCABULARY words
    columns = ", ".join(f"{c} double" for c in chain.categories)

    def make():
        model = sent.value
        index = Index(model.words)
        memo: dict[tuple, tuple] = {}

        def work(key, text):
            counts = count_words(text, index)
            at = tuple(sorted(counts.items()))
            if at not in memo:
                if len(memo) > 10_000:
                    memo.clear()
                memo[at] = tuple(float(p) for p in model.probabilities(vectors([counts], len(index)))[0])
            return ((key, *memo[at]),)

        return work

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, f"doc_id long, {columns}", make)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose last category's probability is below ``threshold``.

    A null or empty text has no words and stays, unless an empty text counts as toxic itself. Repeated
    rows are judged alike; columns of any name are carried; an empty table gives an empty one.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at = place_of(docs, text_col)

    def run(batches):
        model = sent.value
        index = Index(model.words)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts = [count_words(t, index) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.probabilities(vectors(counts, len(index)))[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
