"""Score normalisation, fusion, and hybrid search over all pairs of queries and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from . import bm25

# Weights of dense, sparse and keyword scores.
WEIGHTS = {"ExactPhrase": (0.3, 0.5, 0.2), "Conceptual": (0.5, 0.3, 0.2), "Mixed": (0.4, 0.4, 0.2)}
#: Share of the cosine by domain of the query; the rest is BM25.
COSINE_SHARE = {"Business": 0.4, "Academic": 0.55, "Legal": 0.35, "Technical": 0.5, "General": 0.5}
LINE_WEIGHTS = {"Title": 1.0, "HeaderH1": 1.0, "Body": 0.7, "TableCell": 0.6, "Disclaimer": 0.25, "ForwardLooking": 0.25}
DISCLAIMERS = (
    "disclaimer", "forward-looking", "avertissement", "mise en garde", "risk factors", "facteurs de risque", "legal notice", "mention légale",
    "governance", "gouvernance d'entreprise", "regulatory", "réglementaire", "safe harbor", "protection", "limitation of liability",
    "limitation de responsabilité",
)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Between a query's least and greatest score; a range below 1e-6 counts as 1e-6."""
    return (score - low) / F.greatest(high - low, F.lit(1e-6))


def z_logistic(score: Column, mean: Column, deviation: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(score - mean) / F.greatest(deviation, F.lit(1e-6))))


def score_ranges(scores: DataFrame, names: list[str], rows: int, by: str = "query_id") -> DataFrame:
    """``by`` and ``low_, high_, mean_, deviation_`` and the name of each score, over ``rows`` candidates of each query.

    Pairs that ``scores`` lacks, and scores that are null, are 0. All is partly aggregated before the one
    exchange, so no query's candidates meet in one task.
    """
    out = []
    for n in names:
        # the population's deviation from the sums over the pairs that are there
        total, squares = F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0.0))
        absent = F.count(n) < rows
        low, high = F.coalesce(F.min(n), F.lit(0.0)), F.coalesce(F.max(n), F.lit(0.0))
        spread = F.greatest(squares / rows - F.pow(total / rows, F.lit(2)), F.lit(0.0))
        out += [
            F.when(absent, F.least(low, F.lit(0.0))).otherwise(low).alias(f"low_{n}"), F.when(absent, F.greatest(high, F.lit(0.0))).otherwise(high).alias(f"high_{n}"),
            (total / rows).alias(f"mean_{n}"), F.sqrt(spread).alias(f"deviation_{n}"),
        ]
    return scores.groupBy(by).agg(*out)


def fuse(dense: Column, sparse: Column, keyword: Column, intent: Column | None = None) -> Column:
    """Weighted sum; without an intent the weights of Mixed."""

    def weighted(w: tuple[float, float, float]) -> Column:
        return w[0] * dense + w[1] * sparse + w[2] * keyword

    out = weighted(WEIGHTS["Mixed"])
    if intent is not None:
        for name in ("Conceptual", "ExactPhrase"):
            out = F.when(intent == name, weighted(WEIGHTS[name])).otherwise(out)
    return out


def linear_hybrid(sparse: Column, cosine: Column, weight: float) -> Column:
    return weight * sparse + (1.0 - weight) * cosine


def domain_hybrid(intent: Column, sparse: Column, cosine: Column) -> Column:
    share = F.lit(0.5)
    for name, s in COSINE_SHARE.items():
        share = F.when(intent == name, s).otherwise(share)
    return share * cosine + (1.0 - share) * sparse


# Limits of a score, and what is added to it, by the query's domain and the chunk's category.
CAPS = {
    ("Legal", "Business"): 0.75, ("Legal", "Academic"): 0.75, ("Business", "Academic"): 0.85, ("Business", "Mixed"): 0.85, ("Academic", "Business"): 0.80, ("Academic", "Mixed"): 0.80,
}
ALIGNED = {("Business", "Business"): 0.25, ("Academic", "Academic"): 0.20, ("Legal", "Mixed"): 0.15, ("Technical", "Academic"): 0.12}
LEGAL_HITS, LEGAL_BOOST, NOT_LEGAL = 2, 0.15, -0.10


def _by_pair(table: dict[tuple[str, str], float], intent: Column, category: Column, other: Column) -> Column:
    for (i, c), value in table.items():
        other = F.when((intent == i) & (category == c), value).otherwise(other)
    return other


def type_aware_cap(intent: Column, category: Column, score: Column) -> Column:
    return F.least(score, _by_pair(CAPS, intent, category, F.lit(float("inf"))))


def boosted(score: Column, intent: Column, category: Column, legal_hits: Column) -> Column:
    aligned = _by_pair(ALIGNED, intent, category, F.lit(0.0))
    legal = F.when(legal_hits >= LEGAL_HITS, LEGAL_BOOST).when(category != "Mixed", NOT_LEGAL).otherwise(0.0)
    return F.greatest(type_aware_cap(intent, category, score + aligned + F.when(intent == "Legal", legal).otherwise(0.0)), F.lit(0.0))


def intelligent_boost(score: Column, intent: Column, category: Column, content: Column) -> Column:
    return boosted(score, intent, category, classify.strong_legal_hits(content))


def line_section(line: Column) -> Column:
    """Title, HeaderH1, Body, TableCell, Disclaimer or ForwardLooking for a trimmed line."""
    low = F.lower(line)
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / F.greatest(F.octet_length(line), F.lit(1))
    heading = F.lit(False)
    for start in ("chapter", "section", "chapitre", "partie"):
        heading = heading | F.startswith(low, F.lit(start))
    table = F.contains(line, F.lit("\t")) | (text.count_of(line, "|") > 2) | (text.count_of(line, "  ") > 5)
    return (
        F.when(text.any_of(low, DISCLAIMERS), "Disclaimer")
        .when(text.any_of(low, ("forward", "outlook", "projection", "estimate")), "ForwardLooking")
        .when((F.octet_length(line) < 100) & (capitals > 0.5), "Title")
        .when(heading, "HeaderH1")
        .when(table, "TableCell")
        .otherwise("Body")
    )


def fielded_bm25(query: Column, content: Column) -> Column:
    """Each non-blank line's BM25 with the weight of its kind; a blank text is one body line."""
    lines = F.filter(F.transform(F.split(content, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.when(F.size(lines) == 0, F.array(content)).otherwise(lines)

    def weight(line: Column) -> Column:
        out = F.lit(0.7)
        for name, w in LINE_WEIGHTS.items():
            out = F.when(line_section(line) == name, w).otherwise(out)
        return out

    return F.aggregate(lines, F.lit(0.0), lambda a, line: a + weight(line) * bm25.plain_bm25(query, line))


NAMES = ["dense", "sparse", "keyword"]


def hybrid_scores(pairs: DataFrame, ranges: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Adds ``hybrid``: each score min-max normalised over the query's chunks, then fused with fixed weights.

    ``ranges`` are :func:`score_ranges` of the pairs; ``intents (query_id, intent)`` choose the weights by
    the query's intent. Both have one row a query.
    """
    known = ranges if intents is None else ranges.join(intents, "query_id", "left")
    joined = pairs.join(known.withColumnRenamed("query_id", "_q"), F.col("query_id") == F.col("_q"))
    scaled = [min_max(F.col(n), F.col(f"low_{n}"), F.col(f"high_{n}")) for n in NAMES]
    return joined.select(*pairs.columns, fuse(*scaled, F.col("intent") if intents is not None else None).alias("hybrid"))


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc_id", first: str | None = None) -> DataFrame:
    """The best rows of each query with ``rank``; ties by id; ``first`` is an optional column that goes before the score.

    Scores are ordered by nine decimals, so that copies of a text tie in whatever order their parts were summed.
    """
    order = Window.partitionBy(by).orderBy(*([F.desc(first)] if first else []), F.round(score, 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
