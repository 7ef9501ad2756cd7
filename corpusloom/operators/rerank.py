"""Rerankers: bibliography penalty, section prior, numbers, kind of question, diversity, near-duplicate collapse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.text import any_of, count_of, hits, matches, word_count, words

# Word lists.
BIBLIOGRAPHY = ("et al.", "arxiv", "preprint", "doi:", "http://", "https://")
NUMBERED = ("[1]", "[2]", "[3]", "[4]", "[5]")
VISUAL = ("library", "room", "furniture", "shelves", "dedicated to books")
MODEL_NAMES = ("qwen", "olmocr", "internvl", "mineru")
GOAL_QUERY = ("objectif", "but", "goal", "aim", "purpose", "objective")
METHOD_QUERY = ("méthode", "approche", "comment", "how", "method", "approach")
RESULT_QUERY = ("résultat", "performance", "result", "accuracy", "score")
GOAL_MARKERS = (
    "objective", "goal", "aim", "purpose", "propose", "objectif", "but", "vise", "visons", "we propose", "our goal", "this paper", "we aim",
    "explore a potential solution", "leveraging", "enables", "context", "long", "longer", "token", "limitation", "window", "longer contexts",
    "context length", "token reduction", "thousands of tokens", "hundreds of tokens", "context window", "enable", "permet", "permettre",
    "gérer", "manage",
)
BENCHMARK_NOISE = (
    "qwen", "olmocr", "ocrflux", "internvl", "mineru", "llama", "gpt-4", "claude", "gemini", "omnidocbench", "docvqa", "benchmark",
)
TECHNICAL_DETAILS = (
    "sam", "clip", "vitdet", "patch embedding", "layer", "components", "pipeline", "encoder", "decoder", "architecture", "attention",
    "embedding layer", "we remove", "we use", "we employ", "based on",
)
METHOD_MARKERS = ("method", "approach", "architecture", "pipeline", "méthode", "approche", "architecture", "we use", "we employ", "using", "based on")
RESULT_MARKERS = (
    "result", "performance", "accuracy", "score", "résultat", "performance", "précision", "table", "benchmark", "achieves", "outperforms",
)


def is_bibliography(content: Column) -> Column:
    low, commas, n = F.lower(content), count_of(content, ","), word_count(content)
    listed = hits(low, BIBLIOGRAPHY + NUMBERED) >= 2
    return listed | (matches(content, r"[A-Z]\.\s+[A-Z]") >= 3) | ((n > 20) & (commas > F.floor(n / 4)))


def bibliography_penalty(score: Column, content: Column) -> Column:
    return F.when(is_bibliography(content), score * 0.1).otherwise(score)


def is_contaminated(content: Column, source: Column) -> Column:
    low = F.lower(content)
    caption = F.contains(source, F.lit("Figure Caption")) | F.contains(source, F.lit("Table Caption"))
    return (hits(low, BIBLIOGRAPHY) >= 3) | (hits(low, VISUAL) >= 2) | (caption & (F.octet_length(content) < 100))


def section_prior(content: Column, source: Column) -> Column:
    """The first rule that holds."""
    low = F.lower(content)
    return (
        F.when(F.startswith(low, F.lit("abstract")) | F.contains(low, F.lit("in this paper we")), 0.15)
        .when(F.contains(low, F.lit("introduction")) & F.contains(low, F.lit("we propose")), 0.12)
        .when(any_of(low, ["conclusion", "in summary"]), 0.10)
        .when(F.contains(source, F.lit("Table")) & F.contains(low, F.lit("benchmark")), -0.15)
        .when(any_of(low, ["experiments", "evaluation"]), -0.10)
        .when(F.contains(source, F.lit("Figure Caption")), -0.05)
        .when(hits(low, MODEL_NAMES) >= 2, -0.20)
        .otherwise(0.0)
    )


def section_rerank(ranked: DataFrame, score: str = "score", content: str = "content", source: str = "source_type") -> DataFrame:
    """Drops contaminated rows and adds the prior to the score, between 0 and 1."""
    kept = ranked.where(~is_contaminated(F.col(content), F.col(source)))
    return kept.withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) + section_prior(F.col(content), F.col(source)))))


def numeric_rerank(ranked: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    """Adds ``query_kind`` and ``has_match``; scores and order stay."""
    kind = numeric.query_kind(F.col(query))
    wanted = numeric.constraints(F.col(query))
    digit = kind.isin("DigitAtomic", "DigitCombined")
    return ranked.withColumns({"query_kind": kind, "has_match": digit & F.coalesce(numeric.has_match(F.col(content), wanted), F.lit(False))})


def question_type(query: Column) -> Column:
    low = F.lower(query)
    return F.when(any_of(low, GOAL_QUERY), "Goal").when(any_of(low, METHOD_QUERY), "Method").when(any_of(low, RESULT_QUERY), "Result").otherwise("General")


def semantic_score(query: Column, content: Column) -> Column:
    """How the content answers the kind of question, between 0 and 1."""
    low = F.lower(content)

    def has(*pieces: str) -> Column:
        return any_of(low, pieces)

    def part(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    goal = (
        0.2 * hits(low, GOAL_MARKERS)
        + part(has("table") & (count_of(low, ",") > 5), -0.5)
        + part(has("library", "room", "furniture"), -0.5)
        + part(hits(low, BENCHMARK_NOISE) >= 2, -0.7)
        + part(has("figure caption"), -0.4)
        + part(hits(low, TECHNICAL_DETAILS) >= 3, -0.6)
        + part(F.startswith(low, F.lit("abstract")) | has("in this paper", "in this work"), 0.5)
        + part(has("our goal", "we propose to", "this paper proposes"), 0.4)
    )
    method = 0.2 * hits(low, METHOD_MARKERS) + part(has("figure") & has("architecture"), 0.3)
    result = 0.15 * hits(low, RESULT_MARKERS) + part(matches(low, r"\p{N}") > 3, 0.2)
    tokens = F.array_distinct(F.filter(words(F.lower(query)), lambda w: F.octet_length(w) > 3))
    general = F.when(F.size(tokens) == 0, 0.5).otherwise(F.size(F.filter(tokens, lambda w: F.contains(low, w))) / F.size(tokens))
    kind = question_type(query)
    score = F.when(kind == "Goal", goal).when(kind == "Method", method).when(kind == "Result", result).otherwise(general)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6)))


def query_aware_score(score: Column, query: Column, content: Column, original: float = 0.7) -> Column:
    return original * score + (1.0 - original) * semantic_score(query, content)


def mmr(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """``query_id, doc_id, place``: maximal marginal relevance among the candidates of each query.

    ``candidates (query_id, doc_id, score, embedding, query_embedding)`` are a query's pool, a bounded
    top list. The first is the best score (the last of equals by id); then the largest
    ``balance * cos(query) + (1 - balance) * (1 - max cos(chosen))``, the first of equals.
    """
    share = min(max(balance, 0.0), 1.0)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        x = np.stack([np.asarray(e, dtype=float) for e in pdf.embedding])
        q = np.asarray(pdf.query_embedding.iloc[0], dtype=float)
        unit = x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]
        relevance = unit @ (q / (np.linalg.norm(q) or 1.0))
        score = pdf.score.to_numpy(dtype=float)
        chosen = [len(score) - 1 - int(np.argmax(score[::-1]))]
        nearest = unit @ unit[chosen[0]]
        while len(chosen) < min(k, len(pdf)):
            # rounded, so that arithmetic ties are ties
            value = np.round(share * relevance + (1 - share) * (1 - np.maximum(nearest, 0.0)), 9)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "doc_id": pdf.doc_id.iloc[chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1)})

    return candidates.select("query_id", "doc_id", "score", "embedding", "query_embedding").groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, place int")


def collapse_near_duplicates(ranked: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``query_id, doc_id, score, place``: results in rank order; one like an earlier kept one (word sets) replaces it if it scores more.

    ``ranked (query_id, doc_id, score, rank, content)`` is a bounded top list for each query.
    """

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[set, int, float]] = []
        # rounded, so that copies of a text are ties
        for row in pdf.assign(score=pdf.score.round(9)).sort_values("rank").itertuples():
            own = set((row.content or "").lower().split())
            for at, (other, _, score) in enumerate(kept):
                union = len(own | other)
                if union and len(own & other) / union >= threshold:
                    if row.score > score:
                        kept[at] = (own, row.doc_id, row.score)
                    break
            else:
                kept.append((own, row.doc_id, row.score))
        kept.sort(key=lambda x: -x[2])
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "doc_id": [k[1] for k in kept], "score": [k[2] for k in kept], "place": range(1, len(kept) + 1)})

    return ranked.select("query_id", "doc_id", "score", "rank", "content").groupBy("query_id").applyInPandas(collapse, "query_id long, doc_id long, score double, place int")
