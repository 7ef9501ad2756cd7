"""Answers and contexts made of ranked chunks, as expressions over each query's bounded list of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, condense, key_sentences

# Words that tell questions apart, headings and sentences of answers.
SUMMARY = ("résume", "résumé", "synthèse", "overview")
EXPLANATION = ("explique", "comment", "pourquoi", "qu'est-ce")
LISTING = ("quels", "quelles", "liste", "énumère")
HEADINGS = {
    "summary": "**Résumé du document :**\n\n", "explanation": "**Explication :**\n\n", "list": "**Éléments identifiés :**\n\n",
    "general": "**Réponse basée sur le document :**\n\n",
}
MORE_CONTEXT, MORE_DETAILS = "**Informations complémentaires :**\n\n", "**Détails supplémentaires :**\n\n"
TOO_WEAK = "Les informations trouvées ne semblent pas suffisamment pertinentes pour répondre à votre question."
LEAST_SCORE, MOST_CHUNKS = 0.3, 5


def question_form(query: Column) -> Column:
    """summary, explanation, list or general."""
    low = F.lower(query)
    return F.when(any_of(low, SUMMARY), "summary").when(any_of(low, EXPLANATION), "explanation").when(any_of(low, LISTING), "list").otherwise("general")


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n\n"))), "")


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), x, F.lit("\n\n"))), "")


def _condensed(items: Column, limit: int) -> Column:
    return F.transform(items, lambda x: condense(x["content"], limit))


def answer_text(form: Column, hits: Column) -> Column:
    """The answer from ``array<struct<rank, score, content>>`` in order of rank, by the form of the question."""
    good = F.filter(hits, lambda h: h["score"] > LEAST_SCORE)
    first, rest = F.slice(good, 1, 1), F.slice(good, 2, MOST_CHUNKS)
    points = key_sentences(F.array_join(F.transform(good, lambda h: h["content"]), " "), 4)
    summary = F.when(F.size(points) > 0, _numbered(points)).otherwise(_bullets(_condensed(F.slice(good, 1, 3), 200)))

    def lead(limit: int) -> Column:
        return F.concat(F.array_join(_condensed(first, limit), ""), F.lit("\n\n"))

    def more(heading: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(heading), _bullets(_condensed(items, 200)))).otherwise("")

    close = F.slice(F.filter(rest, lambda h: h["score"] > 0.5), 1, 2)
    body = (
        F.when(form == "summary", summary)
        .when(form == "explanation", F.concat(lead(400), more(MORE_CONTEXT, F.slice(rest, 1, 2))))
        .when(form == "list", _numbered(_condensed(good, 250)))
        .otherwise(F.concat(lead(350), more(MORE_DETAILS, close)))
    )
    heading = F.lit(HEADINGS["general"])
    for name in ("summary", "explanation", "list"):
        heading = F.when(form == name, HEADINGS[name]).otherwise(heading)
    mean = F.aggregate(good, F.lit(0.0), lambda a, h: a + h["score"]) / F.size(good)
    level = F.when(mean > 0.7, "haute").when(mean > 0.5, "moyenne").otherwise("modérée")
    footer = F.format_string("\n*Réponse générée à partir de %d sections du document (confiance: %s)*", F.size(good), level)
    return F.when(F.size(good) == 0, TOO_WEAK).otherwise(F.concat(heading, body, footer))


def extractive_answer(ranked: DataFrame) -> DataFrame:
    """``query_id, form, answer, sources`` from ``query_id, query, rank, score, content``: of the best five chunks those over 0.3."""
    hit = F.struct("rank", "score", F.coalesce("content", F.lit("")).alias("content"))
    held = ranked.where(F.col("rank") <= MOST_CHUNKS).groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.first("query").alias("query"))  # at most five rows
    asked = held.select("query_id", "hits", question_form(F.col("query")).alias("form"))
    return asked.select("query_id", "form", answer_text(F.col("form"), F.col("hits")).alias("answer"), F.size(F.filter("hits", lambda h: h["score"] > LEAST_SCORE)).alias("sources"))


def knowledge_context(ranked: DataFrame, instructions: str = "") -> DataFrame:
    """``query_id, context, previews`` from ``query_id, query, rank, score, source_file, category, content``.

    The context lists each hit with its score in percent, its file if known, its category and its
    fenced content, and ends with the instructions; previews have 300 characters.
    """
    head = F.format_string("### [Source %d] Score: %.2f%%\n", F.col("rank"), F.col("score") * 100.0)
    file = F.coalesce(F.concat(F.lit("Fichier: "), F.col("source_file"), F.lit("\n")), F.lit(""))
    block = F.concat(head, file, F.lit("Catégorie: "), F.col("category"), F.lit("\n\nContenu:\n```\n"), F.col("content"), F.lit("\n```\n\n"))
    preview = F.when(F.octet_length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content"))
    held = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), preview.alias("preview")))).alias("b"), F.first("query").alias("query"))  # a bounded top list
    title = F.concat(F.lit("# Contexte depuis la base de connaissances\n\nRequête: "), F.col("query"), F.format_string("\n\n## Documents pertinents (%d résultats)\n\n", F.size("b")))
    context = F.concat(title, F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("\n---\n\n" + instructions))
    return held.select("query_id", context.alias("context"), F.transform("b", lambda x: x["preview"]).alias("previews"))
