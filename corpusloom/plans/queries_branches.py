"""Queries whose rows reach branches that plain texts do not: headings of each profile, all ways of extraction, hits that a category drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from . import ingest, retrieval
from .queries import _CONFIDENCES, _VEC
from .queries_documents import _SPREAD, byte_fold, pack_sql, paragraph_fold, sentence_fold
from .registry import q, query, r6, sql_strip, table, vector_tables

#: Headings that are put into the texts, by profile; those that name a result are no headings.
TITLES = {
    "academic": ("Introduction", "Methods", "Results", "Discussion", "References"),
    "business": ("Executive Summary", "Risk Factors", "Financial Results", "Key Metrics", "Governance"),
    "legal": ("Article", "Definitions", "Termination", "Liability", "Clause"),
    "technical": ("Specification", "Algorithm", "Requirements", "Design", "Testing"),
    "mixed": ("Abstract", "Approach", "Evaluation", "Results", "Conclusion"),
}


def with_headings(text: Column, doc_id: Column, profile: str) -> Column:
    """The text's lines that are not blank, with a heading before every fourth from the second on; every other one has a number of two levels."""
    titles = F.array(*map(F.lit, TITLES[profile]))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"\S")))

    def headed(x: Column, i: Column) -> Column:
        number = F.when(i % 8 == 1, F.concat((F.floor(i / 4) + 1).cast("string"), F.lit("."), (doc_id % 3).cast("string"), F.lit(" "))).otherwise("")
        title = F.get(titles, ((F.floor(i / 4) + doc_id) % len(TITLES[profile])).cast("int"))
        return F.when(i % 4 == 1, F.concat(number, title, F.lit("\n"), x)).otherwise(x)

    return F.array_join(F.transform(lines, headed), "\n")


def _section_sql(profile: str) -> str:
    titles, p = TITLES[profile], chunking.PROFILES[profile]
    listed = "[" + ", ".join(q(t) for t in titles) + "]"
    title = f"{listed}[(i // 4 + doc_id) % {len(titles)} + 1]"
    true = f"i % 4 = 1 AND NOT contains(lower({title}), 'result')"
    wide = f"strlen(x.c) >= {p.least * 12}"
    merged = "{'t': a.t || ' + ' || x.t, 'l': a.l, 'c': a.c || x.c}"
    waiting, own = "{'t': a.t, 'l': a.l, 'c': a.c}", "{'t': x.t, 'l': x.l, 'c': x.c}"
    none = "CAST([] AS STRUCT(t VARCHAR, l INT, c VARCHAR)[])"
    step = f"""CASE WHEN {wide} THEN {{'t': '', 'l': CAST(0 AS INT), 'c': '', 'o': list_concat(a.o, CASE WHEN a.c <> '' THEN [{waiting}] ELSE {none} END, [{own}])}}
      WHEN a.c <> '' THEN {{'t': '', 'l': CAST(0 AS INT), 'c': '', 'o': list_append(a.o, {merged})}} ELSE {{'t': x.t, 'l': x.l, 'c': x.c, 'o': a.o}} END"""
    return f"""WITH ls AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents WHERE text IS NOT NULL),
  ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM ls),
  hd AS (SELECT *, CASE WHEN i % 4 = 1 THEN CASE WHEN i % 8 = 1 THEN (i // 4 + 1) || '.' || (doc_id % 3) || ' ' ELSE '' END || {title} || chr(10) ELSE '' END || line AS piece,
    {title} AS title, {true} AS starts, sum(CASE WHEN {true} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s, max(CASE WHEN {true} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS headed FROM ln),
  sc AS (SELECT doc_id, s, any_value(headed) AS headed, CASE WHEN any_value(headed) = 1 THEN arg_min(title, i) ELSE 'Document' END AS t, CAST(CASE WHEN any_value(headed) = 1 AND min(i) % 8 = 1 THEN 2 ELSE 1 END AS INT) AS l, string_agg(piece, chr(10) ORDER BY i) AS c FROM hd GROUP BY doc_id, s),
  se AS (SELECT doc_id, s, headed, t, l, c || CASE WHEN s < max(s) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS c FROM sc),
  fd AS (SELECT doc_id, any_value(headed) AS headed, list_reduce(list_prepend({{'t': '', 'l': CAST(0 AS INT), 'c': '', 'o': {none}}}, list({{'t': t, 'l': l, 'c': c, 'o': {none}}} ORDER BY s)), lambda a, x: {step}) AS a,
    list({{'t': t, 'l': l, 'c': c}} ORDER BY s) AS plain FROM se WHERE headed = 0 OR s > 0 GROUP BY doc_id),
  mg AS (SELECT doc_id, CASE WHEN headed = 0 THEN plain WHEN a.c <> '' THEN list_append(a.o, {{'t': a.t, 'l': a.l, 'c': a.c}}) ELSE a.o END AS m FROM fd),
  ms AS (SELECT doc_id, unnest(m) AS m, generate_subscripts(m, 1) AS k FROM mg), mt AS (SELECT doc_id, k, m.t AS section, m.l AS level, m.c AS t FROM ms),
  pk AS (SELECT doc_id, k, section, level, {pack_sql(profile)} AS cs FROM mt), un AS (SELECT doc_id, k, section, level, unnest(cs) AS content, generate_subscripts(cs, 1) AS j FROM pk)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INT) AS chunk_idx, sha256(content) AS content, section, level FROM un"""


def _section_query(profile: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        cut = chunking.chunk_table(docs.select("doc_id", with_headings(F.col("text"), F.col("doc_id"), profile).alias("text")), profile)
        return cut.select("doc_id", "chunk_idx", F.sha2("content", 256).alias("content"), "section", "level")

    run.__name__ = f"sections_{profile}"
    query(_section_sql(profile))(run)


for _profile in TITLES:
    _section_query(_profile)

_METHODS = list(chunking.DISPATCH)
_BYTES = byte_fold("string_split(t, chr(10) || chr(10))", 384, 48)
_COARSE = byte_fold("string_split(t, chr(10) || chr(10))", 1500, 0)


@query(f"""WITH d AS (SELECT doc_id, {_SPREAD.replace("text", "coalesce(text, '')")} AS t FROM documents),
  a AS (SELECT doc_id, t, CASE WHEN doc_id % 5 < 2 THEN {sentence_fold("t")} ELSE {paragraph_fold("t")} END AS cs, {_BYTES} AS bs, {_COARSE} AS os FROM d),
  b AS (SELECT doc_id, t, bs, os, CASE WHEN len(cs) = 0 AND {sql_strip("t")} <> '' THEN [t] ELSE cs END AS cs, CASE WHEN len(cs) = 0 THEN 0.8 ELSE 1.0 END AS confidence FROM a),
  c AS (SELECT doc_id, t, os, CASE WHEN len(cs) = 1 AND strlen(t) > 768 AND len(bs) > 1 THEN bs ELSE cs END AS cs, CASE WHEN len(cs) = 1 AND strlen(t) > 768 AND len(bs) > 1 THEN 0.8 ELSE confidence END AS confidence FROM b),
  e AS (SELECT doc_id, CASE WHEN len(cs) < 2 AND strlen(t) > 3000 AND len(os) > 0 THEN os ELSE cs END AS cs, CASE WHEN len(cs) < 2 AND strlen(t) > 3000 AND len(os) > 0 THEN 0.7 ELSE confidence END AS confidence FROM c),
  f AS (SELECT doc_id, CASE WHEN len(cs) = 0 THEN ['EXTRACTION FAILED'] ELSE cs END AS cs, CASE WHEN len(cs) = 0 THEN 0.0 ELSE confidence END AS confidence FROM e)
  SELECT doc_id, CAST(i - 1 AS INT) AS chunk_idx, sha256(content) AS content, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT doc_id, confidence, unnest(cs) AS content, generate_subscripts(cs, 1) AS i FROM f)""")  # fmt: skip
def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut by their way of extraction, each in turn, with the ladder of fallbacks down to the emergency chunk."""
    spread = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    method = F.get(F.array(*map(F.lit, _METHODS)), (F.col("doc_id") % 5).cast("int"))
    cut = ingest.cut(table(spark, sf_dir, "documents").select("doc_id", spread.alias("text"), method.alias("method")), [])
    return cut.select("doc_id", "chunk_idx", F.sha2("content", 256).alias("content"), "confidence")


_KEPT = ("Academic", "Legal", "Technical", "Business")
#: What texts begin with, in turn: nothing, a report, a contract.
_STARTS = ("", "Executive Summary. Fiscal Year 2024: revenue, EBITDA, net income and operating margin. ", "Whereas the party of this agreement, hereby: liability, warranty, indemnification, termination, jurisdiction, arbitration clause. ")
_BEGUN = f"FROM (SELECT doc_id, [{', '.join(map(q, _STARTS))}][doc_id % 3 + 1] || coalesce(text, '') AS text FROM documents)"


@query(f"""WITH {_VEC}, k AS ({_CONFIDENCES.replace("FROM documents", _BEGUN)})
  SELECT query_id, rk.doc_id, round(score, 6) AS score, rank, CASE WHEN rk.doc_id % 3 = 0 THEN 'unknown' ELSE CAST(rk.doc_id AS VARCHAR) END AS document_id, CAST(CASE WHEN rk.doc_id % 2 = 0 THEN 0.5 ELSE 0.85 END AS DOUBLE) AS confidence, category
  FROM rk JOIN k ON rk.doc_id = k.doc_id WHERE rank <= 10 AND category IN ({", ".join(q(c) for c in _KEPT)})""")  # fmt: skip
def vector_hits_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits with the texts of their numbers, payload defaults, and only those of some categories."""
    n = F.col("doc_id")
    begun = F.concat(F.get(F.array(*map(F.lit, _STARTS)), (n % 3).cast("int")), F.coalesce("text", F.lit("")))
    texts = table(spark, sf_dir, "documents").select("doc_id", begun.alias("content"), F.when(n % 3 != 0, n.cast("string")).alias("document_id"), F.when(n % 2 == 0, 0.5).alias("confidence"))
    hits = retrieval.vector_search(*vector_tables(spark, sf_dir)).join(texts, "doc_id")
    found = retrieval.hit_metadata(hits, categories=list(_KEPT), business=True, fiscal_year=2024)
    return found.select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"), "document_id", "confidence", "category")
