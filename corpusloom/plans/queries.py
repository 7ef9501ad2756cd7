"""The registered queries of the retrieval engine, each over whole tables, with SQL where SQL can say the same.

``documents`` are the corpus (its texts are chunks), ``benchmark`` the query batch, ``embeddings`` the
vector collection, ``pages`` the web source, ``events`` the ingest stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, numeric, text, vectors
from ..operators import answers, bm25, chunking, collections, figures, rerank, scoring, spans
from ..sources import files, web
from ..storage import stored
from ..streaming import guards
from . import ingest, retrieval
from .registry import batch, chunks, per_document, q, query, r6, sql_any, sql_count, sql_hits, sql_pairs, sql_sentences, sql_tokens, sql_words, table, vector_tables

_INDEX = f"""
d0 AS (SELECT doc_id, coalesce(text, '') AS content, {sql_tokens("coalesce(text, '')")} AS t FROM documents),
q0 AS (SELECT item_id AS query_id, text AS query, {sql_tokens("coalesce(text, '')")} AS t FROM benchmark),
dt AS (SELECT doc_id, {sql_pairs("t")} AS ts FROM d0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_pairs("t")}) AS term FROM q0) GROUP BY ALL),
dl AS (SELECT doc_id, len(ts) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) SEMI JOIN qt USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ix AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, st),
sparse AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS sparse
  FROM qt JOIN ix USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
kq AS (SELECT query_id, term AS token, qtf, idf FROM qt JOIN ix USING (term) WHERE strlen(term) >= 3),
kh AS (SELECT DISTINCT token, doc_id FROM (SELECT DISTINCT token FROM kq) JOIN d0 ON contains(lower(content), token)),
keyword AS (SELECT query_id, doc_id, least(1.0, sum(qtf * least(idf / 5, 0.2)) + CASE WHEN sum(CASE WHEN idf > 2 THEN qtf ELSE 0 END) >= 2 THEN 0.2 ELSE 0 END) AS keyword
  FROM kq JOIN kh USING (token) GROUP BY ALL),
i2 AS (SELECT term, ln((SELECT n FROM st) / count(*) + 1) AS idf2 FROM
  (SELECT unnest(list_distinct(list_filter(t, lambda x: strlen(x) > 2))) AS term FROM d0) GROUP BY term),
tq AS (SELECT query_id, term, idf2, row_number() OVER (PARTITION BY query_id ORDER BY idf2 DESC, i) AS place FROM
  (SELECT query_id, unnest(f) AS term, generate_subscripts(f, 1) AS i FROM (SELECT query_id, list_filter(t, lambda x: strlen(x) > 2) AS f FROM q0)) JOIN i2 USING (term)),
tt AS (SELECT * FROM tq WHERE place <= 5),
th AS (SELECT DISTINCT term, doc_id FROM (SELECT DISTINCT term FROM tt) JOIN d0 ON contains(lower(content), term)),
technical AS (SELECT query_id, doc_id, sum(least(idf2 / 5, 0.2)) AS technical FROM tt JOIN th USING (term) GROUP BY ALL)"""

_PAIRS = f"""{_INDEX},
pairs AS (SELECT query_id, doc_id, query, content, coalesce(sparse, 0) AS sparse,
  CASE WHEN technical IS NULL THEN coalesce(keyword, 0) ELSE least(coalesce(keyword, 0) + technical, 1.0) END AS keyword
  FROM q0 CROSS JOIN d0 LEFT JOIN sparse USING (query_id, doc_id) LEFT JOIN keyword USING (query_id, doc_id) LEFT JOIN technical USING (query_id, doc_id)),
mm AS (SELECT *, (sparse - min(sparse) OVER w) / greatest(max(sparse) OVER w - min(sparse) OVER w, 1e-6) AS s1,
  (keyword - min(keyword) OVER w) / greatest(max(keyword) OVER w - min(keyword) OVER w, 1e-6) AS k1 FROM pairs WINDOW w AS (PARTITION BY query_id)),
hy AS (SELECT *, 0.4 * s1 + 0.2 * k1 AS hybrid FROM mm)"""

_BIB = f"""({sql_hits("lower(content)", rerank.BIBLIOGRAPHY + rerank.NUMBERED)} >= 2 OR {sql_count("content", r"[A-Z]\.\s+[A-Z]")} >= 3
  OR (len({sql_words("content")}) > 20 AND length(content) - length(replace(content, ',', '')) > len({sql_words("content")}) // 4))"""


# --- scoring ----------------------------------------------------------------------------------------


@query(f"WITH {_INDEX} SELECT query_id, doc_id, round(sparse, 6) AS sparse FROM sparse")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = bm25.query_terms(batch(spark, sf_dir))
    index = bm25.build_index(chunks(spark, sf_dir), terms)
    return bm25.bm25(terms, index).select("query_id", "doc_id", r6(F.col("sparse")).alias("sparse"))


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM ix")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = bm25.query_terms(batch(spark, sf_dir))
    index = bm25.build_index(chunks(spark, sf_dir), terms)
    return index.frequencies.select("term", "df", r6(bm25.idf(index.rows, F.col("df"))).alias("idf"))


@query(f"WITH {_INDEX} SELECT query_id, doc_id, round(keyword, 6) AS keyword FROM keyword")
def keyword_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    terms = bm25.query_terms(batch(spark, sf_dir))
    usable = bm25.boost_tokens(terms, bm25.build_index(docs, terms))
    boosts = bm25.keyword_boost(usable, bm25.containing(usable, docs))
    return boosts.select("query_id", "doc_id", r6(F.col("keyword")).alias("keyword"))


@query(f"WITH {_INDEX} SELECT query_id, term, round(idf2, 6) AS idf, place FROM tt")
def technical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.technical_terms(batch(spark, sf_dir), bm25.term_idf(chunks(spark, sf_dir)), 5)
    return found.select("query_id", "term", r6(F.col("idf")).alias("idf"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_INDEX} SELECT query_id, doc_id, round(technical, 6) AS technical FROM technical")
def technical_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    top = bm25.technical_terms(batch(spark, sf_dir), bm25.term_idf(docs), 5)
    found = bm25.technical_boost(top, bm25.containing(top.select(F.col("term").alias("token")), docs))
    return found.select("query_id", "doc_id", r6(F.col("technical")).alias("technical"))


@query(f"""WITH {_PAIRS}, z AS (SELECT query_id, doc_id, s1, 1 / (1 + exp(-(sparse - avg(sparse) OVER w) / greatest(stddev_pop(sparse) OVER w, 1e-6))) AS z
  FROM mm WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(s1, 6) AS min_max, round(z, 6) AS z_logistic FROM z""")  # fmt: skip
def score_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = batch(spark, sf_dir), chunks(spark, sf_dir)
    terms = bm25.query_terms(queries)
    index = bm25.build_index(docs, terms)
    scores = stored(bm25.bm25(terms, index), "sparse")
    ranges = scoring.score_ranges(scores, ["sparse"], index.rows).withColumnRenamed("query_id", "_q")
    every = queries.select("query_id").join(F.broadcast(ranges), F.col("query_id") == F.col("_q"), "left").drop("_q").fillna(0.0)  # one row a query
    pairs = docs.select("doc_id").join(F.broadcast(every), how="cross").join(scores, ["query_id", "doc_id"], "left")
    s = F.coalesce("sparse", F.lit(0.0))
    z = scoring.z_logistic(s, F.col("mean_sparse"), F.col("deviation_sparse"))
    return pairs.select("query_id", "doc_id", r6(scoring.min_max(s, F.col("low_sparse"), F.col("high_sparse"))).alias("min_max"), r6(z).alias("z_logistic"))


_KIND = f"""CASE WHEN (regexp_matches(query, {q(numeric.PERCENT)}) OR regexp_matches(query, {q(numeric.TIMES)}))
    AND (regexp_matches(query, {q(numeric.COMPARING.replace('(?iu)', '(?i)'))}) OR {sql_any("lower(query)", numeric.CONCEPTS)}) THEN 'DigitCombined'
  WHEN regexp_matches(query, {q(numeric.PERCENT)}) OR regexp_matches(query, {q(numeric.TIMES)}) THEN 'DigitAtomic'
  WHEN {sql_any("lower(query)", numeric.CONCEPTS)} AND len({sql_words("query")}) > 5 THEN 'TextCombined' ELSE 'TextAtomic' END"""


@query(f"""WITH {_PAIRS}, b AS (SELECT *, CASE WHEN {_BIB} THEN hybrid * 0.1 ELSE hybrid END AS score FROM hy),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b)
  SELECT query_id, doc_id, round(sparse, 6) AS sparse, round(keyword, 6) AS keyword, round(hybrid, 6) AS hybrid, round(score, 6) AS score, rank
  FROM r WHERE rank <= 10""")  # fmt: skip
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking without dense scores; the benchmark's questions have no numbers with units."""
    found = retrieval.hybrid_search(batch(spark, sf_dir), chunks(spark, sf_dir))
    return found.select(
        "query_id", "doc_id", *[r6(F.col(c)).alias(c) for c in ("sparse", "keyword", "hybrid", "score")], F.col("rank").cast("long").alias("rank")
    )


_VEC = """
qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
sc AS (SELECT query_id, vec_id AS doc_id, label, list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))
  / sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[])) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS score
  FROM qv CROSS JOIN embeddings),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


@query(f"WITH {_VEC} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_search(*vector_tables(spark, sf_dir))
    return found.select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VEC} SELECT query_id, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 10 AND score >= 0.5")
def vector_search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_search(*vector_tables(spark, sf_dir), min_score=0.5)
    return found.select("query_id", "doc_id", r6(F.col("score")).alias("score"))


@query(f"""WITH {_VEC}, g AS (SELECT query_id, score, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.8 END AS c FROM rk WHERE rank <= 10)
  SELECT query_id, round(sum(score * c) / sum(score), 6) AS confidence FROM g GROUP BY query_id""")  # fmt: skip
def response_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, points = vector_tables(spark, sf_dir)
    ranked = retrieval.vector_search(queries, points).join(points.select("doc_id", "label"), "doc_id")
    ranked = ranked.withColumn("confidence", F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.8))
    return retrieval.response_confidence(ranked).select("query_id", r6(F.col("confidence")).alias("confidence"))


# --- classification and extraction ------------------------------------------------------------------

_SIGNALS = f"""
SELECT doc_id, text, {sql_count("text", "(?i)" + classify.BUSINESS_SECTIONS)} AS sections, {sql_count("text", "(?i)" + classify.BUSINESS_METRICS)} AS metrics,
  {sql_count("text", "(?i)" + classify.COMPANIES)} AS companies, {sql_any("lower(text)", ["executive summary", "management summary"])} AS summary,
  coalesce({", ".join(f"nullif(regexp_extract(text, {q('(?i)' + classify.FISCAL)}, {n}), '')" for n in range(2, 6))}) AS y FROM documents"""
_CONFIDENCES = f"""
WITH s AS ({_SIGNALS}), f AS (SELECT *, CASE WHEN CAST(y AS INT) BETWEEN 2000 AND 2030 THEN CAST(y AS INT) END AS fiscal_year FROM s),
c AS (SELECT *, least(1.0, round(CASE WHEN summary THEN 0.3 ELSE 0 END + least(sections * 0.1, 0.4) + least(metrics * 0.05, 0.4) + least(companies * 0.03, 0.2)
    + CASE WHEN fiscal_year IS NOT NULL THEN 0.2 ELSE 0 END, 6)) AS business,
  least(1.0, round({sql_count("text", classify.CITATIONS)} * 0.2 + {sql_count("text", "(?i)" + classify.ACADEMIC_SECTIONS)} * 0.15, 6)) AS academic,
  least(1.0, round(({sql_count("text", "(?i)" + classify.LEGAL_CLAUSES)} + {sql_count("text", "(?i)" + classify.LEGAL_TERMS)}) * 0.1, 6)) AS legal,
  least(1.0, round(({sql_count("text", classify.CODE)} + {sql_count("text", "(?i)" + classify.SPECIFICATIONS)}) * 0.1, 6)) AS technical FROM f)
SELECT doc_id, sections, metrics, companies, fiscal_year, CAST(business AS DOUBLE) AS business, CAST(academic AS DOUBLE) AS academic, CAST(legal AS DOUBLE) AS legal, CAST(technical AS DOUBLE) AS technical,
  CASE WHEN business >= 0.6 AND business >= academic THEN 'Business' WHEN academic >= 0.7 AND academic >= business THEN 'Academic'
    WHEN legal >= 0.5 THEN 'Legal' WHEN technical >= 0.5 THEN 'Technical' ELSE 'Mixed' END AS category FROM c"""


@query(_CONFIDENCES)
def document_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(classify.signals(F.col("text")))))
    s = F.struct(*[c for c in counted.columns if c != "doc_id"])
    scored = counted.select("doc_id", "sections", "metrics", "companies", "fiscal_year", *[c.alias(n) for n, c in classify.confidences(s).items()])
    return scored.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("sections", "metrics", "companies")], "fiscal_year", "business", "academic", "legal", "technical",
        classify.category_of(F.col("business"), F.col("academic"), F.col("legal"), F.col("technical")).alias("category"),
    )


_DOMAIN = {name: sql_hits("lower(text)", words) for name, words in classify.DOMAIN_TERMS.items()}
_TOP = "greatest(" + ", ".join(_DOMAIN.values()) + ")"
per_document(
    "domain_intent",
    lambda t: {"intent": classify.domain_intent(t), "legal_hits": classify.strong_legal_hits(t)},
    f"CASE WHEN {_TOP} = 0 THEN 'General' " + " ".join(f"WHEN {h} = {_TOP} THEN '{n}'" for n, h in _DOMAIN.items()) + " END AS intent, "
    + " + ".join(sql_count("text", "(?i)" + p) for p in classify.STRONG_LEGAL) + " AS legal_hits",
)

per_document(
    "figure_reference",
    lambda t: {"has_figure": classify.has_figure_reference(t)},
    f"{sql_any('lower(text)', classify.FIGURE_WORDS)} AND {sql_any('lower(text)', classify.DATA_WORDS)} AS has_figure",
)
per_document(
    "page_type_of_text",
    lambda t: {"page_type": classify.page_type(F.lit("intelligent"), t)},
    f"CASE WHEN {sql_any('lower(text)', classify.COMMERCE_WORDS)} THEN 'commerce' WHEN {sql_any('lower(text)', classify.ARTICLE_WORDS)} THEN 'article' ELSE 'generic' END AS page_type",
)
per_document(
    "numeric_values",
    lambda t: {
        "n_values": F.size(numeric.values(t)).cast("long"),
        "total": F.round(F.aggregate(numeric.values(t), F.lit(0.0), lambda a, v: a + v["value"]), 4),
    },
    f"len(regexp_extract_all(text, {q(numeric.PERCENT)})) + len(regexp_extract_all(text, {q(numeric.TIMES)})) AS n_values, "
    f"round(coalesce(list_sum(list_transform(list_concat(regexp_extract_all(text, {q(numeric.PERCENT)}, 1), regexp_extract_all(text, {q(numeric.TIMES)}, 1)), lambda x: CAST(x AS DOUBLE))), 0), 4) AS total",
)


@query(f"SELECT item_id AS query_id, {_KIND} AS kind FROM (SELECT item_id, text AS query FROM benchmark)")
def query_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).select("query_id", numeric.query_kind(F.col("query")).alias("kind"))


# --- rerank features --------------------------------------------------------------------------------

per_document(
    "bibliography_penalty",
    lambda t: {"is_bibliography": rerank.is_bibliography(t)},
    _BIB.replace("content", "text") + " AS is_bibliography",
)
per_document(
    "section_prior",
    lambda t: {
        "contaminated": rerank.is_contaminated(t, F.lit("Document Text")),
        "prior": rerank.section_prior(t, F.lit("Table")),
    },
    f"({sql_hits('lower(text)', rerank.BIBLIOGRAPHY)} >= 3 OR {sql_hits('lower(text)', rerank.VISUAL)} >= 2) AS contaminated, "
    "CAST(CASE WHEN starts_with(lower(text), 'abstract') OR contains(lower(text), 'in this paper we') THEN 0.15 "
    "WHEN contains(lower(text), 'introduction') AND contains(lower(text), 'we propose') THEN 0.12 "
    f"WHEN {sql_any('lower(text)', ['conclusion', 'in summary'])} THEN 0.10 WHEN contains(lower(text), 'benchmark') THEN -0.15 "
    f"WHEN {sql_any('lower(text)', ['experiments', 'evaluation'])} THEN -0.10 WHEN {sql_hits('lower(text)', rerank.MODEL_NAMES)} >= 2 THEN -0.20 ELSE 0 END AS DOUBLE) AS prior",
)


def _sql_part(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


_LOW = "lower(text)"
_GOAL = " + ".join([
    f"0.2 * {sql_hits(_LOW, rerank.GOAL_MARKERS)}",
    _sql_part(f"contains({_LOW}, 'table') AND length(text) - length(replace(text, ',', '')) > 5", -0.5),
    _sql_part(sql_any(_LOW, ["library", "room", "furniture"]), -0.5),
    _sql_part(f"{sql_hits(_LOW, rerank.BENCHMARK_NOISE)} >= 2", -0.7),
    _sql_part(f"contains({_LOW}, 'figure caption')", -0.4),
    _sql_part(f"{sql_hits(_LOW, rerank.TECHNICAL_DETAILS)} >= 3", -0.6),
    _sql_part(f"starts_with({_LOW}, 'abstract') OR {sql_any(_LOW, ['in this paper', 'in this work'])}", 0.5),
    _sql_part(sql_any(_LOW, ["our goal", "we propose to", "this paper proposes"]), 0.4),
])
per_document(
    "query_aware_goal",
    lambda t: {"semantic": rerank.semantic_score(F.lit("what is the goal"), t)},
    f"CAST(greatest(0, least(1, round({_GOAL}, 6))) AS DOUBLE) AS semantic",
)

# --- text -------------------------------------------------------------------------------------------

per_document(
    "text_statistics",
    lambda t: {
        "n_bytes": F.octet_length(t).cast("long"), "n_words": text.word_count(t).cast("long"), "n_tokens": F.size(text.bare_tokens(t)).cast("long"),
        "n_terms": F.size(text.with_bigrams(text.bare_tokens(t))).cast("long"),
    },
    f"strlen(text) AS n_bytes, len({sql_words('text')}) AS n_words, len({sql_tokens('text')}) AS n_tokens, 2 * len({sql_tokens('text')}) - CASE WHEN len({sql_tokens('text')}) > 0 THEN 1 ELSE 0 END AS n_terms",
)
per_document(
    "pii_redaction",
    lambda t: {"has_pii": text.has_pii(t), "redacted": F.sha2(text.redact_pii(t), 256)},
    f"regexp_matches(text, {q(text.EMAIL)}) OR regexp_matches(text, {q(text.PHONE)}) AS has_pii, "
    f"sha256(regexp_replace(regexp_replace(text, {q(text.EMAIL)}, '[EMAIL_REDACTED]', 'g'), {q(text.PHONE)}, '[PHONE_REDACTED]', 'g')) AS redacted",
)
per_document(
    "normalization_gate",
    lambda t: {"score": text.normalization_score(t).cast("long"), "needed": text.needs_normalization(t)},
    f"10 * {sql_count('left(text, 10000)', '[' + ''.join(text.LIGATURES) + ']')} + 8 * {sql_count('left(text, 10000)', '[' + text.ZERO_WIDTH + ']')}"
    f" + 3 * {sql_count('left(text, 10000)', '[' + chr(0xA0) + chr(0xAD) + chr(0x202F) + chr(0x205F) + chr(0x3000) + ']')} + 2 * {sql_count('left(text, 10000)', '[' + chr(0x2000) + '-' + chr(0x200A) + ']')}"
    " + CASE WHEN contains(text, '-' || chr(10)) OR contains(text, '- ' || chr(10)) OR contains(text, '-' || chr(13) || chr(10)) THEN 5 ELSE 0 END AS score, "
    "strlen(text) >= 10 AND score >= CASE WHEN strlen(text) > 50000 THEN 8 ELSE 3 END AS needed",
)
per_document(
    "line_cleaning",
    lambda t: {"cleaned": F.sha2(text.trimmed_lines(t), 256), "joined": F.sha2(text.joined_words(t), 256)},
    f"sha256(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS cleaned, sha256(array_to_string({sql_words('text')}, ' ')) AS joined",
)
per_document(
    "key_sentences",
    lambda t: {"sentences": F.array_join(text.key_sentences(t, 3), "|")},
    f"array_to_string({sql_sentences('text', 3)}, '|') AS sentences",
)

@query(f"""WITH a AS (SELECT doc_id, list_distinct({sql_words("lower(text)")}) AS w FROM documents),
  b AS (SELECT item_id AS query_id, list_distinct({sql_words("lower(text)")}) AS w FROM benchmark),
  j AS (SELECT query_id, doc_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM a CROSS JOIN b)
  SELECT query_id, doc_id, round(i / (n - i), 6) AS jaccard FROM j WHERE i / (n - i) > 0.3""")  # fmt: skip
def selection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks like a selected text: word sets meet on words, so only pairs that share one are compared."""

    def sets(df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select(key, F.array_distinct(text.words(F.lower(F.coalesce(column, F.lit(""))))).alias("w"))

    a, b = sets(chunks(spark, sf_dir), "doc_id", "content"), sets(batch(spark, sf_dir), "query_id", "query")
    x = a.select("doc_id", F.size("w").alias("na"), F.explode_outer("w").alias("word")).where("word is not null")
    y = b.select("query_id", F.size("w").alias("nb"), F.explode_outer("w").alias("word")).where("word is not null")
    met = x.join(y, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    jaccard = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    return met.where(jaccard > 0.3).select("query_id", "doc_id", r6(jaccard).alias("jaccard"))


# --- segmentation -----------------------------------------------------------------------------------


per_document(
    "figure_captions",
    lambda t: {"n_captions": F.size(figures.captions(t)).cast("long")},
    f"{sql_count('text', figures.FIGURE.replace('(?miu)', '(?mi)'))} + {sql_count('text', figures.TABLE.replace('(?miu)', '(?mi)'))} AS n_captions",
)
per_document(
    "numeric_lines",
    lambda t: {"kept": F.sha2(figures.numeric_lines(t), 256), "pairs": F.size(figures.key_values(t)).cast("long")},
    "sha256(array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[\\p{N}%xX.,]')), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS kept, "
    f"{sql_count('text', figures.PAIRS)} AS pairs",
)
per_document(
    "ocr_text_confidence",
    lambda t: {"confidence": F.round(figures.recognised_confidence(t), 6)},
    "round(greatest(0, least(1, 0.5 + least(strlen(text) / 100, 0.3) + length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) * 0.2 "
    f"+ least(len(list_filter({sql_words('text')}, lambda x: strlen(x) > 2)) / 10, 0.2) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s.,!?()\\-:;\"'']', '', 'g')) / length(text) * 0.3)), 6) AS confidence",
)


# --- spans ------------------------------------------------------------------------------------------

_SPANS = "s AS (SELECT doc_id, doc_id * 100000 + i AS span_id, i * 200 AS char_start, least(i * 200 + 300, n_chars) AS char_end FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 199) // 200)) AS i FROM documents WHERE n_chars > 0))"


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 300 characters that start every 200."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    i = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") + 199) / 200) - 1))
    rows = docs.select("doc_id", "n_chars", i.alias("i"))
    return rows.select("doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("span_id"), (F.col("i") * 200).alias("char_start"), F.least(F.col("i") * 200 + 300, F.col("n_chars")).alias("char_end"))


@query(f"WITH {_SPANS} SELECT s.doc_id AS range_id, span_id FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE char_start < 1500 AND char_end > 900")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("range_id"), F.lit(900).alias("lo"), F.lit(1500).alias("hi"))
    return spans.overlapping(span_table(spark, sf_dir), ranges)


@query(f"WITH {_SPANS} SELECT doc_id AS pos_id, min(span_id) AS span_id FROM s WHERE 1000 >= char_start AND 1000 < char_end GROUP BY doc_id")
def span_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos_id"), F.lit(1000).alias("pos"))
    return spans.at_position(span_table(spark, sf_dir), positions)


@query(f"WITH {_SPANS} SELECT count(*) FILTER (span_id % 2 = 0) AS with_box, count(*) AS spans, count(DISTINCT doc_id) AS documents, round(avg(char_end - char_start), 6) AS mean_length FROM s")
def span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = span_table(spark, sf_dir).withColumn("bbox", F.when(F.col("span_id") % 2 == 0, F.struct(F.lit(1.0).alias("x"))))
    return spans.span_stats(boxed).withColumn("mean_length", r6(F.col("mean_length")))


# --- collections ------------------------------------------------------------------------------------


@query("""SELECT source AS doc_id, count(*) AS n_chunks, round(avg(n_chars), 6) AS confidence,
  left(arg_min(text, doc_id) FILTER (trim(text) <> ''), 200) AS sample FROM documents GROUP BY source""")  # fmt: skip
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents and documents as their chunks."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"), F.col("n_chars").alias("confidence"))
    return collections.list_documents(rows).withColumn("confidence", r6(F.col("confidence")))


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'xx', source FROM documents WHERE doc_id % 3 = 0""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = docs.where("doc_id % 3 = 0").withColumn("version", F.lit(1)).withColumn("lang", F.lit("old"))
    newer = new.withColumns({"version": F.lit(2), "lang": F.lit("xx")})
    return collections.upsert(docs.withColumn("version", F.lit(0)), new.unionByName(newer), "doc_id", "version").drop("version")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return collections.delete_documents(docs, docs.where("source = 'src0'"))


@query("SELECT lang AS chunk_source, count(*) AS n, round(avg(strlen(text)), 6) AS mean_bytes FROM documents GROUP BY lang")
def chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("chunk_source"), F.col("text").alias("content"))
    return collections.chunk_stats(rows).withColumn("mean_bytes", r6(F.col("mean_bytes")))


@query("""SELECT event_type, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS high FROM events GROUP BY event_type""")  # fmt: skip
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collections.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", *[r6(F.col(c)).alias(c) for c in ("low", "mean", "p50", "p95", "p99", "high")])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(sum(CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END * value), 6) AS ema FROM r GROUP BY event_type""")  # fmt: skip
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.moving_average(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 0.9).withColumn("ema", r6(F.col("ema")))


@query("""WITH c AS (SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(first_text, '[^\\p{L}\\p{N}\\s_]', '', 'g'), '\\s+'), lambda x: x <> ''), 1, 6), ' ') AS title FROM c""")  # fmt: skip
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
    return first.select("conv_id", collections.conversation_title(F.col("first_text")).alias("title"))


@query("WITH c AS (SELECT lower(text) AS t FROM conversations), g AS (" + " UNION ALL ".join(
    f"SELECT '{tag}' AS tag, count(*) AS n FROM c WHERE {sql_any('t', words)}" for tag, words in collections.TAGS.items()
) + f" UNION ALL SELECT 'général', count(*) FROM c WHERE NOT ({' OR '.join(sql_any('t', w) for w in collections.TAGS.values())})) SELECT * FROM g WHERE n > 0")
def conversation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.explode(collections.conversation_tags(F.col("text"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


# --- web --------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '#[a-zA-Z].*$', 0) AS f, regexp_replace(url, '#.*$', '') AS b FROM pages),
  k AS (SELECT page_id, regexp_replace(b, '\\?.*$', '') AS h, list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^({"|".join(web.TRACKING)})(=|$)')) AS ps, f FROM p)
  SELECT page_id, h || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END || f AS url FROM k""")  # fmt: skip
def url_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.normalize_url(F.col("url")).alias("url"))


# --- ingest guards ----------------------------------------------------------------------------------


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, abs(epoch(now) - epoch(date_trunc('second', ts))) <= 900 AS fresh FROM
  (SELECT event_id, ts, date_trunc('second', now) AS now FROM events, m)""")  # fmt: skip
def time_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return events.select("event_id", guards.fresh(F.col("ts"), F.lit(now)).alias("fresh"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS method, count(*) AS n, round(sum(value), 4) AS bytes FROM events GROUP BY ALL""")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("method"), F.col("value").alias("size"))
    found = guards.telemetry(events, window="1 hour")
    return found.select(F.col("window.start").alias("start"), "method", "n", F.round("bytes", 4).alias("bytes"))


# --- further features and maintenance ---------------------------------------------------------------

_LINE = f"""CASE WHEN {sql_any("lower(line)", scoring.DISCLAIMERS)} THEN 'Disclaimer' WHEN {sql_any("lower(line)", ("forward", "outlook", "projection", "estimate"))} THEN 'ForwardLooking'
  WHEN strlen(line) < 100 AND length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) / strlen(line) > 0.5 THEN 'Title'
  WHEN starts_with(lower(line), 'chapter') OR starts_with(lower(line), 'section') OR starts_with(lower(line), 'chapitre') OR starts_with(lower(line), 'partie') THEN 'HeaderH1'
  WHEN contains(line, chr(9)) OR length(line) - length(replace(line, '|', '')) > 2 OR (length(line) - length(replace(line, '  ', ''))) / 2 > 5 THEN 'TableCell' ELSE 'Body' END"""


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
  SELECT doc_id, {_LINE} AS section, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL""")  # fmt: skip
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.where("line <> ''").groupBy("doc_id", scoring.line_section(F.col("line")).alias("section")).agg(F.count("*").alias("n"))


per_document(
    "boosted_score",
    lambda t: {"score": r6(scoring.intelligent_boost(F.lit(0.7), F.lit("Legal"), F.lit("Business"), t))},
    "CAST(round(greatest(0, least(0.75, 0.7 + CASE WHEN " + " + ".join(sql_count("text", "(?i)" + p) for p in classify.STRONG_LEGAL) + " >= 2 THEN 0.15 ELSE -0.10 END)), 6) AS DOUBLE) AS score",
)
per_document("embeddable", lambda t: {"embeddable": collections.embeddable(t)}, "trim(text) <> '' AND NOT starts_with(text, 'EXTRACTION FAILED') AS embeddable")
per_document("chunk_types", lambda t: {"chunk_type": chunking.chunk_type(t)}, """CASE WHEN starts_with(ltrim(text), 'fn ') OR starts_with(ltrim(text), 'function ') THEN 'Function'
  WHEN starts_with(ltrim(text), 'class ') OR starts_with(ltrim(text), 'struct ') THEN 'Class' WHEN starts_with(ltrim(text), '//') OR starts_with(ltrim(text), '/*') THEN 'Comment' ELSE 'TextBlock' END AS chunk_type""")  # fmt: skip


@query("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, min(ts) AS created_at, count(*) AS n FROM events GROUP BY user_id)
  SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(n) AS BIGINT) AS embedded,
  CAST(sum(CASE WHEN epoch(date_trunc('second', now)) - epoch(date_trunc('second', created_at)) > 3600 THEN 1 ELSE 0 END) AS BIGINT) AS expired FROM s, m""")  # fmt: skip
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients as sessions that their first event opens."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    sessions = events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.count("*").alias("n_chunks")).withColumn("n_embedded", F.col("n_chunks"))
    return collections.session_stats(sessions, F.lit(now))


@query("""WITH e AS (SELECT event_id AS key, event_type AS cache, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events)
  SELECT key, cache FROM e WHERE n <= 50""")  # fmt: skip
def cache_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("cache"), F.col("ts").alias("last_access"))
    return collections.cap_cache(entries, 50).select("key", "cache")


@query("""WITH e AS (SELECT event_id AS key, event_type AS cache, round(value, 3) AS s, coalesce(sum(10) OVER (PARTITION BY event_type ORDER BY round(value, 3), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM events)
  SELECT key, cache FROM e WHERE freed < 500""")  # fmt: skip
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest scores of each cache until 500 are free, with entries of size 10."""
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("cache"), F.round("value", 3).alias("eviction_score"), F.lit(10).alias("size"))
    return collections.evict(entries, 500, by="cache").select("key", "cache")


@query("""WITH c AS (SELECT user_id AS doc_id, event_type, max(value) AS v FROM events GROUP BY ALL) SELECT doc_id, count(*) AS methods, round(max(v), 6) AS best FROM c GROUP BY doc_id""")
def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), "event_type").agg(F.max("value").alias("v"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("methods"), r6(F.max("v")).alias("best"))


# --- ingest and answers -----------------------------------------------------------------------------


@query(f"WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sparse, 9) DESC, doc_id) AS rank FROM sparse) SELECT query_id, doc_id, rank FROM r WHERE rank <= 10")
def lexical_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = batch(spark, sf_dir), chunks(spark, sf_dir)
    terms = bm25.query_terms(queries)
    best = scoring.top_k(bm25.best_pairs(terms, bm25.build_index(docs, terms), 10), 10)
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
