"""Queries of ranking: dense and numeric hybrid search, intents, rerankers, answers, contexts, approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, numeric, text, vectors
from ..operators import ann, answers, bm25, rerank, scoring, search_engine
from ..storage import stored
from . import retrieval
from .queries import _BIB, _CONFIDENCES, _DOMAIN, _INDEX, _LINE, _PAIRS, _TOP, _VEC
from .registry import batch, chunks, per_document, q, query, r6, sql_any, sql_condense, sql_count, sql_hits, sql_sentences, sql_words, table, vector_tables

# --- hybrid search ----------------------------------------------------------------------------------

#: Hashed words as vectors: slot and sign of each word, their sums, and cosines from sums of products.
_DENSE = f"""
dw AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS h FROM (SELECT doc_id, unnest({sql_words("lower('passage: ' || content)")}) AS w FROM d0)),
qw AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS h FROM (SELECT query_id, unnest({sql_words("lower('query: ' || coalesce(query, ''))")}) AS w FROM q0)),
dv AS (SELECT doc_id, h % 64 AS slot, sum(CASE WHEN h < 64 THEN 1.0 ELSE -1.0 END) AS v FROM dw GROUP BY ALL),
qv AS (SELECT query_id, h % 64 AS slot, sum(CASE WHEN h < 64 THEN 1.0 ELSE -1.0 END) AS v FROM qw GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM dv GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY query_id),
dense AS (SELECT query_id, doc_id, CASE WHEN any_value(dn.n) * any_value(qn.n) > 0 THEN sum(dv.v * qv.v) / any_value(dn.n) / any_value(qn.n) ELSE 0 END AS dense
  FROM dv JOIN qv USING (slot) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)"""
_DENSE_PAIRS = f"""{_PAIRS}, {_DENSE},
da AS (SELECT mm.*, coalesce(dense, 0) AS dense FROM mm LEFT JOIN dense USING (query_id, doc_id)),
d1 AS (SELECT *, (dense - min(dense) OVER w) / greatest(max(dense) OVER w - min(dense) OVER w, 1e-6) AS d1 FROM da WINDOW w AS (PARTITION BY query_id)),
hd AS (SELECT *, 0.4 * d1 + 0.4 * s1 + 0.2 * k1 AS hybrid FROM d1),
sd AS (SELECT *, CASE WHEN {_BIB} THEN hybrid * 0.1 ELSE hybrid END AS score FROM hd)"""
_PRIOR = f"""CASE WHEN starts_with(lower(content), 'abstract') OR contains(lower(content), 'in this paper we') THEN 0.15
  WHEN contains(lower(content), 'introduction') AND contains(lower(content), 'we propose') THEN 0.12 WHEN {sql_any("lower(content)", ["conclusion", "in summary"])} THEN 0.10
  WHEN contains(source, 'Table') AND contains(lower(content), 'benchmark') THEN -0.15 WHEN {sql_any("lower(content)", ["experiments", "evaluation"])} THEN -0.10
  WHEN contains(source, 'Figure Caption') THEN -0.05 WHEN {sql_hits("lower(content)", rerank.MODEL_NAMES)} >= 2 THEN -0.20 ELSE 0 END"""
_DROPPED = f"""({sql_hits("lower(content)", rerank.BIBLIOGRAPHY)} >= 3 OR {sql_hits("lower(content)", rerank.VISUAL)} >= 2
  OR ((contains(source, 'Figure Caption') OR contains(source, 'Table Caption')) AND strlen(content) < 100))"""
_SCORES = ", ".join(f"round({n}, 6) AS {n}" for n in ("dense", "sparse", "keyword", "hybrid", "score"))


def rounded(found: DataFrame) -> DataFrame:
    names = ("dense", "sparse", "keyword", "hybrid", "score")
    return found.select("query_id", "doc_id", *[r6(F.col(n)).alias(n) for n in names], "has_match", F.col("rank").cast("long").alias("rank"))


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query batch and the chunks with a stand-in for the embedding model."""
    embed = vectors.hashed_embedding()
    asked = batch(spark, sf_dir).withColumn("embedding", embed(vectors.query_text(F.col("query"))))
    return asked, chunks(spark, sf_dir).withColumn("embedding", embed(vectors.passage_text(F.col("content"))))


@query(f"""WITH {_DENSE_PAIRS}, r AS (SELECT *, 'Document Text' AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM sd),
  p AS (SELECT * REPLACE (greatest(0.0, least(1.0, score + {_PRIOR})) AS score) FROM r WHERE place <= 10 AND NOT {_DROPPED})
  SELECT query_id, doc_id, {_SCORES}, false AS has_match, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p""")  # fmt: skip
def hybrid_search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking with dense scores and the section prior; the benchmark's questions have no numbers with units."""
    queries, docs = embedded(spark, sf_dir)
    return rounded(retrieval.hybrid_search(queries, docs, dense=True, prior=True))


_NUMBERED = _PAIRS.replace("FROM documents)", "FROM (SELECT doc_id, text || ' Measured ' || (doc_id % 100) || '%' AS text FROM documents))", 1).replace(
    "FROM benchmark)", "FROM (SELECT item_id, text || ' with less than 40%' AS text FROM benchmark))", 1
)
_BELOW = f"len(list_filter(regexp_extract_all(content, {q(numeric.PERCENT)}, 1), lambda x: CAST(x AS DOUBLE) < 40)) > 0"


@query(f"""WITH {_NUMBERED}, b AS (SELECT *, CAST(0 AS DOUBLE) AS dense, CASE WHEN {_BIB} THEN hybrid * 0.1 ELSE hybrid END AS score, {_BELOW} AS has_match FROM hy),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY has_match DESC, round(score, 9) DESC, doc_id) AS rank FROM b)
  SELECT query_id, doc_id, {_SCORES}, has_match, rank FROM r WHERE rank <= 10""")  # fmt: skip
def numeric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a condition on a number put the chunks that meet it before all others."""
    queries = batch(spark, sf_dir).withColumn("query", F.concat("query", F.lit(" with less than 40%")))
    docs = chunks(spark, sf_dir).withColumn("content", F.concat("content", F.lit(" Measured "), (F.col("doc_id") % 100).cast("string"), F.lit("%")))
    return rounded(retrieval.hybrid_search(queries, docs))


_INTENT = f"""CASE WHEN contains(query, '"') OR regexp_matches(query, '\\b\\d+x\\b|v\\d+|\\d+%') OR (high AND (n <= 3 OR NOT {sql_any("lower(query)", classify.CONCEPTUAL)})) THEN 'ExactPhrase'
  WHEN {sql_any("lower(query)", classify.CONCEPTUAL)} AND NOT high THEN 'Conceptual' ELSE 'Mixed' END"""
_ASKED = "(SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'how ' || text WHEN 1 THEN 'the 4x ' || text ELSE text END AS text FROM benchmark)"
_INTENTS = f"""qi AS (SELECT q0.query_id, query, len(list_filter(t, lambda x: strlen(x) > 2)) AS n, coalesce(high, false) AS high FROM q0
  LEFT JOIN (SELECT query_id, max(idf2) > 2.5 AS high FROM tq WHERE place <= 3 GROUP BY query_id) USING (query_id)), it AS (SELECT query_id, {_INTENT} AS intent FROM qi)"""


def asked_in_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query batch as conceptual questions, exact phrases and plain ones."""
    asked = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("how "), "query")).when(F.col("query_id") % 3 == 1, F.concat(F.lit("the 4x "), "query"))
    return batch(spark, sf_dir).withColumn("query", F.coalesce(asked, "query"))


@query(f"WITH {_INDEX}, {_INTENTS} SELECT query_id, intent FROM it".replace("FROM benchmark)", f"FROM (SELECT query_id AS item_id, text FROM {_ASKED}))", 1))
def search_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ExactPhrase, Conceptual or Mixed for each query of the batch, by the idf of its leading terms."""
    return retrieval.query_intents(asked_in_kinds(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH {_PAIRS}, {_INTENTS},
  wh AS (SELECT mm.*, CASE intent WHEN 'ExactPhrase' THEN 0.5 * s1 + 0.2 * k1 WHEN 'Conceptual' THEN 0.3 * s1 + 0.2 * k1 ELSE 0.4 * s1 + 0.2 * k1 END AS hybrid FROM mm JOIN it USING (query_id)),
  b AS (SELECT *, CAST(0 AS DOUBLE) AS dense, CASE WHEN {_BIB} THEN hybrid * 0.1 ELSE hybrid END AS score FROM wh),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b)
  SELECT query_id, doc_id, {_SCORES}, false AS has_match, rank FROM r WHERE rank <= 10""".replace("FROM benchmark)", f"FROM (SELECT query_id AS item_id, text FROM {_ASKED}))", 1))  # fmt: skip
def hybrid_search_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the scores follow each query's intent."""
    queries, docs = asked_in_kinds(spark, sf_dir), chunks(spark, sf_dir)
    found = retrieval.hybrid_search(queries, docs, intents=retrieval.query_intents(queries, docs))
    return rounded(found).withColumn("has_match", F.lit(False))


# --- single scores ----------------------------------------------------------------------------------


def sql_plain_bm25(column: str, terms: str) -> str:
    """Sum over the terms of tf * 2.2 / (tf + norm) * 2, where words that contain a term count."""
    parts = []
    for t in terms.split():
        tf = f"len(list_filter({sql_words(column)}, lambda w: contains(lower(w), {q(t.lower())})))"
        parts.append(f"{tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({sql_words(column)}) / 1000)) * 2")
    return "(" + " + ".join(parts) + ")"


per_document(
    "plain_bm25", lambda t: {"score": r6(bm25.plain_bm25(F.lit("tion THE ea"), t))}, f"round({sql_plain_bm25('text', 'tion THE ea')}, 6) AS score"
)

_WEIGHT = f"CASE {_LINE} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in scoring.LINE_WEIGHTS.items()) + " ELSE 0.7 END"


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
  SELECT doc_id, round(sum({_WEIGHT} * {sql_plain_bm25("line", "tion THE")}), 6) AS score FROM l WHERE line <> '' GROUP BY doc_id""")  # fmt: skip
def fielded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", r6(scoring.fielded_bm25(F.lit("tion THE"), F.col("text"))).alias("score"))


_NAMES = ("Business", "Academic", "Legal", "Technical", "General")
_KINDS = ("Business", "Academic", "Mixed", "Legal", "Technical")


@query(f"""WITH d AS (SELECT doc_id, text, (doc_id % 101) / 100 AS a, (doc_id % 67) / 66 AS b, ['{"','".join(_NAMES)}'][doc_id % 5 + 1] AS intent,
    ['{"','".join(_KINDS)}'][doc_id // 5 % 5 + 1] AS category, {" + ".join(sql_count("text", "(?i)" + p) for p in classify.STRONG_LEGAL)} AS hits FROM documents),
  s AS (SELECT *, CASE intent WHEN 'Business' THEN 0.4 WHEN 'Academic' THEN 0.55 WHEN 'Legal' THEN 0.35 ELSE 0.5 END AS share,
    a + CASE WHEN intent = 'Business' AND category = 'Business' THEN 0.25 WHEN intent = 'Academic' AND category = 'Academic' THEN 0.2 WHEN intent = 'Legal' AND category = 'Mixed' THEN 0.15
      WHEN intent = 'Technical' AND category = 'Academic' THEN 0.12 ELSE 0 END
      + CASE WHEN intent <> 'Legal' THEN 0 WHEN hits >= 2 THEN 0.15 WHEN category <> 'Mixed' THEN -0.1 ELSE 0 END AS raw,
    CASE WHEN intent = 'Legal' AND category IN ('Business', 'Academic') THEN 0.75 WHEN intent = 'Business' AND category IN ('Academic', 'Mixed') THEN 0.85
      WHEN intent = 'Academic' AND category IN ('Business', 'Mixed') THEN 0.8 ELSE 99 END AS cap FROM d)
  SELECT doc_id, round(0.3 * a + 0.7 * b, 6) AS linear, round(share * b + (1 - share) * a, 6) AS mixed, round(least(a, cap), 6) AS capped, round(greatest(0, least(raw, cap)), 6) AS boosted FROM s""")  # fmt: skip
def fusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and domain mixes, caps and boosts for every pair of intent and category."""
    names, kinds = (F.array(*map(F.lit, x)) for x in (_NAMES, _KINDS))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.col("doc_id") % 101 / 100.0).alias("a"), (F.col("doc_id") % 67 / 66.0).alias("b"), F.get(names, (F.col("doc_id") % 5).cast("int")).alias("intent"),
        F.get(kinds, (F.floor(F.col("doc_id") / 5) % 5).cast("int")).alias("category"),
    )
    a, b, intent, category = (F.col(c) for c in ("a", "b", "intent", "category"))
    return docs.select(
        "doc_id", r6(scoring.linear_hybrid(a, b, 0.3)).alias("linear"), r6(scoring.domain_hybrid(intent, a, b)).alias("mixed"),
        r6(scoring.type_aware_cap(intent, category, a)).alias("capped"), r6(scoring.intelligent_boost(a, intent, category, F.col("text"))).alias("boosted"),
    )


_QUESTIONS = ("accuracy < 30x", "entre 10% et 50%", "25% compression", "nothing at all", "> 20x")


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 60 AS p, doc_id % 45 AS x FROM documents)
  SELECT doc_id, CASE WHEN k = 3 THEN 'TextAtomic' ELSE 'DigitCombined' END AS query_kind,
    CASE k WHEN 0 THEN x < 30 WHEN 1 THEN p BETWEEN 10 AND 50 WHEN 2 THEN p BETWEEN 24 AND 26 WHEN 4 THEN x > 20 ELSE false END AS has_match FROM d""")  # fmt: skip
def numeric_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of every kind against contents with one percentage and one multiple."""
    asked = F.get(F.array(*map(F.lit, _QUESTIONS)), (F.col("doc_id") % 5).cast("int"))
    content = F.format_string("ratio %d%% at %dx", F.col("doc_id") % 60, F.col("doc_id") % 45)
    return rerank.numeric_rerank(table(spark, sf_dir, "documents").select("doc_id", asked.alias("query"), content.alias("content"))).select("doc_id", "query_kind", "has_match")


_LOW = "lower(text)"
_GENERAL = "which theory about tion"
per_document(
    "query_aware_kinds",
    lambda t: {n: rerank.semantic_score(F.lit(asked), t) for n, asked in (("method", "how does it work"), ("result", "accuracy score"), ("general", _GENERAL))},
    f"CAST(least(1, round(0.2 * {sql_hits(_LOW, rerank.METHOD_MARKERS)} + CASE WHEN contains({_LOW}, 'figure') AND contains({_LOW}, 'architecture') THEN 0.3 ELSE 0 END, 6)) AS DOUBLE) AS method, "
    f"CAST(least(1, round(0.15 * {sql_hits(_LOW, rerank.RESULT_MARKERS)} + CASE WHEN {sql_count(_LOW, '[' + chr(92) + 'p{N}]')} > 3 THEN 0.2 ELSE 0 END, 6)) AS DOUBLE) AS result, "
    f"round({sql_hits(_LOW, _GENERAL.split())} / {len(_GENERAL.split())}, 6) AS general",
)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS content, ['Table', 'Figure Caption', 'Document Text', 'Table Caption'][doc_id % 4 + 1] AS source FROM documents)
  SELECT doc_id, {_DROPPED} AS contaminated, CAST({_PRIOR} AS DOUBLE) AS prior FROM d""")  # fmt: skip
def section_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as chunks of every kind of source; short captions are dropped."""
    source = F.get(F.array(*map(F.lit, ("Table", "Figure Caption", "Document Text", "Table Caption"))), (F.col("doc_id") % 4).cast("int"))
    cut = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), source.alias("source"))
    return cut.select("doc_id", rerank.is_contaminated(F.col("content"), F.col("source")).alias("contaminated"), rerank.section_prior(F.col("content"), F.col("source")).alias("prior"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  SELECT vec_id, round(list_dot_product(e, list_reverse(e)), 6) AS product, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v""")  # fmt: skip
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.dot(e, F.reverse(e))).alias("product"), r6(F.get(vectors.l2_normalize(e), F.lit(0))).alias("first"))


# --- rerankers over top lists -----------------------------------------------------------------------

_MMR_STEP = """list_reduce(list_concat([{'c': [i0], 'n': 0}], list_transform(range(1, least(10, len(docs))), lambda x: {'c': CAST([] AS BIGINT[]), 'n': x})), lambda a, x:
  {'c': list_append(a.c, list_position(list_transform(range(1, len(docs) + 1), lambda i: CASE WHEN list_contains(a.c, i) THEN -1e9
      ELSE round(0.5 * rel[i] + 0.5 * (1 - greatest(0, list_max(list_transform(a.c, lambda j: sims[i][j])))), 9) END),
    list_max(list_transform(range(1, len(docs) + 1), lambda i: CASE WHEN list_contains(a.c, i) THEN -1e9
      ELSE round(0.5 * rel[i] + 0.5 * (1 - greatest(0, list_max(list_transform(a.c, lambda j: sims[i][j])))), 9) END)))), 'n': x.n}).c"""


@query(f"""WITH {_VEC}, u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings),
  p AS (SELECT query_id, list(doc_id ORDER BY doc_id) AS docs, list(score ORDER BY doc_id) AS score, list(d.e ORDER BY doc_id) AS es, list(list_dot_product(d.e, qe.e) ORDER BY doc_id) AS rel
    FROM rk JOIN u d ON d.vec_id = doc_id JOIN u qe ON qe.vec_id = query_id WHERE rank <= 20 GROUP BY query_id),
  s AS (SELECT *, list_transform(es, lambda a: list_transform(es, lambda b: list_dot_product(a, b))) AS sims,
    list_max(list_filter(range(1, len(docs) + 1), lambda i: round(score[i], 12) = round(list_max(score), 12))) AS i0 FROM p),
  m AS (SELECT query_id, docs, {_MMR_STEP} AS chosen FROM s)
  SELECT query_id, docs[chosen[i]] AS doc_id, CAST(i AS INT) AS place FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS i FROM m)""")  # fmt: skip
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, points = vector_tables(spark, sf_dir)
    pool = retrieval.vector_search(queries, points, k=20).join(points.select("doc_id", "embedding"), "doc_id")
    return rerank.mmr(pool.join(queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id"), k=10)


_HITS = f"""{_INDEX}, rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sparse, 9) DESC, doc_id) AS rank FROM sparse),
hits AS (SELECT query_id, query, doc_id, content, sparse AS score, rank FROM rl JOIN d0 USING (doc_id) JOIN q0 USING (query_id) WHERE rank <= 10)"""


def lexical_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best chunks of each query by BM25, with their texts."""
    queries, docs = batch(spark, sf_dir), chunks(spark, sf_dir)
    terms = bm25.query_terms(queries)
    best = stored(scoring.top_k(bm25.best_pairs(terms, bm25.build_index(docs, terms), k), k), "hits")
    return best.join(docs, "doc_id").join(queries, "query_id")


@query(f"""WITH {_HITS}, h AS (SELECT query_id, doc_id, round(score, 9) AS score, rank, list_distinct({sql_words("lower(content)")}) AS w FROM hits),
  l AS (SELECT query_id, list({{'k': [{{'w': w, 'd': doc_id, 's': score}}], 'n': rank}} ORDER BY rank) AS l FROM h GROUP BY query_id),
  c AS (SELECT query_id, list_reduce(l, lambda a, x: {{'k': CASE WHEN len(list_filter(a.k, lambda o: {"{j}"} >= 0.7)) = 0 THEN list_concat(a.k, x.k)
      ELSE list_transform(a.k, lambda o, i: CASE WHEN i = list_position(list_transform(a.k, lambda p: {"{jp}"} >= 0.7), true) AND x.k[1].s > o.s THEN x.k[1] ELSE o END) END, 'n': x.n}}).k AS kept FROM l),
  e AS (SELECT query_id, unnest(kept) AS o, generate_subscripts(kept, 1) AS i FROM c)
  SELECT query_id, o.d AS doc_id, round(o.s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o.s DESC, i) AS INT) AS place FROM e"""
  .replace("{j}", "(len(list_intersect(o.w, x.k[1].w)) / (len(o.w) + len(x.k[1].w) - len(list_intersect(o.w, x.k[1].w))))")
  .replace("{jp}", "(len(list_intersect(p.w, x.k[1].w)) / (len(p.w) + len(x.k[1].w) - len(list_intersect(p.w, x.k[1].w))))"))
def near_duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.collapse_near_duplicates(lexical_hits(spark, sf_dir)).withColumn("score", r6(F.col("score")))


# --- answers and contexts ---------------------------------------------------------------------------

_LABELLED = f"""WITH {_PAIRS}, b AS (SELECT *, CASE WHEN {_BIB} THEN hybrid * 0.1 ELSE hybrid END AS score FROM hy),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b)"""


def best_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    return retrieval.hybrid_search(batch(spark, sf_dir), docs, k=5).join(docs, "doc_id")


@query(f"""{_LABELLED} SELECT query_id, string_agg('### Source ' || rank || ' - document ' || doc_id || ' (Page ?, Confidence: ' || CAST(round(score * 100) AS INT) || '%)' || chr(10)
    || CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INT) AS sources
  FROM r WHERE rank <= 5 GROUP BY query_id""")  # fmt: skip
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("label")
    return retrieval.answer_context(best_five(spark, sf_dir).select("query_id", "rank", "score", "content", label, F.lit(None).cast("int").alias("page")))


@query(f"""{_LABELLED}, k AS ({_CONFIDENCES}), g AS (SELECT query_id, query, rank, '### [Source ' || rank || '] Score: ' || printf('%.2f', score * 100) || '%' || chr(10)
    || CASE WHEN doc_id % 2 = 0 THEN 'Fichier: doc' || doc_id || '.md' || chr(10) ELSE '' END || 'Catégorie: ' || category || chr(10) || chr(10) || 'Contenu:' || chr(10) || '```' || chr(10) || content
    || chr(10) || '```' || chr(10) || chr(10) AS block, CASE WHEN strlen(content) > 300 THEN left(content, 300) || '...' ELSE content END AS preview FROM r JOIN k USING (doc_id) WHERE rank <= 5)
  SELECT query_id, '# Contexte depuis la base de connaissances' || chr(10) || chr(10) || 'Requête: ' || any_value(query) || chr(10) || chr(10) || '## Documents pertinents (' || count(*) || ' résultats)' || chr(10) || chr(10)
    || string_agg(block, '' ORDER BY rank) || chr(10) || '---' || chr(10) || chr(10) AS context, string_agg(preview, '|' ORDER BY rank) AS previews FROM g GROUP BY query_id""")  # fmt: skip
def knowledge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    rows = best_five(spark, sf_dir).join(batch(spark, sf_dir), "query_id").withColumns({"source_file": file, "category": classify.category(F.col("content"))})
    return answers.knowledge_context(rows).withColumn("previews", F.array_join("previews", "|"))


_FORMS = ("", "résume ", "explique ", "quels ")


def _sql_answer() -> str:
    def bullets(items: str) -> str:
        return f"list_reduce(list_concat([''], list_transform({items}, lambda h: '• ' || {sql_condense('h.c', 200)} || chr(10) || chr(10))), lambda a, x: a || x)"

    def listed(items: str, of: str) -> str:
        return f"list_reduce(list_concat([''], list_transform({items}, lambda h, i: CAST(i AS VARCHAR) || '. ' || {of} || chr(10) || chr(10))), lambda a, x: a || x)"

    two = "chr(10) || chr(10)"
    points = sql_sentences("array_to_string(list_transform(g, lambda h: h.c), ' ')", 4)
    bodies = {
        1: f"CASE WHEN len({points}) > 0 THEN {listed(points, 'h')} ELSE {bullets('g[1:3]')} END",
        2: f"{sql_condense('g[1].c', 400)} || {two} || CASE WHEN len(g) > 1 THEN '**Informations complémentaires :**' || {two} || {bullets('g[2:3]')} ELSE '' END",
        3: listed("g", sql_condense("h.c", 250)),
        0: f"{sql_condense('g[1].c', 350)} || {two} || CASE WHEN len(list_filter(g[2:], lambda h: h.s > 0.5)) > 0 THEN '**Détails supplémentaires :**' || {two} || {bullets('list_filter(g[2:], lambda h: h.s > 0.5)[1:2]')} ELSE '' END",
    }
    heads = {k: answers.HEADINGS[n].strip() for k, n in ((1, "summary"), (2, "explanation"), (3, "list"), (0, "general"))}
    body = "CASE k " + " ".join(f"WHEN {k} THEN '{heads[k]}' || {two} || {b}" for k, b in bodies.items()) + " END"
    mean = "(list_sum(list_transform(g, lambda h: h.s)) / len(g))"
    footer = f"chr(10) || '*Réponse générée à partir de ' || len(g) || ' sections du document (confiance: ' || CASE WHEN {mean} > 0.7 THEN 'haute' WHEN {mean} > 0.5 THEN 'moyenne' ELSE 'modérée' END || ')*'"
    return f"""WITH {_HITS}, t AS (SELECT query_id, query_id % 4 AS k, list_filter(list({{'c': content, 's': score / 20}} ORDER BY rank), lambda h: h.s > 0.3) AS g FROM hits WHERE rank <= 5 GROUP BY query_id)
  SELECT query_id, ['general', 'summary', 'explanation', 'list'][k + 1] AS form, CASE WHEN len(g) = 0 THEN '{answers.TOO_WEAK}' ELSE {body} || {footer} END AS answer, CAST(len(g) AS INT) AS sources FROM t"""


@query(_sql_answer())
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every form: the query batch asked in four ways, scores scaled to about one."""
    asked = F.concat(F.get(F.array(*map(F.lit, _FORMS)), (F.col("query_id") % 4).cast("int")), F.col("query"))
    return answers.extractive_answer(lexical_hits(spark, sf_dir).withColumns({"query": asked, "score": F.col("score") / 20}))


@query(f"""WITH {_HITS}, k AS ({_CONFIDENCES}) SELECT query_id, doc_id, round(score, 6) AS score, rank, CAST(doc_id AS VARCHAR) AS document_id, CAST(0.85 AS DOUBLE) AS confidence, category
  FROM hits JOIN k USING (doc_id) WHERE category IN ('Business', 'Academic', 'Legal', 'Technical', 'Mixed')""")  # fmt: skip
def hits_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical_hits(spark, sf_dir).withColumns({"document_id": F.col("doc_id").cast("string"), "confidence": F.lit(None).cast("double")})
    found = retrieval.hit_metadata(rows, categories=["Business", "Academic", "Legal", "Technical", "Mixed"])
    return found.select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"), "document_id", "confidence", "category")


_INTENTIONS = {n: f"round({' + '.join(f'CAST(regexp_matches(query, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}) AS INT)' for p in ps)}, 0)" for n, ps in classify.USER_INTENTIONS.items()}
_SHARES = {n: f"round(({c}) / 2 * 0.8 + ({c}) / greatest(len({sql_words('query')}), 1) * 0.2, 6)" for n, c in _INTENTIONS.items()}
_BEST = "greatest(" + ", ".join(_SHARES.values()) + ")"


@query(f"""WITH b AS (SELECT item_id AS query_id, ['résume les points clés ', 'trouve des sources ', 'explique le sens ', ''][item_id % 4 + 1] || text AS query, '' AS text FROM benchmark)
  SELECT query_id, CASE WHEN {_TOP} = 0 THEN 'General' {" ".join(f"WHEN {h} = {_TOP} THEN '{n}'" for n, h in _DOMAIN.items())} END AS domain,
    CASE WHEN {_BEST} = 0 THEN 'General' {" ".join(f"WHEN {s} = {_BEST} THEN '{n}'" for n, s in _SHARES.items())} END AS intention,
    CAST(CASE WHEN {_BEST} = 0 THEN 0.5 ELSE least(1, {_BEST}) END AS DOUBLE) AS confidence,
    CASE WHEN {sql_any("lower(query)", rerank.GOAL_QUERY)} THEN 'Goal' WHEN {sql_any("lower(query)", rerank.METHOD_QUERY)} THEN 'Method' WHEN {sql_any("lower(query)", rerank.RESULT_QUERY)} THEN 'Result' ELSE 'General' END AS question
  FROM b""".replace("lower(text)", "lower(query)"))  # fmt: skip
def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains, intentions and kinds of questions of the query batch."""
    starts = F.array(*map(F.lit, ("résume les points clés ", "trouve des sources ", "explique le sens ", "")))
    asked = batch(spark, sf_dir).select("query_id", F.concat(F.get(starts, (F.col("query_id") % 4).cast("int")), "query").alias("query"))
    t = F.col("query")
    said = asked.select("query_id", classify.domain_intent(t).alias("domain"), classify.user_intention(t).alias("i"), rerank.question_type(t).alias("question"))
    return said.select("query_id", "domain", "i.intention", "i.confidence", "question")


# --- fielded search and approximate search ----------------------------------------------------------


@query(f"""WITH {_INDEX}, {_DENSE}, k AS ({_CONFIDENCES}),
  ln AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls), ' ') AS line FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM d0)),
  lw AS (SELECT doc_id, i, {_WEIGHT} AS weight, {sql_words("lower(line)")} AS ws FROM ln WHERE line <> ''),
  wd AS (SELECT doc_id, i, weight, len(ws) AS n, unnest(ws) AS word FROM lw),
  qf AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({sql_words("lower(query)")}) AS token FROM q0) GROUP BY ALL),
  wt AS (SELECT token, word FROM (SELECT DISTINCT token FROM qf) JOIN (SELECT DISTINCT word FROM wd) ON contains(word, token)),
  ct AS (SELECT doc_id, i, weight, n, token, count(*) AS tf FROM wd JOIN wt USING (word) GROUP BY ALL),
  fs AS (SELECT query_id, doc_id, sum(qtf * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1000)) * 2) AS fielded FROM ct JOIN qf USING (token) GROUP BY ALL),
  al AS (SELECT query_id, query, doc_id, content, coalesce(dense, 0) AS dense, coalesce(fielded, 0) AS fielded FROM q0 CROSS JOIN d0 LEFT JOIN dense USING (query_id, doc_id) LEFT JOIN fs USING (query_id, doc_id)),
  sc AS (SELECT *, (dense - min(dense) OVER w) / greatest(max(dense) OVER w - min(dense) OVER w, 1e-6) AS c1, (fielded - min(fielded) OVER w) / greatest(max(fielded) OVER w - min(fielded) OVER w, 1e-6) AS f1 FROM al WINDOW w AS (PARTITION BY query_id)),
  qd AS (SELECT query_id, CASE WHEN {_TOP} = 0 THEN 'General' {" ".join(f"WHEN {h} = {_TOP} THEN '{n}'" for n, h in _DOMAIN.items())} END AS intent FROM (SELECT query_id, query AS text FROM q0)),
  lg AS (SELECT doc_id, {" + ".join(sql_count("content", "(?i)" + p) for p in classify.STRONG_LEGAL)} AS hits FROM d0),
  mx AS (SELECT *, CASE intent WHEN 'Business' THEN 0.4 WHEN 'Academic' THEN 0.55 WHEN 'Legal' THEN 0.35 ELSE 0.5 END AS share FROM sc JOIN qd USING (query_id) JOIN k USING (doc_id) JOIN lg USING (doc_id)),
  bo AS (SELECT *, share * c1 + (1 - share) * f1 + CASE WHEN intent = 'Business' AND category = 'Business' THEN 0.25 WHEN intent = 'Academic' AND category = 'Academic' THEN 0.2 WHEN intent = 'Legal' AND category = 'Mixed' THEN 0.15
      WHEN intent = 'Technical' AND category = 'Academic' THEN 0.12 ELSE 0 END + CASE WHEN intent <> 'Legal' THEN 0 WHEN hits >= 2 THEN 0.15 WHEN category <> 'Mixed' THEN -0.1 ELSE 0 END AS raw,
    CASE WHEN intent = 'Legal' AND category IN ('Business', 'Academic') THEN 0.75 WHEN intent = 'Business' AND category IN ('Academic', 'Mixed') THEN 0.85 WHEN intent = 'Academic' AND category IN ('Business', 'Mixed') THEN 0.8 ELSE 99 END AS cap FROM mx),
  fin AS (SELECT *, greatest(0.0, least(raw, cap)) AS score FROM bo), rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fin)
  SELECT query_id, doc_id, intent, category, round(round(score, 9), 6) AS score, rank FROM rf WHERE rank <= 10""")  # fmt: skip
def fielded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = embedded(spark, sf_dir)
    found = search_engine.search(queries, docs)
    return found.select("query_id", "doc_id", "intent", "category", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, points = vector_tables(spark, sf_dir)
    book = ann.fit_codebook(points)
    return ann.approximate_search(queries, points, stored(ann.encode(points, book), "codes"), book)


@query()
def approximate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of coded vectors, of which each query compares fifty exactly."""
    return approximate(spark, sf_dir).select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def approximate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of these hits at ten for each query of the query set, against exact search."""
    return retrieval.recall(approximate(spark, sf_dir), retrieval.vector_search(*vector_tables(spark, sf_dir)), 10)
