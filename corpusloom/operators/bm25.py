"""BM25 over words and word pairs, and the keyword boosts, for many queries at once.

The index is one stored table made in one pass over the texts, with a row for each document: its
length, the counts of the wanted terms, and the wanted terms that lie inside its words. Postings and
frequencies are read from it, and all scores of a document with all queries are sums within its row,
so nothing is exchanged but the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import bare_tokens, term_tokens, with_bigrams
from ..storage import checkpointed, stored
from . import pair_blocks, term_batches

K1, B = 1.2, 0.75


#: Query terms up to which they are sent to every task; beyond it they meet the texts' terms by a shuffle.
SENT_TERMS = 1_000_000


@dataclass(frozen=True)
class Index:
    """``lengths (doc_id, dl)``, ``postings (doc_id, dl, term, tf, uf)``, ``frequencies (term, df, du)``, rows and mean length.

    ``uf`` and ``du`` count a term as a word only, ``tf`` and ``df`` as a word or a pair. Of up to
    ``SENT_TERMS`` wanted terms ``held`` has a row for each document (:func:`term_batches.counted`), with
    terms by their places in ``terms``.
    """

    lengths: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    rows: int
    mean_length: float
    held: DataFrame | None = None
    terms: tuple[str, ...] = ()


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` from ``queries (query_id, query)``; words and pairs."""
    bare = queries.select("query_id", bare_tokens(F.coalesce("query", F.lit(""))).alias("bare"))
    terms = bare.select("query_id", F.explode(with_bigrams(F.col("bare"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def build_index(docs: DataFrame, wanted: DataFrame | None = None, inside: bool = False, keep: dict[str, Column] | None = None) -> Index:
    """From ``docs (doc_id, content)``; with ``wanted (term)`` postings hold these terms only, and with ``inside`` the terms in words too.

    Rows of equal ids are documents of their own. Nothing is exchanged for wanted terms up to
    ``SENT_TERMS``, which are counted where the texts lie; then ``held`` has the columns of ``keep`` too.
    """
    if wanted is not None:
        named = checkpointed(wanted.select(F.col("term").alias("w")).distinct())
        if named.count() <= SENT_TERMS:
            return _index_of_sent(docs, sorted(r.w for r in named.collect()), inside, keep or {})
    # the words are a column of their own, so that they are computed once and not wherever pairs name them
    bare = docs.select("doc_id", bare_tokens(F.coalesce("content", F.lit(""))).alias("bare"))
    size = F.size("bare")
    tokens = bare.select("doc_id", size.alias("words"), (2 * size - F.least(size, F.lit(1))).alias("dl"), F.array_append(with_bigrams(F.col("bare")), F.lit(None)).alias("tokens"))
    # the outer form: for the inner one a filter on the array's size is inferred, for which all tokens would be made twice
    terms = tokens.select("doc_id", "dl", "words", F.posexplode_outer("tokens").alias("at", "term"))
    if wanted is not None:
        terms = terms.join(named, F.col("term") == F.col("w"), "left").where("term is null or w is not null")
    counted = terms.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"), F.count_if(F.col("at") < F.col("words")).alias("uf"))
    held = stored(counted, "postings")
    lengths, postings = held.where("term is null").select("doc_id", "dl", "tf"), held.where("term is not null")
    # equal ids share one row, so a row stands for as many documents as it has been counted
    stats = lengths.agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("mean")).first()
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("uf") > 0).alias("du"))
    return Index(lengths.drop("tf"), postings, frequencies, stats.n or 0, stats.mean or 0.0)


def _index_of_sent(docs: DataFrame, terms: list[str], inside: bool, keep: dict[str, Column]) -> Index:
    spark = docs.sparkSession
    content = F.coalesce("content", F.lit(""))
    # shorter terms are no boost tokens
    searched = [n for n, t in enumerate(terms) if len(t.encode()) >= 3] if inside else []
    rows = docs.select("doc_id", bare_tokens(content).alias("bare"), (F.lower(content) if inside else F.lit("")).alias("low"), *[c.alias(n) for n, c in keep.items()])
    held = stored(term_batches.counted(rows, terms, searched), "postings")
    stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    names = F.broadcast(spark.createDataFrame([(n, t) for n, t in enumerate(terms)], "place int, term string"))
    listed = held.select("doc_id", "dl", F.inline(F.arrays_zip("at", "tf", "uf")))
    postings = listed.join(names, F.col("at") == F.col("place")).select("doc_id", "dl", "term", F.col("tf").cast("long").alias("tf"), F.col("uf").cast("long").alias("uf"))
    counts = listed.groupBy("at").agg(F.count("*").alias("df"), F.count_if(F.col("uf") > 0).alias("du"))
    frequencies = checkpointed(counts.join(names, F.col("at") == F.col("place")).select("term", "df", "du"))
    return Index(held.select("doc_id", "dl"), postings, frequencies, stats.n, stats.mean or 0.0, held, tuple(terms))


def idf(rows: int, df):
    return F.log((rows - df + 0.5) / (df + 0.5) + 1.0)


def bm25(terms: DataFrame, index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, sparse`` for pairs that share a term; a term that a query repeats counts as often."""
    if index.held is not None and (asked := _sent(terms)) is not None:
        return pair_scores(asked, index, k1=k1, b=b).select("query_id", "doc_id", "sparse")
    norm = 1.0 - b + b * F.col("dl") / max(index.mean_length, 1e-9)
    # a posting's weight is computed once, not for every query that has its term
    weight = idf(index.rows, F.col("df")) * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)
    weighed = index.postings.join(index.frequencies, "term").select("term", "doc_id", weight.alias("weight"))
    return weighed.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("sparse"))


def _sent(terms: DataFrame) -> DataFrame | None:
    """The terms, if they are few enough to be sent to every task."""
    terms = checkpointed(terms)
    return terms if terms.count() <= SENT_TERMS else None


def scorer(terms: DataFrame, index: Index, top: DataFrame | None = None, embeddings: DataFrame | None = None, ids: list | None = None, k1: float = K1, b: float = B) -> pair_blocks.Scorer:
    """The queries of ``terms (query_id, term, qtf)``, or ``ids``, for the rows of an index that holds their terms.

    There are at most ``SENT_TERMS`` terms. ``top`` are the :func:`technical_terms`, for an index with
    the terms inside words; ``embeddings (query_id, embedding)`` are for an index that keeps ``embedding``.
    """
    rows, place = terms.collect(), {t: n for n, t in enumerate(index.terms)}
    ids = sorted({r.query_id for r in rows}) if ids is None else ids
    at, size = {q: n for n, q in enumerate(ids)}, len(index.terms)
    weights = np.zeros(size)
    counts = {r.term: r.df for r in index.frequencies.collect()}  # of the wanted terms
    for t, df in counts.items():
        weights[place[t]] = np.log((index.rows - df + 0.5) / (df + 0.5) + 1.0)
    known = sorted((place[r.term], at[r.query_id], r.qtf) for r in rows if r.term in counts)
    boosts = unit = None
    if top is not None:
        long = [(t, q, n * min(weights[t] / 5.0, 0.2), n * (weights[t] > 2.0)) for t, q, n in known if len(index.terms[t].encode()) >= 3]
        named = sorted((place[r.term], at[r.query_id], r.place, min(r.idf / 5.0, 0.2)) for r in top.collect())  # a few a query
        boosts = pair_blocks.Lookup(size, long, 2), pair_blocks.Lookup(size, [(t, q, v) for t, q, _, v in named], 1)
    if embeddings is not None:
        held = {r.query_id: r.embedding for r in embeddings.collect()}  # of the queries of the block
        unit = vectors._unit(pa.array([held.get(q) for q in ids], pa.list_(pa.float64())))
    return pair_blocks.Scorer(ids, weights, max(index.mean_length, 1e-9), pair_blocks.Lookup(size, known, 1), boosts, unit, k1, b)


def pair_scores(terms: DataFrame, index: Index, top: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, sparse, keyword, technical`` for the pairs with any of these scores, each document's within its row of the index.

    The arguments are those of :func:`scorer`; the technical boost is what it adds before the cap.
    """
    sent = index.held.sparkSession.sparkContext.broadcast(scorer(terms, index, top, k1=k1, b=b))
    names, kind = ["sparse", "keyword", "technical"], terms.select("query_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = sent.value
        asked = own.names(to_arrow_type(kind[0].dataType))
        for batch in batches if own.ids else ():
            for part in own.parts(batch):
                met, scores = own(part)
                d, q = np.nonzero(met)
                columns = [asked.take(pa.array(q)), part.column(0).take(pa.array(d)), *(pa.array(scores[n][d, q]) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", *names])

    rows = index.held.select("doc_id", "dl", "at", "tf", "inside")
    return rows.mapInArrow(run, f"query_id {kind[0].dataType.simpleString()}, doc_id long, sparse double, keyword double, technical double")


def best_pairs(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, doc_id, score``: pairs of :func:`bm25` among which are the ``k`` best of each query, ties by id.

    Each task keeps the best of its documents, so a query has no more rows than tasks times ``k``.
    """
    if index.held is None or (asked := _sent(terms)) is None:
        return bm25(terms, index).withColumnRenamed("sparse", "score")
    sent = index.held.sparkSession.sparkContext.broadcast(scorer(asked, index))
    kind = terms.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = sent.value
        best = pair_blocks.Best(len(own.ids), k)
        for batch in batches if own.ids else ():
            for part in own.parts(batch):
                met, scores = own(part)
                d, q = np.nonzero(met)
                best.add(q, pair_blocks.doc_ids(part.column(0))[d], scores["sparse"][d, q])
        yield pa.RecordBatch.from_arrays(best.columns(own.names(to_arrow_type(kind))), names=["query_id", "doc_id", "score"])

    rows = index.held.select("doc_id", "dl", "at", "tf", "inside")
    return rows.mapInArrow(run, f"query_id {kind.simpleString()}, doc_id long, score double")


def words_containing(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, word`` for the distinct words of ``vocabulary (word)`` that hold a token anywhere.

    Up to ``SENT_TERMS`` tokens are sent to where the words lie, as an automaton; more meet the words by
    their three-character pieces.
    """
    wanted = checkpointed(tokens.select("token").distinct())
    if wanted.count() <= SENT_TERMS:
        held = vocabulary.select(F.col("word").alias("key"), F.col("word").alias("low"))
        return term_batches.found_inside(held, [r.token for r in wanted.collect()]).select(F.col("term").alias("token"), F.col("key").alias("word"))
    long = wanted.where(F.length("token") >= 3).select("token", F.substring("token", 1, 3).alias("piece"))
    short = wanted.where(F.length("token") < 3)
    size = F.length("word")
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring("word", i, F.lit(3))))
    found = vocabulary.select("word", F.explode_outer(pieces).alias("piece")).join(long, "piece").where(F.contains("word", "token")).select("token", "word")
    if not short.isEmpty():
        # tokens of fewer characters: from all short pieces of the words
        ends = F.array_distinct(
            F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.array(F.substring("word", i, F.lit(1)), F.substring("word", i, F.lit(2)))))
        )
        found = found.unionByName(vocabulary.select("word", F.explode_outer(ends).alias("token")).join(short, "token", "left_semi").select("token", "word"))
    return found.distinct()


def containing(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """``token, doc_id`` for tokens that lie anywhere in the lower-case content; tokens have no white space.

    Few tokens are found where the texts lie. Of more, distinct words are matched and verified, and only
    the words found are joined with documents.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    wanted = checkpointed(tokens.select("token").distinct())
    if wanted.count() <= SENT_TERMS:
        found = term_batches.found_inside(docs.select(F.col("doc_id").alias("key"), low.alias("low")), [r.token for r in wanted.collect()])
        return found.select(F.col("term").alias("token"), F.col("key").alias("doc_id"))
    placed = docs.select("doc_id", F.explode_outer(F.array_distinct(F.split(low, r"(?U)\s+"))).alias("word")).where("word <> ''")
    found = words_containing(wanted, placed.select("word").distinct())
    return found.join(placed, "word").select("token", "doc_id").repartition("doc_id").distinct()


def boost_tokens(terms: DataFrame, index: Index) -> DataFrame:
    """``query_id, token, qtf, idf``: the query terms of three bytes or more that any document has."""
    return terms.where(F.octet_length("term") >= 3).join(index.frequencies, "term").select(
        "query_id", F.col("term").alias("token"), "qtf", idf(index.rows, F.col("df")).alias("idf")
    )


def keyword_boost(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, doc_id, keyword``: rare query terms that lie anywhere in the content, at most 1.

    From :func:`boost_tokens` and :func:`containing`. A term gives a fifth of its idf, at most 0.2; two
    terms of an idf over 2 give 0.2 more.
    """
    total = F.sum(F.col("qtf") * F.least(F.col("idf") / 5.0, F.lit(0.2)))
    rare = F.sum(F.when(F.col("idf") > 2.0, F.col("qtf")).otherwise(0))
    boost = F.least(total + F.when(rare >= 2, 0.2).otherwise(0.0), F.lit(1.0))
    return tokens.join(found, "token").groupBy("query_id", "doc_id").agg(boost.alias("keyword"))


def term_idf(docs: DataFrame) -> DataFrame:
    """``term, df, idf``: ln(rows / df + 1) over terms of more than two bytes."""
    rows = docs.count()
    terms = docs.select(F.explode_outer(F.array_distinct(term_tokens(F.coalesce("content", F.lit(""))))).alias("term")).where("term is not null")
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(rows) / F.col("df") + 1.0))


def index_idf(index: Index) -> DataFrame:
    """The same for the terms of an index, from its frequencies of words."""
    words = index.frequencies.where((F.col("du") > 0) & (F.octet_length("term") > 2))
    return words.select("term", F.col("du").alias("df"), F.log(F.lit(index.rows) / F.col("du") + 1.0).alias("idf"))


def technical_terms(queries: DataFrame, idfs: DataFrame, k: int) -> DataFrame:
    """``query_id, term, idf, place``: the query's known terms of the highest idf; repeated ones stay; ties by place in the query."""
    from pyspark.sql import Window

    placed = queries.select("query_id", F.posexplode(term_tokens(F.coalesce("query", F.lit("")))).alias("at", "term"))
    order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "at")
    return placed.join(idfs.select("term", "idf"), "term").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "term", "idf", "place")


def technical_boost(top: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, doc_id, technical``: what the :func:`technical_terms` that lie in the content add, before the cap."""
    named = top.withColumnRenamed("term", "token")
    return named.join(found, "token").groupBy("query_id", "doc_id").agg(F.sum(F.least(F.col("idf") / 5.0, F.lit(0.2))).alias("technical"))


def boosts(queries: DataFrame, terms: DataFrame, index: Index, docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The keyword and the technical boosts by joins, for which the texts are searched once for all tokens of both."""
    usable, top = boost_tokens(terms, index), technical_terms(queries, index_idf(index), k)
    wanted = usable.select("token").unionByName(top.select(F.col("term").alias("token")))
    found = stored(containing(wanted, docs), "containing")
    return keyword_boost(usable, found), technical_boost(top, found)


def plain_bm25(query, content):
    """The single-document form: words that contain a query word, mean length 1000, idf 2."""
    words = F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    terms = F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    norm = K1 * (1.0 - B + B * F.size(words) / 1000.0)

    def part(t):
        tf = F.size(F.filter(words, lambda w: F.contains(F.lower(w), F.lower(t)))).cast("double")
        return tf * (K1 + 1.0) / (tf + norm) * 2.0

    return F.aggregate(F.transform(terms, part), F.lit(0.0), lambda a, v: a + v)
