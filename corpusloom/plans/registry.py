"""What the modules of queries share: the register, the tables, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def per_document(name: str, columns: Callable[[Column], dict[str, Column]], sql: str | None = None) -> None:
    """A query of scalar functions of the text of every document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = columns(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in own.items()])

    run.__name__ = name
    query(f"SELECT doc_id, {sql} FROM documents" if sql else None)(run)


# --- SQL pieces -------------------------------------------------------------------------------------


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {q(pattern)}))"


def sql_hits(column: str, pieces) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {q(p)}) AS INT)" for p in pieces) + ")"


def sql_any(column: str, pieces) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in pieces) + ")"


def sql_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda x: x <> '')"


def sql_tokens(column: str) -> str:
    bare = f"list_transform({sql_words(f'lower({column})')}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
    return f"list_filter({bare}, lambda x: x <> '')"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def sql_sentences(column: str, n: int) -> str:
    long = f"list_filter(regexp_split_to_array({column}, '[.!?]'), lambda s: strlen(s) > 30 AND trim(s, ' ') <> '')"
    return f"list_transform(list_slice({long}, 1, {n}), lambda s: {sql_strip('s')})"


def sql_condense(column: str, n: int) -> str:
    bare = sql_strip(column)
    head = f"left({bare}, {n})"
    stop, space = (f"(length({head}) - strpos(reverse({head}), '{c}') + 1)" for c in ". ")
    return f"""CASE WHEN length({bare}) <= {n} THEN {bare} WHEN contains({head}, '.') AND {stop} - 1 > {n // 2} THEN left({head}, {stop})
      WHEN contains({head}, ' ') THEN left({head}, {space} - 1) || '...' ELSE {head} || '...' END"""


def sql_tail(column: str, n: int) -> str:
    """The last words of a text, joined by spaces."""
    return f"array_to_string(list_slice({sql_words(column)}, greatest(len({sql_words(column)}) - {n} + 1, 1), len({sql_words(column)})), ' ')"


def sql_pairs(tokens: str) -> str:
    return f"list_concat({tokens}, list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || '_' || {tokens}[i + 1]))"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query set of a search is every vector whose id is divisible by 20, against all."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return points.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), points
