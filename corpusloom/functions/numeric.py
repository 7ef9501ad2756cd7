"""Numbers with units in queries and chunks: kinds of query, constraints, values, and whether they meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, word_count

# Fixed values.
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
TIMES = r"(\d+(?:\.\d+)?)\s*[x×X]"
COMPARING = r"(?iu)(inférieur|supérieur|moins|plus|greater|less|between|entre|<|>|≤|≥)"
SYMBOLIC = r"([<>≤≥])\s*(\d+(?:\.\d+)?)\s*([x×X%])"
RANGE = r"(?i)(entre|between)\s+(\d+(?:\.\d+)?)[x×X%]?\s+(et|and)\s+(\d+(?:\.\d+)?)\s*([x×X%])"
CONCEPTS = (
    "compression", "précision", "accuracy", "precision", "performance", "taux", "ratio", "rate", "level", "niveau", "résultat", "result",
    "tokens", "quality", "qualité", "décodage", "decoding",
)
VALUE = "struct<value: double, unit: string>"
CONSTRAINT = "struct<op: string, low: double, high: double, unit: string>"


def query_kind(query: Column) -> Column:
    """DigitAtomic, DigitCombined, TextCombined or TextAtomic."""
    numeric = F.rlike(query, F.lit(PERCENT)) | F.rlike(query, F.lit(TIMES))
    compared, concept = F.rlike(query, F.lit(COMPARING)), any_of(F.lower(query), CONCEPTS)
    return (
        F.when(numeric & (compared | concept), "DigitCombined")
        .when(numeric, "DigitAtomic")
        .when(concept & (word_count(query) > 5), "TextCombined")
        .otherwise("TextAtomic")
    )


def values(text: Column) -> Column:
    """All percentages, then all multiples, in order: ``array<struct<value, unit>>``."""

    def of(pattern: str, unit: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda v: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit")))

    return F.concat(of(PERCENT, "%"), of(TIMES, "x"))


def _unit(symbol: Column) -> Column:
    return F.when(symbol == "%", "%").otherwise("x")


def _constraint(op: str | Column, low: Column, high: Column, unit: Column) -> Column:
    name = F.lit(op) if isinstance(op, str) else op
    return F.struct(name.alias("op"), low.cast("double").alias("low"), high.cast("double").alias("high"), unit.alias("unit"))


def constraints(query: Column) -> Column:
    """``array<struct<op, low, high, unit>>``: symbols, words, ranges; a plain value only if there is no other."""
    none = F.expr(f"cast(array() as array<{CONSTRAINT}>)")
    first = F.get(values(query), F.lit(0))

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(query, pattern, n)

    sign, number = group(SYMBOLIC, 1), group(SYMBOLIC, 2)
    by_sign = _constraint(F.when(sign.isin("<", "≤"), "less").otherwise("greater"), F.nullif(number, F.lit("")), F.nullif(number, F.lit("")), _unit(group(SYMBOLIC, 3)))
    symbolic = F.when(sign != "", F.array(by_sign)).otherwise(none)
    low = F.lower(query)
    word = F.when(any_of(low, ["inférieur", "less"]), "less").when(any_of(low, ["supérieur", "greater"]), "greater")
    worded = F.when(word.isNotNull() & first.isNotNull(), F.array(_constraint(word, first["value"], first["value"], first["unit"]))).otherwise(none)
    between = _constraint("between", F.nullif(group(RANGE, 2), F.lit("")), F.nullif(group(RANGE, 4), F.lit("")), _unit(group(RANGE, 5)))
    ranged = F.when(group(RANGE, 1) != "", F.array(between)).otherwise(none)
    stated = F.concat(symbolic, worded, ranged)
    plain = F.when(first.isNotNull(), F.array(_constraint("exact", first["value"], first["value"], first["unit"]))).otherwise(none)
    return F.when(F.size(stated) > 0, stated).otherwise(plain)


def meets(value: Column, constraint: Column) -> Column:
    v, low, high = value["value"], constraint["low"], constraint["high"]
    close = F.round(F.abs(v - low) / F.greatest(low, F.lit(1.0)), 6) < 0.05
    return (value["unit"] == constraint["unit"]) & (
        F.when(constraint["op"] == "exact", close)
        .when(constraint["op"] == "less", v < low)
        .when(constraint["op"] == "greater", v > low)
        .otherwise((v >= low) & (v <= high))
    )


def has_match(content: Column, wanted: Column) -> Column:
    """Whether any value of the content meets any of the constraints."""
    return F.exists(values(content), lambda v: F.exists(wanted, lambda c: meets(v, c)))


def placed_values(text: Column) -> Column:
    """The same with the characters before each: ``array<struct<value, unit, at>>``."""

    def of(pattern: str, unit: str) -> Column:
        gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

        def before(k: Column) -> Column:
            sized = F.transform(F.slice(gaps, F.lit(1), k + 1), lambda g: F.length(g))
            told = F.transform(F.slice(whole, F.lit(1), k), lambda w: F.length(w))
            return F.aggregate(F.concat(sized, told), F.lit(0), lambda a, n: a + n)

        return F.transform(number, lambda v, k: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), before(k).alias("at")))

    return F.concat(of(PERCENT, "%"), of(TIMES, "x"))
