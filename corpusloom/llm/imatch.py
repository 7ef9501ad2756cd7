"""I-Match fingerprints over a lexicon chosen by inverse document frequency, with Spark expressions only.

Terms are the distinct words of the lower-case text. The lexicon holds the terms whose document
frequency lies in a band of shares of all documents: a term needs a least share, so there are at
most (mean distinct terms of a document) / (least share) of them, whatever the number of documents.
That bound is what lets the lexicon travel to every task as one literal, as buckets of a hash table.
A longer lexicon, which only very long documents can give, meets the terms of the texts by a join.
A document's lexicon terms are sorted and hashed once over the whole lexicon and once over each of
several randomised subsets of it, at three rates, so that short and long documents have subsets
with few of their terms.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

#: Shares of all documents in which a term of the lexicon occurs, least and most.
LEAST_SHARE, MOST_SHARE = 0.002, 0.02
#: One in so many terms is in a subset, and how many subsets there are of each rate (powers of two).
RATES = (8, 32, 128)
SUBSETS = 8
#: Buckets of the lexicon's hash table.
BUCKETS = 1 << 13
#: Rows of a range of ids that is sorted at once, about, and ranges into which a range is cut at a time.
RANGE_ROWS, CUTS = 1_000, 64
#: Ranges whose order is found in one task.
NEAR_RANGES = 1 << 12
#: Terms of a lexicon that travels to every task; beyond it the lexicon is joined.
SENT_TERMS = 300_000
#: Rows of a small table up to which it is sent to every task, and ranges whose bounds are a literal.
SENT_ROWS, LITERAL_ROWS = 20_000, 1_000
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.split(F.lower(text), _SPACE, -1)


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``term`` in the band, over all rows of ``docs (text)``; counts are pre-aggregated before the shuffle.

    Null and empty texts are rows without terms; repeated rows count as often; an empty table gives no term.
    """
    total = docs.count()
    # without a repeat a term says nothing about a second document
    low, high = max(2, ceil(total * least)), max(2, floor(total * most))
    # the outer form: for the inner one a filter on the array's size is inferred, for which all words would be split twice
    terms = docs.select(F.explode_outer(F.array_distinct(words(F.col("text")))).alias("term")).where("term <> ''")
    return terms.groupBy("term").count().where(F.col("count").between(low, high)).select("term")


def lexicon_table(terms: DataFrame) -> Column:
    """The lexicon as a literal ``array<array<string>>`` by hash bucket: one bounded row, which passes through the driver."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    table: list[list[str]] = [[] for _ in range(BUCKETS)]
    for r in terms.select(bucket.alias("bucket"), "term").collect():  # at most SENT_TERMS
        table[r.bucket].append(r.term)
    return F.from_json(F.lit(json.dumps(table)), "array<array<string>>")


def lexicon_terms(text: Column, table: Column) -> Column:
    """The sorted distinct lexicon terms of a text."""
    own = F.filter(
        words(text), lambda w: F.array_contains(F.get(table, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), w)
    )
    return F.array_sort(F.array_distinct(own))


def joined_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``text, terms``: the same for the distinct texts of ``texts (text)`` by a join with the lexicon."""
    each = texts.select("text").distinct().withColumn("key", F.sha2("text", 256))
    held = each.select("key", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("term")).join(terms, "term")
    own = held.groupBy("key").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # the terms of one text
    nothing = F.expr("cast(array() as array<string>)")
    return each.join(own, "key", "left").select("text", F.coalesce("terms", nothing).alias("terms"))


def signatures(text: Column, own: Column) -> Column:
    """``array<string>`` from a text and its lexicon terms: the whole lexicon's signature, then the subsets'; an empty subset's is ``-``.

    A text without lexicon terms has the hash of its words in all places, so that only equal ones agree.
    """
    terms = F.transform(own, lambda t: F.struct(t.alias("t"), F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint").alias("h")))

    def hashed(part: Column) -> Column:
        joined = F.array_join(F.transform(part, lambda t: t["t"]), " ")
        return F.when(F.size(part) == 0, F.lit("-")).otherwise(F.substring(F.md5(joined), 1, 8))

    def chosen(terms: Column) -> Column:
        subsets, shift = [hashed(terms)], 0
        for rate in RATES:
            for k in range(SUBSETS):
                subsets.append(_subset(terms, shift, rate, k, hashed))
            shift += rate.bit_length() - 1
        return F.array(*subsets)

    whole = F.substring(F.md5(F.array_join(words(text), " ")), 1, 8)
    alone = F.array_repeat(F.concat(F.lit("="), whole), 1 + len(RATES) * SUBSETS)
    # the terms are computed once, as a variable
    return F.element_at(F.transform(F.array(terms), lambda t: F.when(F.size(t) == 0, alone).otherwise(chosen(t))), 1)


def signed(df: DataFrame, text_col: str, out_col: str, terms: DataFrame, table: Column | None) -> DataFrame:
    """``df`` with the signatures of a text column, by the literal lexicon or, if it has none, by a join."""
    if table is not None:
        return df.withColumn(out_col, signatures(F.col(text_col), lexicon_terms(F.col(text_col), table)))
    own = joined_terms(df.select(F.col(text_col).alias("text")), terms).select(F.col("text").alias("_t"), signatures(F.col("text"), F.col("terms")).alias(out_col))
    return df.join(own, F.col(text_col) == F.col("_t")).drop("_t")


def _subset(terms: Column, shift: int, rate: int, k: int, hashed) -> Column:
    return hashed(F.filter(terms, lambda t: F.shiftright(t["h"], shift).bitwiseAND(F.lit(rate - 1)) == k))


def likeness(a: Column, b: Column) -> Column:
    """The largest share, over the rates, of equal signatures among the subsets in which either text has terms.

    The best rate is the one whose subsets hold few terms of these texts. The whole lexicon's
    signature counts only if no subset is used.
    """

    def share(pairs: Column) -> Column:
        used = F.filter(pairs, lambda p: (p["a"] != "-") | (p["b"] != "-"))
        return F.size(F.filter(used, lambda p: p["a"] == p["b"])) / F.nullif(F.size(used), F.lit(0))

    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    best = F.greatest(*[share(F.slice(pairs, 2 + i * SUBSETS, SUBSETS)) for i in range(len(RATES))])
    return F.coalesce(best, F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 1.0).otherwise(0.0))


def _place(docs: DataFrame) -> Column:
    """A number that orders rows with an id by it, and rows without one by the first seven bytes of their text."""
    if "text" not in docs.columns:
        return F.col("doc_id")
    prefix = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.coalesce("doc_id", prefix)


def _cut(rows: DataFrame, bounds: DataFrame, cuts: int) -> DataFrame:
    """Each range of ``rows (_range, _v, ...)`` cut by its ``bounds (_r, _bounds)``: by a literal where ranges are few, else by a join."""
    few, total = bounds.where("_r is not null").limit(LITERAL_ROWS + 1).collect(), F.lit(0)
    if len(few) <= LITERAL_ROWS:
        table: list[list[int]] = [[] for _ in range(max((r["_r"] for r in few), default=-1) + 1)]
        if len(table) <= LITERAL_ROWS * CUTS:
            for r in few:
                table[r["_r"]] = list(r["_bounds"])
            own = F.get(F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>"), F.col("_range").cast("int"))
            place = F.greatest(F.size(F.filter(own, lambda b: b <= F.col("_v"))) - 1, total)
            return rows.withColumn("_range", F.col("_range") * cuts + place)
    bounds = F.broadcast(bounds) if bounds.count() <= SENT_ROWS else bounds
    place = F.greatest(F.size(F.filter("_bounds", lambda b: b <= F.col("_v"))) - 1, total)
    cut = rows.join(bounds, F.col("_range") == F.col("_r"), "left")
    return cut.withColumn("_range", F.col("_range") * cuts + F.coalesce(place, total)).drop("_r", "_bounds")


def id_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_range``: numbers of ranges of ``doc_id`` in its order, of about ``RANGE_ROWS`` rows each.

    Rows without an id come first, in order of their texts. Ranges are cut by quantiles of their own
    rows, into ``CUTS`` at most at a time, until they are small enough, so clustered ids do not make
    large ranges. Rows of one id are one range, and so are those without one whose texts begin alike.
    The quantiles are those of a narrow table that is stored, so the texts are read once for it.
    """
    own = _place(docs)
    narrow = stored(docs.select(F.col("doc_id").isNotNull().cast("long").alias("_range"), own.alias("_v")), "places")
    needed = -(-narrow.count() // RANGE_ROWS)
    ranged = docs.withColumns({"_range": F.col("doc_id").isNotNull().cast("long"), "_v": own})
    while needed > 1:
        cuts = min(CUTS, needed)
        shares = [k / cuts for k in range(cuts)]
        bounds = checkpointed(narrow.groupBy(F.col("_range").alias("_r")).agg(F.percentile_approx("_v", shares, 10_000).alias("_bounds")))  # one row a range
        narrow, ranged = (_cut(df, bounds, cuts) for df in (narrow, ranged))
        needed = -(-needed // cuts)
    return ranged.drop("_v")


def with_successor(docs: DataFrame, complete: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """The rows of ``docs (doc_id, text)``, completed, with ``next_`` and the name of each carried column of the next row.

    ``complete`` adds the carried columns to a table with texts. Rows are ordered by id, then text, null
    ids first; the first row follows the last. A range of ids is sorted in one task; only the numbers
    and first rows of the ranges are exchanged between them.
    """
    ranged, row = id_ranges(docs), F.struct(*carried)
    near = Window.partitionBy("_range").orderBy("doc_id", "text")
    led = complete(ranged).withColumn("_following", F.lead(row).over(near))
    first = F.min_by("text", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "text"))
    heads = checkpointed(complete(checkpointed(ranged.groupBy("_range").agg(first.alias("text")))).select("_range", row.alias("_head")))
    # the next range's number: among neighbours, and from the last of them to the first of the next neighbours
    numbers = heads.select("_range", F.floor(F.col("_range") / NEAR_RANGES).alias("_near"))  # one number a range
    firsts = numbers.groupBy("_near").agg(F.min("_range").alias("_first"))
    over = Window.orderBy("_near")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = checkpointed(firsts.select(F.col("_near").alias("_t"), F.coalesce(F.lead("_first").over(over), F.min("_first").over(whole)).alias("_turn")))
    led_to = F.lead("_range").over(Window.partitionBy("_near").orderBy("_range"))
    following = numbers.withColumn("_next", led_to).join(turn, F.col("_near") == F.col("_t")).select("_range", F.coalesce("_next", "_turn").alias("_next"))
    to = following.join(heads.withColumnRenamed("_range", "_n"), F.col("_next") == F.col("_n")).select(F.col("_range").alias("_r"), "_head")
    taken = F.coalesce("_following", "_head")
    return led.join(to, (F.col("_range") == F.col("_r")) & F.col("_following").isNull(), "left").drop("_range", "_r").select(
        *[c for c in led.columns if not c.startswith("_")], *[taken[c].alias(f"next_{c}") for c in carried]
    )


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edited, own, changed, following``: each text, its edited text, and the signatures of both and of the next text.

    The edited text has its last quarter of code points replaced by as many of the next document's first
    ones. Null texts are empty; ties and repeated rows are ordered by text; other columns are not read;
    an empty table gives an empty one. A text's signatures are computed once and carried to the row before.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = checkpointed(lexicon(docs.select("text")))
    table = lexicon_table(terms) if terms.count() <= SENT_TERMS else None
    led = with_successor(docs, lambda rows: signed(rows, "text", "own", terms, table), ["text", "own"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
    both = signed(led.withColumn("edited", edited), "edited", "changed", terms, table)
    return both.select("doc_id", "text", "edited", "own", "changed", F.col("next_own").alias("following"))
