"""Filter interaction audit: what each filter removes, alone and in every order, from one cube of failure flags.

The texts are read once, for their flags. Rows are counted by part and flags before the cube, so it
expands at most 32 rows a part. In a grouping set the selected flags are grouped and the others rolled
up; its row in which all selected flags are false counts what survives that subset of filters. A step
of an order is a pair of subsets, before and after its filter, and all its numbers are differences of
survivors. The survivors of the two subsets are joined for each step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, place_of, stored

LETTERS = "ABCDE"
#: Characters that split words: space and code points 9 to 13.
_SPACES = r"[\x20\x09-\x0D]+"
_COUNTS = ("docs", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The conditions of A to D, from the text alone; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACES, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, A, B, C, D, E`` for each row; the narrow table is stored, so texts are read once.

    E: the text is also that of a smaller id, anywhere in the table; texts are told apart by their
    SHA-256. A null text is empty, a null part the empty string. A row without an id is neither smaller
    nor larger than another and never fails E. Repeated rows are kept and fail alike; an empty table
    gives an empty one; other columns, whatever their names, are not read.
    """
    rows, at = numbered(docs), lambda name: F.col(f"c{place_of(docs, name)}")
    text = F.coalesce(at(text_col).cast("string"), F.lit(""))
    narrow = rows.select(
        at(id_col).cast("long").alias("doc_id"),
        F.coalesce(at(part_col).cast("string"), F.lit("")).alias("part"),
        *[c.alias(k) for k, c in text_flags(text).items()],
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    narrow = stored(narrow, "flags")
    # each text's smallest id; rows meet it by text and id, so copies of one text do not share a key
    firsts = narrow.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = narrow.where("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    columns = ["doc_id", "part", *LETTERS]
    return known.select(*columns).unionByName(narrow.where("doc_id IS NULL").withColumn("E", F.lit(False)).select(*columns))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic``: whether a row of ``labels`` with the id has quality 1, toxic 1.

    Repeated labels count once, and ids without a label are neither; rows without an id keep out of the join.
    """
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = flags.where("doc_id IS NOT NULL").join(told, "doc_id", "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return known.unionByName(flags.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def survivors(flags: DataFrame) -> DataFrame:
    """``part, subset, docs, good, toxic``: what fails none of the subset's filters, zeros included, 32 rows a part.

    ``subset`` has bit k for letter k.
    """
    counted = flags.groupBy("part", *LETTERS).agg(
        F.count("*").alias("docs"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    # in SQL a rolled-up column is null, which no flag and no part is
    cube = counted.cube(*LETTERS, "part").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.grouping_id().alias("rolled"))
    selected = [F.shiftright("rolled", len(LETTERS) - k).bitwiseAND(1) == 0 for k in range(len(LETTERS))]
    alive = cube.where(F.col("rolled").bitwiseAND(1) == 0)
    for k, letter in enumerate(LETTERS):
        alive = alive.where(~selected[k] | ~F.col(letter))
    alive = alive.select("part", sum(F.when(s, 1 << k).otherwise(0) for k, s in enumerate(selected)).alias("subset"), *_COUNTS)
    # subsets without a survivor have no row in the cube
    grid = counted.groupBy("part").agg(F.count("*")).select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(LETTERS) - 1))).alias("subset"))
    return grid.join(alive, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS])


def steps() -> list[tuple[str, int, str, int, int]]:
    """``filter_order, step, letter, before, after`` of all orders: a fixed number of rows."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for n, letter in enumerate(order):
            after = before | 1 << LETTERS.index(letter)
            out.append(("".join(order), n + 1, letter, before, after))
            before = after
    return out


def audit(flags: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows a part.

    ``flags`` has ``part``, the flags and ``good`` and ``toxic``, none of them null. An empty table gives an empty one.
    """
    spark = flags.sparkSession
    alive = stored(survivors(flags), "survivors")
    pairs = sorted({(letter, before, after) for _, _, letter, before, after in steps()})
    values = ", ".join(f"('{letter}', {b}, {a}, {factorial(b.bit_count()) * factorial(4 - b.bit_count())}L)" for letter, b, a in pairs)
    table = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS p(letter, before, after, orders)"))  # 80 rows
    before = alive.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in _COUNTS])
    after = alive.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in _COUNTS])
    moved = before.join(table, "before").join(after, ["part", "after"]).select(
        "part", "letter", "before", F.col("docs_after").alias("kept"), "orders",
        *[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(f"{c}_lost") for c in _COUNTS],
    )
    every = 2 ** len(LETTERS) - 1
    own = F.col("docs_lost")
    rest = F.lit(every) - F.element_at(F.create_map(*[F.lit(x) for k, letter in enumerate(LETTERS) for x in (letter, 1 << k)]), F.col("letter"))
    of_filter = moved.groupBy("part", "letter").agg(
        F.max(F.when(F.col("before") == 0, own)).alias("fails"),
        F.max(F.when(F.col("before") == rest, own)).alias("unique_fails"),
        F.sum(own * F.col("orders")).alias("shapley"),
    )
    values = ", ".join(f"('{order}', {step}, '{letter}', {before})" for order, step, letter, before, _ in steps())
    listed = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS s(filter_order, step, letter, before)"))  # 600 rows
    return moved.join(listed, ["letter", "before"]).join(of_filter, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", own.alias("removed"), (F.col("fails") - own).alias("redundant"), "unique_fails",
        F.col("good_lost"), F.col("toxic_lost"), "shapley",
    )
