"""Chat formatting with Spark expressions only: text, loss mask, and the way back.

A conversation is ``<s>``, its blocks and ``</s>``. Adjacent turns of one role form a block::

    [ROLE]role[TEXT]first text[ALSO]second text[END]

Inside roles and texts ``~`` becomes ``~0``, and a control string gets ``~1`` after its first
character, so no control string is left in them and the way back is exact. The loss mask is an array
of byte spans of the formatted text in UTF-8: one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings, with those of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[ALSO]", "[END]")
BEGIN, FINISH = "<s>", "</s>"
_PATTERN = r"(<(?=/?s>)|\[(?=/?INST\]|ROLE\]|TEXT\]|ALSO\]|END\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), _PATTERN, "$1~1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant"
) -> DataFrame:
    """``conv_id, n_turns long, formatted string, loss_spans array<struct<start, length>>``.

    Turns are ordered by number, then role, then text, so ties and repeated rows have one order and
    all are kept; turns without a number come first. A null text or role is empty. Rows without a
    conversation id form one conversation with a null id. Other columns are not read. A conversation
    is one row of the result, so it must fit a row; its turns meet in one task and no other
    conversation's do.
    """
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    empty = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def merge(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        more = F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        same = (F.size(blocks) > 0) & (last["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(more))).otherwise(F.concat(blocks, F.array(new)))

    merged = collected.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", empty, merge).alias("blocks"))
    # pieces in order: a block's head, then its texts with marks between them, then its end
    def pieces(b: Column) -> Column:
        trained = b["role"] == trained_role
        texts = F.transform(
            b["texts"],
            lambda x, i: F.struct(
                F.when(i == 0, F.concat(F.lit("[ROLE]"), escape(b["role"]), F.lit("[TEXT]"))).otherwise(F.lit("[ALSO]")).alias("head"),
                escape(x).alias("text"),
                F.when(i == F.size(b["texts"]) - 1, F.lit("[END]")).otherwise(F.lit("")).alias("tail"),
                trained.alias("trained"),
            ),
        )
        return texts

    laid = merged.select("conv_id", "n_turns", F.flatten(F.transform("blocks", pieces)).alias("p"))
    spans0 = F.struct(
        F.lit(len(BEGIN)).cast("long").alias("at"),
        F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"),
    )

    def walk(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.octet_length(p["head"])
        length = F.octet_length(p["text"]).cast("long")
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct(
            (start + length + F.octet_length(p["tail"])).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    body = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return laid.select(
        "conv_id",
        "n_turns",
        F.concat(F.lit(BEGIN), body, F.lit(FINISH)).alias("formatted"),
        F.aggregate("p", spans0, walk)["spans"].alias("loss_spans"),
    )


def parse_formatted(df: DataFrame) -> DataFrame:
    """The way back: ``conv_id, turns array<struct<role, text>>, loss_text string`` and the input's other columns.

    It takes what :func:`format_conversations` gives, and rows whose formatted text is null have null
    results. Columns of the results' names are replaced; an empty table gives an empty one.
    """
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(FINISH)})")

    def turns_of(block: Column) -> Column:
        halves = F.split(block, r"\[TEXT\]", 2)
        role = unescape(F.regexp_replace(F.get(halves, F.lit(0)), r"^\[ROLE\]", ""))
        return F.transform(F.split(F.get(halves, F.lit(1)), r"\[ALSO\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(inner, r"\[END\]", -1), lambda b: b != "")
    octets = F.encode("formatted", "UTF-8")
    masked = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(octets, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return df.withColumns({"turns": F.flatten(F.transform(blocks, turns_of)), "loss_text": F.array_join(masked, "")})
