"""Secret scans over a trigram inverted index, with Spark expressions only.

Each rule's regular expression gives a Boolean query over lower-case trigrams that any match must
hold: a choice of clauses, each a set of trigrams that all occur. Postings are (trigram, row) for the
trigrams of all queries; a clause's postings are intersected by counting, and the rows left are
verified with the expression itself. Rules without mandatory trigrams scan every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, place_of, row_hash

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Alternatives of a literal stretch that the analysis keeps exactly.
MOST_STRINGS = 64
_MARK, _OTHER = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is common to Java, Python and RE2; matches whose group (0: all) is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# A whole private key: header fields, then all up to the END line; without one, to the end of the
# base64 lines, the last of which may be short. Loops are over one class, as those of groups recurse
# in Java; header fields are the exception, and standards know about ten.
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[ \t\r\n]*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n){0,32}"
    r"(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/= \t\r\n\\]*[A-Za-z0-9+/=]{20,}(?:[ \t]*\r?\n[A-Za-z0-9+/]+={0,2}(?:\r?\n|$)|[ \t\r\n]+[A-Za-z0-9+/]+={1,2})?))?"
)

#: The base rules, and forms of keys that services publish.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", _KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"(?:https?|ftp|postgres|mysql|redis)://[^\s/:@]+:[^\s/@]+@"),
)

Clauses = frozenset[frozenset[str]]


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(clauses: Clauses) -> Clauses:
    """A clause that holds another one says nothing more."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


_ANY: Clauses = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> Clauses:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _analyse(items) -> tuple[set[str] | None, Clauses]:
    """The strings that a sequence matches, if they are few, and the clauses of what it matches."""
    found: Clauses = _ANY
    exact: set[str] | None = {""}
    whole = True

    def close() -> None:
        nonlocal found, exact, whole
        found, exact, whole = _both(found, _of_strings(exact)), {""}, False

    for op, arg in items:
        strings, clauses = _one(op, arg)
        if strings is None:
            close()
            found = _both(found, clauses)
            continue
        joined = {a + b for a, b in product(exact, strings)}
        if len(joined) > MOST_STRINGS:
            close()
            joined = strings
        exact = joined
    if whole:
        return exact, _of_strings(exact)
    close()
    return None, found


def _one(op, arg) -> tuple[set[str] | None, Clauses]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, _ANY
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, _ANY
        return (chars, _ANY) if len(chars) <= 8 else (None, _ANY)
    if op is sre.SUBPATTERN:
        return _analyse(arg[3])
    if op is sre.BRANCH:
        parts = [_analyse(branch) for branch in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), _ANY
        return None, _least(frozenset().union(*(c for _, c in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        strings, clauses = _analyse(body)
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return {"".join(p) for p in product(strings, repeat=low)}, _ANY
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, _ANY
        return None, clauses if low else _ANY
    return None, _ANY


def trigram_query(rule: Rule) -> Clauses | None:
    """Clauses of mandatory lower-case trigrams; None if some match needs none, so that all rows must be scanned."""
    strings, clauses = _analyse(sre_parse.parse(rule.pattern))
    if strings is not None:
        clauses = _of_strings(strings)
    return None if any(not c for c in clauses) else clauses


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``row long, trigram``: the trigrams of the rules' queries that occur in each row's lower-case text.

    ``row`` is a hash of all columns; rows that share one share their postings, which adds candidates
    and loses none. A null or empty text has no postings, and an empty table none.
    """
    wanted = sorted({t for r in rules for c in trigram_query(r) or () for t in c})
    # the text is lowered once, as a variable of the outer function
    found = F.flatten(F.transform(F.array(F.lower(text_col)), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t))))
    return docs.select("row", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row, kinds array<string>``: rows that hold all trigrams of a clause of the kind's query.

    Postings that repeat count once; without postings, or rules with trigrams, there are no candidates.
    """
    spark = index.sparkSession
    clauses = [
        (rule.kind, n, len(c), t)
        for rule in rules
        for n, c in enumerate(sorted(map(sorted, trigram_query(rule) or ())))
        for t in c
    ]
    if not clauses:
        return index.select("row", F.array().cast("array<string>").alias("kinds")).limit(0)
    # a relation of literals of the rules' own size, not of the data's
    values = ", ".join(f"('{k}', {n}, {need}, '{_sql(t)}')" for k, n, need, t in clauses)
    table = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS q(kind, clause, need, tri)"))
    held = (
        index.join(table, F.col("trigram") == F.col("tri"))
        .groupBy("row", "kind", "clause", "need")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = need")
    )
    return held.groupBy("row").agg(F.collect_set("kind").alias("kinds"))  # at most as many as rules


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """``array<struct<start, n, stop>>`` of the rule's matches, leftmost and non-overlapping, in code points."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), F.lit(rule.java), F.lit(f"{_MARK}$0{_MARK}"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, n: int, stop: int>>)").alias("spans"), F.lit(False).alias("hit"))

    def walk(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.length(piece)
        part = F.regexp_extract(piece, rule.java, rule.group) if rule.group else piece
        good = acc["hit"] & (F.length(part) >= rule.least)
        span = F.struct(acc["at"].alias("start"), F.lit(number).alias("n"), stop.alias("stop"))
        return F.struct(
            stop.alias("at"),
            F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            (~acc["hit"]).alias("hit"),
        )

    return F.aggregate(F.split(marked, _MARK, -1), start, walk)["spans"]


def _fast(rule: Rule) -> Rule:
    """Runs of one class that are long enough are the same matches, and shorter ones need not be marked."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        head = rule.pattern[: rule.pattern.rindex("[")]
        if head.isalnum() or not head:
            return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}", 0, 0, rule.base, rule.any_case)
    return rule


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """All rows and columns of ``df`` with ``secrets array<struct<start, n, stop>>``, sorted; ``n`` counts the rules.

    A null or empty text has no spans; an empty table gives an empty one. Repeated rows are kept, and
    rows that share a hash only widen the candidates. A column of the result's name, in any case, is
    replaced; other names do not matter.
    """
    kept = [n for n, c in enumerate(df.columns) if c.lower() != out_col.lower()]
    rows = numbered(df).select(*[f"c{n}" for n in kept], F.coalesce(F.col(f"c{place_of(df, text_col)}").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_hash(rows))
    hits = candidates(postings(rows.select("row", "text"), rules), rules).select(F.col("row").alias("hit"), "kinds")
    joined = rows.join(hits, F.col("row") == F.col("hit"), "left")
    none = F.expr("cast(array() as array<struct<start: int, n: int, stop: int>>)")
    found = []
    for number, rule in enumerate(rules):
        own = spans_of(F.col("text"), _fast(rule), number)
        found.append(own if trigram_query(rule) is None else F.when(F.array_contains("kinds", rule.kind), own).otherwise(none))
    return joined.select(*[f"c{n}" for n in kept], F.sort_array(F.concat(*found))).toDF(*[df.columns[n] for n in kept], out_col)


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["n"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, by: str = "[REDACTED]") -> Column:
    """The text with each stretch that sorted spans cover replaced; touching and nested spans are one stretch."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def walk(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(by)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, walk, finish)).otherwise(text)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows and exactly the columns of ``df`` with the secrets in the text replaced.

    Where a text changes, ``count_col``, if there is such a column, becomes its new length. Null texts
    stay null. All rows stay, repeated ones too; columns of any other name, such as secrets, are
    carried as they are.
    """
    found = find_secrets(numbered(df), rules, f"c{place_of(df, text_col)}", "spans")
    text = F.col(f"c{place_of(df, text_col)}")
    found = found.withColumn("done", F.when(text.isNotNull(), redact(text.cast("string"), F.col("spans"))).cast(df.schema[place_of(df, text_col)].dataType))
    columns = [F.col(f"c{n}") for n in range(len(df.columns))]
    columns[place_of(df, text_col)] = F.col("done")
    if count_col.lower() in [c.lower() for c in df.columns]:
        n = place_of(df, count_col)
        columns[n] = F.when(F.size("spans") > 0, F.length("done").cast(df.schema[n].dataType)).otherwise(columns[n])
    return found.select(*columns).toDF(*df.columns)
