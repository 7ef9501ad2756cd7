"""URL filters by pattern rules that are indexed by their rarest literal token, with Spark expressions only.

A rule is a regular expression over host and path. Its tokens are the runs of letters and digits that
every match holds with nothing but separators or limits around them; the one that fewest URLs hold is
its entry of the index. A URL's tokens fetch the rules of their entries, and only those run their
expressions. Rules without a token have the empty token, which every URL holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, place_of

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

ALLOW, BLOCK = "allow", "block"
#: Rules up to which the index is sent to all tasks; beyond it, tokens and index are exchanged.
SENT_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("0123456789" + _UPPER + _LOWER)


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is common to Java, Python and RE2. The rule of the highest rank that fits decides; ``name`` tells it in the result."""

    name: str
    pattern: str
    verdict: str
    rank: int
    told: bool = True


def _quoted(text: str) -> str:
    return "".join(c if c in _WORD or c in "/_-" else f"\\{c}" for c in text)


def place_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host, its subdomains and the paths that start with ``path``; of several the longest wins."""
    return UrlRule(host + path, f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}", verdict, 1_000_000 + len(host + path))


#: The place rules.
PLACES = (
    place_rule("com", "/", ALLOW),
    place_rule("example.com", "/en/", BLOCK),
    place_rule("www.example.com", "/en/", ALLOW),
    place_rule("net", "/es/", BLOCK),
    place_rule("net", "/fr/", BLOCK),
)

_EDGE, _STOP = "(?:^|[^0-9A-Za-z])", "(?:[^0-9A-Za-z]|$)"
#: What decides where no place rule fits: forms of addresses that serve adverts, bets or trackers. Without one, the URL is allowed.
FORMS = tuple(
    UrlRule(name, pattern, BLOCK, n + 1, False)
    for n, (name, pattern) in enumerate(
        (
            ("numbers for a host", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)"),
            ("advert server", rf"^(?:[^/]*\.)?(?:www[0-9]?\.)?ads?[-.](?:track|serve|click)(?:er|ing)?{_STOP}"),
            ("casino", f"{_EDGE}(?i:casino){_STOP}"),
            ("bets", f"{_EDGE}(?i:bets){_STOP}"),
            ("poker", f"{_EDGE}(?i:poker){_STOP}"),
            ("lottery", f"{_EDGE}(?i:lottery){_STOP}"),
            ("advert host", r"^(?:[^/]*\.)?ads-track\."),
            ("advert folder", r"^[^/]*/(?:[^/]*/)*adserver/"),
            ("click counter", r"^[^/]*/(?:[^/]*/)*track/click"),
        )
    )
)
RULES = PLACES + FORMS


def _of_class(arg) -> set[str] | None:
    """The characters of a class if it is a plain one, None if it is negated or holds a category."""
    chars: set[str] = set()
    for kind, value in arg:
        if kind is sre.LITERAL:
            chars.add(chr(value))
        elif kind is sre.RANGE:
            chars |= {chr(c) for c in range(value[0], min(value[1], 127) + 1)} | ({"\x80"} if value[1] > 127 else set())
        else:
            return None
    return chars


def _separates(op, arg) -> bool:
    """One character that is surely neither a letter of A-Z, a-z nor a digit."""
    if op is sre.LITERAL:
        return chr(arg) not in _WORD
    if op is sre.IN:
        if arg and arg[0][0] is sre.NEGATE:
            chars = _of_class(arg[1:])
            return chars is not None and chars >= _WORD
        chars = _of_class(arg)
        return chars is not None and not chars & _WORD
    return False


def _clear(items, before: bool, back: bool = False) -> bool:
    """Whether a token could start right after the items (``back``: end right before them), if one could before them."""
    for op, arg in reversed(items) if back else items:
        if op is sre.AT:
            before = before or arg in ((sre.AT_END, sre.AT_END_STRING) if back else (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING))
        elif op is sre.SUBPATTERN:
            before = _clear(arg[3], before, back)
        elif op is sre.BRANCH:
            before = all([_clear(x, before, back) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, _, body = arg
            before = _clear(body, before if low == 0 else False, back) and (low > 0 or before)
        else:
            before = _separates(op, arg)
    return before


def _flat(items) -> list:
    """Groups that neither repeat nor branch are read as their contents."""
    out = []
    for op, arg in items:
        out += _flat(arg[3]) if op is sre.SUBPATTERN else [(op, arg)]
    return out


def rule_tokens(rule: UrlRule) -> list[str]:
    """The lower-case tokens that each match of the rule's expression holds whole."""
    items, out = _flat(sre_parse.parse(rule.pattern)), set()
    a = 0
    while a < len(items):
        if items[a][0] is sre.LITERAL and chr(items[a][1]) in _WORD:
            b = a
            while b < len(items) and items[b][0] is sre.LITERAL and chr(items[b][1]) in _WORD:
                b += 1
            if _clear(items[:a], False) and _clear(items[b:], False, back=True):
                out.add("".join(chr(arg) for _, arg in items[a:b]).lower())
            a = b
        else:
            a += 1
    return sorted(out)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without one or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def url_tokens(place: Column) -> Column:
    """The distinct lower-case runs of letters and digits, and the empty token."""
    return F.array_distinct(F.array_append(F.transform(F.regexp_extract_all(place, F.lit("[0-9A-Za-z]+"), 0), lambda t: F.translate(t, _UPPER, _LOWER)), F.lit("")))


def token_index(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``token, rank, pattern``: each rule under the one of its tokens that fewest rows of ``urls`` hold.

    ``urls`` has ``place``, host and path. Only tokens of rules are counted. Ties go to the smaller token.
    """
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t, r.rank, r.pattern) for r in rules for t in rule_tokens(r) or [""]], "token string, rank int, pattern string")
    own = wanted.select("token").distinct()
    if len(rules) <= SENT_RULES:
        own = F.broadcast(own)
    counts = urls.select(F.explode_outer(url_tokens(F.col("place"))).alias("token")).join(own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = wanted.join(counts, "token", "left").groupBy("rank", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return ranked.select(F.col("least.token").alias("token"), "rank", "pattern")


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, verdict, reason`` for each row.

    ``rule`` is the place rule that fits, else null, and ``reason`` the name of whatever rule decided;
    ``default`` is the verdict where none fits. A null URL and one without ``://`` have an empty host
    and path. Repeated rows and null ids are kept, an empty table gives an empty one, and other columns,
    whatever their names, are not read. Rules of one rank are told apart by name. The rows are exchanged once, by their number.
    """
    if len({r.rank for r in rules}) < len(rules):
        # of places of one length the later name wins
        rules = tuple(sorted(rules, key=lambda r: (r.rank, r.name)))
        rules = tuple(UrlRule(r.name, r.pattern, r.verdict, n + 1, r.told) for n, r in enumerate(rules))
    source = numbered(df)
    url = F.col(f"c{place_of(df, url_col)}").cast("string")
    urls = source.select(F.col(f"c{place_of(df, id_col)}").alias("page_id"), url.alias("url"), F.concat(host_of(url), path_of(url)).alias("place"))
    index = token_index(urls, rules)
    if len(rules) <= SENT_RULES:
        index = F.broadcast(index)
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    asked = rows.select("row", "page_id", "url", "place", F.explode_outer(url_tokens(F.col("place"))).alias("token"))
    fits = asked.join(index, "token", "left").select("row", "page_id", "url", F.when(F.expr("place RLIKE pattern"), F.col("rank")).alias("rank"))
    best = fits.groupBy("row", "page_id", "url").agg(F.max("rank").alias("rank"))
    table = df.sparkSession.createDataFrame([(r.rank, r.name, r.verdict, r.told) for r in rules], "rank int, name string, decided string, told boolean")
    if len(rules) <= SENT_RULES:
        table = F.broadcast(table)
    return best.join(table, "rank", "left").select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("told"), F.col("name")).alias("rule"),
        F.coalesce("decided", F.lit(default)).alias("verdict"),
        F.col("name").alias("reason"),
    )
