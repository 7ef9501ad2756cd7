"""URL rules: tokens of expressions, the index, and verdicts against every rule tried on every URL."""

import random
import re

from corpusloom.llm import url_rules as ur
from hypothesis import given, settings
from hypothesis import strategies as st


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url):
    host, path = split(url)
    best = None
    for name, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        own, _, rest = name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and len(name) > len(best[0] if best else ""):
            best = (name, verdict)
    if best:
        return host, path, *best
    fits = any(re.search(r.pattern, host + path) for r in ur.FORMS)
    return host, path, None, "block" if fits else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "http://com", "http://com/", "HTTP://COM/x", "http://example.com?q=/en/", "http://example.com/en", "http://example.com/en/",
    "http://example.com/EN/", "http://www.Example.com/en/1#a", "http://wwww.example.com/en/", "http://notexample.com/en/", "http://a.b.example.com/en/x?y", "http://x.net/es/",
    "http://net/fr/", "http://net/es", "http://x.net/en/?u=http://y.com/", "ftp://user:pw@x.org:80/fr/", "http://10.0.0.1/a", "http://10.0.0.1", "http://ads-track.example.org/en/1",
    "http://ADS-TRACK.example.net/de/", "http://m.casino-win.example.org/", "http://xcasino.example.org/", "http://x.org/a/CASINO/b", "http://x.org/Kasino", "http://x.org/a/b/adserver/z",
    "http://x.org/track/clicked", "a://b://com/", "http://ex\nample.com/en/", "http://example.com\n/en/", "http://İ.com/en/", "http://x.org/" + "very/long/" * 5000 + "bets",
]


def test_tokens():
    told = {r.name: ur.rule_tokens(r) for r in ur.RULES}
    assert told["com/"] == ["com"] and told["net/es/"] == ["es", "net"] and told["numbers for a host"] == [] and told["advert host"] == ["ads", "track"]
    rule = lambda p: ur.rule_tokens(ur.UrlRule("", p, ur.BLOCK, 1))
    # no limit on one side, an optional token, one of two, a class that may be a letter, an open repeat
    assert rule("/fr") == [] and rule("/(?:fr/)?x/") == ["x"] and rule("/(?:fr|es)/x/") == ["x"] and rule("[a-c/]fr/") == [] and rule("/fr.*/es/") == ["es"]
    assert rule("/fr/?") == [] and rule("^fr$") == ["fr"] and rule("(?:^|/)fr(?:/|$)") == ["fr"] and rule("(?:x|)fr/") == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab/.-1A"), max_size=12))
def test_tokens_are_in_every_match(place):
    for pattern in ("(?:^|[^0-9A-Za-z])ab(?:[^0-9A-Za-z]|$)", "^(?:[^/]*\\.)?a\\.b/", "/a(?:-b)*/", "(?:^|\\.)(?i:AB)/1", "a/b", "[^ab]a$"):
        rule = ur.UrlRule("", pattern, ur.BLOCK, 1)
        if re.search(pattern, place):
            assert set(ur.rule_tokens(rule)) <= {t.lower() for t in re.findall("[0-9A-Za-z]+", place)}


def test_odd_urls(spark):
    rows = [(n, u) for n, u in enumerate(URLS)] + [(None, URLS[10]), (4, URLS[4]), (4, URLS[4]), (None, None), (None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS place", "3 AS token", "4 AS `row`", "5 AS rank")
    got = sorted(((r.page_id, r.url), r.host, r.path, r.rule, r.verdict) for r in ur.judge_urls(table.repartition(3)).collect() if r.page_id is not None)
    want = sorted(((n, u), *brute(u)) for n, u in rows if n is not None)
    assert list(map(repr, got)) == list(map(repr, want))
    none = [r for r in ur.judge_urls(table).collect() if r.page_id is None]
    assert sorted(str(r.verdict) for r in none) == ["allow", "allow", "block"]
    assert ur.judge_urls(table.limit(0)).collect() == []


def test_rarest_token(spark):
    urls = spark.createDataFrame([("www.example.com/en/",)] * 3 + [("example.com/fr/",), ("net/es/",), ("net/x/",)], "place string")
    index = {r.pattern: r.token for r in ur.token_index(urls).collect()}
    held = {r.name: index[r.pattern] for r in ur.RULES}
    assert held["net/es/"] == "es" and held["net/fr/"] == "fr" and held["www.example.com/en/"] == "en" and held["numbers for a host"] == ""


def test_many_rules_by_an_exchange(spark, monkeypatch):
    """Beyond the limit the index is not sent; results are the same."""
    rng = random.Random(5)
    rules = tuple(ur.place_rule(f"h{n}.org", rng.choice(["/", "/a/"]), rng.choice(["allow", "block"])) for n in range(60))
    urls = spark.createDataFrame([(n, f"http://s.h{n % 70}.org/a/{n}") for n in range(200)], "page_id long, url string")
    sent = sorted(map(tuple, ur.judge_urls(urls, rules).collect()))
    monkeypatch.setattr(ur, "SENT_RULES", 10)
    assert sorted(map(tuple, ur.judge_urls(urls, rules).collect())) == sent
