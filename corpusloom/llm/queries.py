"""The registered queries of the training-data operators and their SQL, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audio_media, chat_format, fill_middle, filter_audit, hypergeometric_shuffle, imatch, mixture_pack, secret_index, sentencepiece_codec, simhash_blocks, toxicity_chain,
    url_rules, warc_salvage,
)  # fmt: skip
from .common import scan, stored

SHARDS = 40


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(audio_media.encode_media(_read(spark, sf_dir, "documents")), "media")
    spans = F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"])), ",")
    return audio_media.audio_features(media).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.lit("wav8"), "n_frames", "n_windows", F.sha2("features", 256), spans).alias("feature"),
        F.size("segments").alias("n_segments"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = imatch.fingerprint_edits(_read(spark, sf_dir, "documents"))
    return told.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", ".").alias("fingerprint"),
        F.array_join("changed", ".").alias("edited_fingerprint"),
        imatch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        imatch.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L conv_id, 0L turn, 'user' role, '{said}' text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.parse_formatted(chat_format.format_conversations(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chain = toxicity_chain.fit(docs, _read(spark, sf_dir, "labels"))
    told = toxicity_chain.predict(docs, chain)
    names = [F.round(c, 6).alias(f"p_{c}") for c in chain.categories]
    return told.select("doc_id", *names, (F.col("toxic") >= toxicity_chain.THRESHOLD).cast("int").alias("toxic"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hypergeometric_shuffle.shuffle_into_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, seed=6)
    octets = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return placed.select(
        "doc_id",
        (F.length(octets) + 16).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mixture_pack.pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.find_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["n"] < 3)

    def count(number: int):
        return F.size(F.filter("secrets", lambda s: s["n"] == number)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_index.span_text(base), 256).alias("base_sha256"),
        secret_index.span_text(F.col("secrets")).alias("spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc_salvage.mark_revisits(_read(spark, sf_dir, "pages"))
    back = warc_salvage.read_archives(warc_salvage.write_archives(pages))
    return back.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_blocks.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fill_middle.restore(fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.failures(_read(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.labelled(flags, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "reason")


_OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts,
    length(text) + length(text) - length(replace(text, '~', ''))
      + 2 * len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[(ROLE|TEXT|ALSO|END)\]')) AS text_chars,
    length(role) + length(role) - length(replace(role, '~', ''))
      + 2 * len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[(ROLE|TEXT|ALSO|END)\]')) AS role_chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(7 + sum(text_chars + CASE WHEN starts THEN role_chars + 17 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP9_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""



def _op8_sql() -> str:
    """Matches are put between marks, and the lengths of the pieces summed to positions."""
    parts = []
    for n, r in enumerate(secret_index.RULES):
        pattern = r.java.replace("'", "''")
        kept = f"length(regexp_extract(p, '{pattern}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(f"""
  SELECT doc_id, {n} AS n, '{r.kind}' AS kind, s AS s, s + length(p) AS e FROM (
    SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM (
      SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS ps FROM d)))
  WHERE i % 2 = 0 AND {kept}""")
    listed = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, n)"
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents),
m AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
  sha256(coalesce({listed} FILTER (n < 3), '')) AS base_sha256, coalesce({listed} FILTER (n IS NOT NULL), '') AS spans
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


_OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT d.doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'))) AS term FROM d),
x AS (SELECT term FROM w WHERE term <> '' GROUP BY term
  HAVING count(*) BETWEEN greatest(2, ceil((SELECT count(*) FROM d) * {imatch.LEAST_SHARE})) AND greatest(2, floor((SELECT count(*) FROM d) * {imatch.MOST_SHARE}))),
l AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
t AS (SELECT doc_id, n, text, next_text, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM l),
v AS (SELECT doc_id, 0 AS v, text FROM t UNION ALL SELECT doc_id, 1, edited FROM t UNION ALL SELECT doc_id, 2, next_text FROM t),
o AS (SELECT doc_id, v, regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') AS ws FROM v),
g AS (SELECT doc_id, v, term, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h
  FROM (SELECT doc_id, v, unnest(list_distinct(ws)) AS term FROM o) SEMI JOIN x USING (term)),
k AS (SELECT 0 AS j, 0 AS shift, 1 AS rate, 0 AS k {"".join(f" UNION ALL SELECT {1 + i * imatch.SUBSETS + k}, {sum(r.bit_length() - 1 for r in imatch.RATES[:i])}, {rate}, {k}" for i, rate in enumerate(imatch.RATES) for k in range(imatch.SUBSETS))}),
s AS (SELECT doc_id, v, j, substr(md5(string_agg(term, ' ' ORDER BY encode(term))), 1, 8) AS sig FROM g JOIN k ON ((h >> shift) & (rate - 1)) = k.k GROUP BY ALL),
a AS (SELECT o.doc_id, o.v, k.j, CASE WHEN e.doc_id IS NULL THEN '=' || substr(md5(array_to_string(ws, ' ')), 1, 8) ELSE coalesce(s.sig, '-') END AS sig
  FROM o CROSS JOIN k LEFT JOIN s ON s.doc_id = o.doc_id AND s.v = o.v AND s.j = k.j LEFT JOIN (SELECT DISTINCT doc_id, v FROM g) e ON e.doc_id = o.doc_id AND e.v = o.v),
f AS (SELECT doc_id, v, string_agg(sig, '.' ORDER BY j) AS fp, list(sig ORDER BY j) AS sigs FROM a GROUP BY doc_id, v),
n AS (SELECT p.doc_id, p.v, (p.j - 1) // {imatch.SUBSETS} AS rate, count(*) FILTER (p.sig <> '-' OR q.sig <> '-') AS used, count(*) FILTER (p.sig <> '-' AND p.sig = q.sig) AS same
  FROM a p JOIN a q USING (doc_id, j) WHERE q.v = 0 AND j > 0 GROUP BY ALL),
b AS (SELECT doc_id, v, max(same / used) FILTER (used > 0) AS best FROM n GROUP BY doc_id, v),
z AS (SELECT p.doc_id, p.v, CASE WHEN p.sig = q.sig THEN 1.0 ELSE 0.0 END AS alike FROM a p JOIN a q USING (doc_id, j) WHERE q.v = 0 AND j = 0),
r AS (SELECT doc_id, v, CAST(coalesce(best, alike) AS DOUBLE) AS near FROM b JOIN z USING (doc_id, v))
SELECT t.doc_id, t.n AS n_chars, sha256(edited) AS edited_sha256, f0.fp AS fingerprint, f1.fp AS edited_fingerprint, r1.near AS near_edited, r2.near AS near_next
FROM t JOIN f f0 ON f0.doc_id = t.doc_id AND f0.v = 0 JOIN f f1 ON f1.doc_id = t.doc_id AND f1.v = 1
JOIN r r1 ON r1.doc_id = t.doc_id AND r1.v = 1 JOIN r r2 ON r2.doc_id = t.doc_id AND r2.v = 2
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us,
  [CAST('0x' || substr(x, 1, 8) AS BIGINT), CAST('0x' || substr(x, 9, 8) AS BIGINT), CAST('0x' || substr(x, 17, 8) AS BIGINT), CAST('0x' || substr(x, 25, 8) AS BIGINT)] AS h FROM d),
c AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1 : a], ''), '') AS pre, coalesce(array_to_string(us[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(us[b + 1 : n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

# every order over every document, without subsets
_OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws FROM documents),
f AS (SELECT t.doc_id, part,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails,
    t.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, t.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM t),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT [a, b, c, d, e] AS ord, substr('ABCDE', a, 1) || substr('ABCDE', b, 1) || substr('ABCDE', c, 1) || substr('ABCDE', d, 1) || substr('ABCDE', e, 1) AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (SELECT g.*, s.*, ord[step] AS own, len(list_filter(ord[1 : step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS failed FROM g CROSS JOIN s),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails[own]), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails[own]), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails[own]), 0) AS redundant, coalesce(sum(n) FILTER (fails[own] AND failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails[own]), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails[own]), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def _op13_sql() -> str:
    """Each place rule by equality and prefix, and each form by its expression."""
    places = sorted(url_rules.PLACES, key=lambda r: -r.rank)
    arms = []
    for r in places:
        host, _, path = r.name.partition("/")
        arms.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", r))
    forms = [(f"regexp_matches(host || path, '{r.pattern}')", r) for r in sorted(url_rules.FORMS, key=lambda r: -r.rank)]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in arms)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in arms + forms)
    reason = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in arms + forms)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict, CASE {reason} END AS reason FROM u
"""


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_audio": op2_audio,
    "op3_imatch": op3_imatch,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_fill_middle": op11_fill_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_rules": op13_url_rules,
}

ORACLE_SQL = {"op3_imatch": _OP3_SQL, "op4_chat": _OP4_SQL, "op8_secrets": _op8_sql(), "op9_warc": _OP9_SQL, "op11_fill_middle": _OP11_SQL, "op12_filter_audit": _OP12_SQL, "op13_url_rules": _op13_sql()}
