import corpus_pipeline
from corpusloom.llm import secret_index, toxicity_chain


def test_stages(spark, small, tmp_path):
    small = small.replace("sf0.001", "sf0.01")  # the smallest table has eleven toxic documents, too few to learn from
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        path = str(tmp_path / name)
        out.write.parquet(path)
        held[name] = docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    assert list(held) == ["toxicity", "simhash_near_dedup", "secret_scan", "packing"]
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = {r.doc_id for r in held["toxicity"].collect()}
    assert clean >= {d for d, t in labels.items() if not t}
    toxic = {d for d, t in labels.items() if t}
    assert len(toxic - clean) >= 0.7 * len(toxic)
    kept = {r.doc_id: r.text for r in held["simhash_near_dedup"].collect()}
    first = {}
    for d in sorted(clean):
        first.setdefault(" ".join(source[d].lower().split()), d)
    assert set(kept) <= set(first.values())  # of equal texts the one with the smallest id at most
    after = {r.doc_id: r for r in held["secret_scan"].collect()}
    assert set(after) == set(kept)
    found = secret_index.find_secrets(held["secret_scan"]).collect()
    assert not any(s.n != 2 and s.n != 0 for r in found for s in r.secrets)
    assert all(r.n_chars == len(r.text) for r in after.values() if "[REDACTED]" in r.text)
    pieces = held["packing"].collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert toxicity_chain.THRESHOLD < 1


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).select("doc_id").distinct().count() > 0


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "secrets", "_redacted", "_kinds", "_row", "_hit", "spans", "done", "_gone", "rid", "node", "hash", "c1"]


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and names that stages use for themselves."""
    key = "token=abcdef1234567890 " + "AKIA" + "Z9" * 12
    texts = ["a plain text of some more words here", "a plain text of some more words here", None, "", " ", key, "long words " * 30_000, key + " again and again", None]
    rows = [(None if i in (3, 8) else i % 7, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 4 else 5, *[f"own {i}"] * (len(NAMES) - 5)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES))


def test_stages_on_odd_documents(spark, small, tmp_path):
    docs = odd_documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, small)
        assert out.columns == NAMES and out.schema == docs.schema, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows, source = docs.collect(), {tuple(r[5:]) for r in before.collect()}
        assert all(tuple(r[5:]) in source for r in rows)  # other columns are carried as they are
        if name == "secret_scan":
            assert len(rows) == before.count() and sum("[REDACTED]" in (r.text or "") for r in rows) == 2
            assert all(r.n_chars == len(r.text) for r in rows if "[REDACTED]" in (r.text or ""))
        if name == "simhash_near_dedup":
            # the plain text once, one of the texts without words, and the three others
            assert sorted(len(r.text or "") for r in rows if (r.text or "").strip()) == sorted({len(r.text) for r in before.collect() if (r.text or "").strip()})
            assert sum(not (r.text or "").strip() for r in rows) == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_stages_on_an_empty_table(spark, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark).limit(0), small).count() == 0, name


def test_near_duplicates_against_brute_force(spark, small):
    """The stage on a whole table: of each component by exact similarity the smallest id, and nothing else, stays."""
    from corpusloom.llm import simhash_blocks as sb

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets, root = {d: frozenset(sb.shingle_hashes(t, 5).tolist()) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()}
    assert kept == set(root.values()) and len(kept) < len(texts)


def test_toxicity_against_the_chain(spark, small):
    """The stage keeps exactly the documents that the chain's probabilities, by hand from its weights, leave below the threshold."""
    import numpy as np

    small = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    chain = toxicity_chain.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    index, want = toxicity_chain.Index(chain.words), set()
    for r in docs.collect():
        seen, x = [], np.zeros(len(chain.words))
        for k, n in toxicity_chain.count_words(r.text, index).items():
            x[k] = np.log1p(n)
        for use, w in zip(chain.uses, chain.weights, strict=True):
            seen.append(1 / (1 + np.exp(-(x[use] @ w[: len(use)] + np.dot(seen, w[len(use) : -1]) + w[-1]))))
        if seen[-1] < toxicity_chain.THRESHOLD:
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()} == want
