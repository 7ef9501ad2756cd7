import pytest
from corpusloom.functions import text
from corpusloom.operators import caches
from corpusloom.sources import readability as rd
from pyspark.sql import functions as F

LONG = "Words of a text that goes on. " * 12


def test_ways_to_the_content():
    read = lambda html: rd.main_content(list((t := rd.tree(html)).walk()), t)
    assert read(f"<body><nav>n</nav><main>{LONG}</main></body>") == ("semantic", LONG.strip())
    assert read(f"<body><section><p>{LONG}<p>more</section></body>") == ("score", LONG + "more")
    assert read(f"<body><section>{LONG}</section><div>short</div></body>") == ("size", LONG.strip())
    assert read("<body>short</body>") == ("body", "short")
    assert read(f'<div class="a content b">{LONG}</div>')[0] == "semantic" and read(f'<div class="contents">{LONG}</div>')[0] != "semantic"


def test_scores_of_elements():
    score = lambda html: rd.element_score(next(rd.tree(html).walk()))
    assert score("<div>short</div>") == 0.0
    words = "word " * 120
    assert abs(score(f'<div class="story"><p>{words}</p></div>') - (0.3 + 0.05 + 0.2 + 0.3)) < 1e-9
    assert score(f'<div class="sidebar"><a>{words}</a><a>x</a></div>') == 0.0  # links and a name against it


def test_public_content():
    html = (
        '<head><title>T - Site</title><meta name="author" content=" A "><meta property="article:tag" content="x"><meta property="article:tag" content="y"><meta name="description" content="short"></head>'
        f'<body><h1>A heading of some length</h1><h2>short</h2><div class="lead">{LONG}</div><p>{LONG}</p><p>Subscribe {LONG}</p><p>no</p><time pubdate datetime="2024-01-01">d</time></body>'
    )
    elements = list(rd.tree(html).walk())
    told = rd.public_content(elements, "T - Site")
    assert told["title"] == "A heading of some length" and told["author"] == "A" and told["tags"] == ["x", "y"] and told["date"] == "2024-01-01"
    assert told["excerpt"] == LONG.strip() and told["summary"] == LONG.strip() and told["headings"] == [{"level": 1, "text": "A heading of some length"}]
    assert rd.site_name(elements, "T - Site", "h") == "Site" and rd.site_name(elements, "T", "h") == "h"
    assert [rd.complexity(list(rd.tree(h).walk())) for h in ("<p>", "<iframe></iframe>", "<script></script>" * 21)] == ["low", "medium", "high"]


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://h/", ""), (3, "x", "</p></div><b><p>a<p>b")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in rd.read_pages(df).collect()}
    assert rows[1].content == "" and rows[2].site_name == "h" and rows[3].content == "ab"


def test_hashes(spark):
    def plain(s):
        h = 0
        units = s.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "big")) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        digits, n = "", abs(h)
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        return ("-" if h < 0 else "") + (digits or "0")

    words = ["", "a", "hello world", "é漢🙂", "x" * 300, "polygenelubricants"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r[0] for r in df.select(text.hash_base36(F.col("t"))).collect()] == [plain(w) for w in words]


def test_cache_hits(spark):
    schema = "key string, url string, content_type string, content_hash string, size long, created_at long, expires_at long, accesses long"
    old = spark.createDataFrame([("a", "u", "t", "h1", 5, 1, 10, 1), ("b", "u", "t", "h2", 5, 1, 10, 1)], schema)
    new = spark.createDataFrame([("a", "u", "t", "h1", 9, 5, 50, 1), ("b", "u", "t", "h3", 9, 5, 60, 1), ("c", "v", "t", "h", 1, 5, 70, 1), ("c", "v", "t", "h", 1, 6, 80, 1)], schema)
    got = {r.key: (r.content_hash, r.size, r.expires_at) for r in caches.put(old, new).collect()}
    assert got == {"a": ("h1", 5, 50), "b": ("h3", 9, 60), "c": ("h", 1, 80)}
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "request_id long, key string")
    answered = caches.get(caches.put(old, new), asked, F.lit(50))
    assert {r.request_id: r.hit for r in answered.collect()} == {1: True, 2: True, 3: False}
    assert {r.key: r.accesses for r in caches.touched(old, answered).collect()} == {"a": 3, "b": 1}
    assert caches.get(old, asked, F.lit(11)).where("hit").count() == 0


def test_text_files_of_odd_pages(spark, tmp_path):
    """Empty, null and marked texts come back, sizes are those of each file, and packed files are unpacked."""
    import gzip
    import hashlib

    from corpusloom.plans import catalog
    from corpusloom.sources import files

    pages = [(1, "u", "a\nb\r\n"), (2, "u", ""), (3, "u", "\x01"), (4, "u", "x" * (1 << 20)), (5, "u", "y" * ((1 << 20) - 1)), (6, "u", "é\x01"), (7, "u", None), (8, "u", "\x01\x01")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.name: (r.content, r.small) for r in catalog.queries_web.text_files(spark, str(tmp_path)).collect()}
    assert got == {f"{n}.txt": (t if t is None else hashlib.sha256(t.encode()).hexdigest(), t if t is None else len(t.encode()) < 1 << 20) for n, _, t in pages}
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "a.md").write_text("# x\n")
    (tmp_path / "some" / "b.txt.gz").write_bytes(gzip.compress("zé".encode()))
    assert sorted((r.path.rsplit("/", 1)[1], r.content, r.document_type) for r in files.text_files(spark, str(tmp_path / "some")).collect()) == [("a.md", "# x\n", "Markdown"), ("b.txt.gz", "zé", "PlainText")]
    texts = spark.createDataFrame([(f"{n}.txt", str(n)) for n in range(50)], "name string, content string").repartition(3)
    for _ in range(2):  # written again, each file stays one
        assert files.write_texts(texts, str(tmp_path / "many"), a_folder=10) == 50
    assert sorted(r.content for r in files.text_files(spark, str(tmp_path / "many" / "*")).collect()) == sorted(map(str, range(50)))


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """No plan of the driver holds the files, and paths are found as Spark finds them."""
    from corpusloom.sources import files

    names = ["a/1.txt", "a/2.md", "a/.hidden", "a/_hidden", "a/inner/3.txt", "a/k=v/4.txt", "b/5.txt", "b/6.gz.txt", "b/a b.txt", "c1/7.txt", "8.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "b" / "empty.txt").write_text("")

    def read(path):
        df = files.text_files(spark, f"{tmp_path}/{path}")
        listing = files.folder_listing(spark, f"{tmp_path}/{path}")
        assert not [f for x in (df, listing) for f in x.inputFiles() if f.endswith((".txt", ".md"))]
        got = sorted(r.content for r in df.collect())
        assert sorted(n.rsplit("/", 1)[-1] for n in got) == sorted(r.name for r in listing.collect())
        return got

    assert read("a") == ["a/1.txt", "a/2.md", "a/k=v/4.txt"]
    assert read("{a,b}") == ["a/1.txt", "a/2.md", "a/k=v/4.txt", "b/5.txt", "b/6.gz.txt", "b/a b.txt"]
    assert read("[^ab]*") == ["8.txt", "c1/7.txt"]
    assert read("*/[0-5].txt") == ["a/1.txt", "b/5.txt"]
    assert read("b/5.txt") == ["b/5.txt"]
    with pytest.raises(FileNotFoundError):
        files.text_files(spark, f"{tmp_path}/none")
