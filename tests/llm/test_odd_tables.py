"""Every operator on odd and on empty tables: nothing crashes, and the defined results hold."""

from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, html, lm, neardup, quality, repeats, secrets, sharding, urls


def by_id(df, *names):
    return {(r["doc_id"], k): tuple(r[n] for n in names) for k, r in enumerate(df.collect())}


def bench(spark):
    rows = [(1, "three four five six seven eight nine ten eleven twelve"), (None, "one two"), (3, None), (4, "..."), (1, "three four five six seven eight nine ten eleven twelve")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_sharding(spark, odd_docs, no_docs):
    rows = sharding.shard(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count() and sorted(r.row_number for r in rows) == list(range(len(rows)))
    assert [r.size for r in rows if r.doc_id == 1] == [8] and [r.text_crc32 for r in rows if r.doc_id == 1] == [0]
    assert sharding.shard(spark, no_docs).count() == 0


def test_quality(spark, odd_docs, no_docs):
    rows = quality.judge(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r.kept and r.base_failed for r in rows if r.n_words < 10)
    assert all(r.distance is None for r in rows)  # too few rows for an estimate
    kept = quality.keep_good(spark, odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 7, 8} - ({8} if quality.judge(spark, odd_docs).filter("doc_id = 8").first().base_failed else set())
    assert quality.judge(spark, no_docs).count() == quality.keep_good(spark, no_docs).count() == 0


def test_neardup(spark, odd_docs, no_docs):
    rows = neardup.groups(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in rows if r.doc_id in (1, 2, 3, 6)} == {1: 0, 2: 0, 3: 0, 6: 1}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 4, 8: 8}
    kept = neardup.keep_one(spark, odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 4, 5, 6, 8]
    assert neardup.groups(spark, no_docs).count() == neardup.keep_one(spark, no_docs).count() == 0


def test_decontaminate(spark, odd_docs, no_docs):
    found = decontaminate.find(spark, odd_docs, bench(spark)).collect()
    assert len(found) == odd_docs.count()
    four = next(r for r in found if r.doc_id == 4)
    assert four.n_words == 12 and [tuple(s) for s in four.hit_words] == [(0, 12)] and four.item_ids == ["1"]
    assert all(r.n_words == 0 and not r.hit_words for r in found if r.doc_id in (1, 2, 3))
    clean = decontaminate.remove(spark, odd_docs, bench(spark))
    assert clean.columns == odd_docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect() if r.doc_id is not None}
    assert texts[4] == ("", 0) and texts[7] == (" extra", 6) and texts[1] == (None, None) and texts[6] == ("x", 1)
    assert decontaminate.find(spark, no_docs, bench(spark)).count() == 0
    assert all(not r.hit_words for r in decontaminate.find(spark, odd_docs, bench(spark).limit(0)).collect())


def test_secrets(spark, odd_docs, no_docs):
    assert secrets.scan(odd_docs).count() == odd_docs.count() and set(odd_docs.columns) == set(secrets.scan(odd_docs).columns)
    assert all(r.spans == "" for r in secrets.report(odd_docs).collect())
    assert secrets.redact(odd_docs).exceptAll(odd_docs).count() == 0
    assert secrets.scan(no_docs).count() == secrets.report(no_docs).count() == secrets.redact(no_docs).count() == 0


def test_bpe(spark, odd_docs, no_docs):
    rows = bpe.digests(odd_docs).collect()
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 6)} == {1: 0, 2: 0, 3: 0, 6: 1}
    encoded = bpe.decode(bpe.encode(odd_docs))
    assert encoded.count() == len(rows) and encoded.filter("doc_id = 6").first().decoded == "x</w>"
    assert bpe.digests(no_docs).count() == bpe.encode(no_docs).count() == 0


def test_lm(spark, odd_docs, no_docs):
    rows = lm.score(spark, odd_docs).collect()
    assert all((r.mean_log_prob is None) == (r.n_tokens == 0) and r.log_prob <= 0 for r in rows) and len(rows) == odd_docs.count()
    assert lm.score(spark, no_docs).count() == 0
    assert lm.score(spark, odd_docs.filter("doc_id = 1")).first().log_prob == 0


def test_repeats(spark, odd_docs, no_docs):
    rows = repeats.kept_bytes(spark, odd_docs, with_bytes=True).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_removed == 0 for r in rows if r.n_bytes < 100)
    assert repeats.kept_bytes(spark, no_docs).count() == 0


def test_html(spark, no_docs):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>"), (None, None, "<article><p>a</p></article>"), (4, "u", "<!-- x"), (5, "u", "</p><b>" * 50_000)], "page_id long, url string, html string").withColumn("main_text", F.lit(1))
    rows = {r.page_id: r.main_text for r in html.extract(pages).collect()}
    assert rows == {1: "", 2: "", 3: "", None: "a", 4: "", 5: ""}
    assert html.extract(pages.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (None, "http://a.example.net/de/8?x"), (4, "HTTP://A.COM/en/"), (4, "HTTP://A.COM/en/"), (5, "://")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 0), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [tuple(r)[:5] for r in urls.judge(spark, pages, labels).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "a.example.net", "/de/8", "example.net/de/8", "block"), (4, "a.com", "/en/", "com/en/", "block"), (4, "a.com", "/en/", "com/en/", "block"), (5, "", "", None, "allow")], key=str
    )
    assert urls.judge(spark, pages.limit(0), labels).count() == 0
    assert urls.judge(spark, pages, labels.limit(0)).count() == 7
    # names that clash, and a very long URL
    clash = pages.withColumns({c: F.lit("mine") for c in ("host", "best", "token", "confidence")}).unionByName(spark.createDataFrame([(9, "http://x.example.org/" + "a/b-c_" * 50_000 + "?q=1")], "page_id long, url string"), allowMissingColumns=True)
    got = urls.judge(spark, clash, labels, keep=("page_id", "host", "best", "url"))
    assert got.columns == ["page_id", "best", "url", *urls.JUDGED]
    assert {r.page_id: r.host for r in got.collect() if r.page_id in (4, 9)} == {4: "a.com", 9: "x.example.org"}
