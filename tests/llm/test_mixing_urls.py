import duckdb
import pytest
from pyspark.sql import functions as F

from riskframe.llm import mixing, urls

urls_cascade = urls.Cascade

SF = "/root/testdata/sf0.001"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    for name in ("documents", "pages"):
        if name not in tables:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    rel = con.sql(sql)
    return rel.columns, sorted(rel.fetchall(), key=str)


def same(df, sql, **tables):
    columns, want = duck(sql, **tables)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_mixing_equals_sql(spark):
    same(mixing.op8_mixing(spark, SF), mixing.SQL_OP8)


def test_mixing_odd_rows(spark):
    rows = [(k % 50, "a b c " * (k % 7), ["x", "é", None, "Z", "big", "big", "big", "tiny" if k == 8 else "big"][k % 8], "clash") for k in range(300)]
    rows += [(None, "one two", "x", None), (None, None, None, None), (7, "long " * 3000, "y", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(docs.withColumnRenamed("size", "place")).toPandas()
    assert len(got) == len(rows) and got["taken"].sum() == got["size"].sum()
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.fillna({"source": "?"}).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((per["taken"] - per["target"]).abs() <= 2 * per["most"].max()).all()
    assert per["target"].sum() == pytest.approx(got["size"].sum())
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.withColumn("text", F.lit(" "))).agg(F.sum("taken"), F.sum("target")).first()[:] == (0, 0.0)


def test_urls_equal_sql(spark):
    same(urls.op9_urls(spark, SF), urls.SQL_OP9)


def test_urls_odd_rows(spark):
    texts = [None, "", "no scheme.org/", "http://A.ORG/x?y", "http://org", "ftp://x.example.org/es/1#z", "http://example.org/en/19", "HTTP://Spam.bad.net:80/a://b", "http://bad.net?x", "http://notbad.net/", "http://x.com/fr/", "http://x.com/de/", "http://.bad.net/", "://bad.net/\n"]
    pages = spark.createDataFrame([(k, x, "h") for k, x in enumerate([*texts, texts[5]])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("BAD.net",), (None,), ("never.met",), ("org",)], "key string")
    got = {r.page_id: r for r in urls.judge_urls(pages, listed).collect()}
    assert len(got) == len(texts) + 1 and got[5][1:] == got[14][1:]
    assert [got[k].host for k in (0, 1, 2, 3, 7)] == ["", "", "", "a.org", "spam.bad.net:80"]
    assert [got[k].rule for k in (3, 4, 5, 6, 10, 11)] == ["org/", None, "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    assert [got[k].verdict for k in range(14)] == ["allow", "allow", "allow", "allow", "block", "block", "block", "allow", "block", "allow", "allow", "block", "block", "block"]
    cut = urls.judge_urls(pages, listed, cascade=urls.Cascade(part=1), at_once=2)
    assert sorted(map(str, cut.collect())) == sorted(map(str, urls.judge_urls(pages, listed).collect()))
    clash = urls.judge_urls(pages, listed, carry=("page_id", "host"))
    assert clash.columns == ["page_id", "host_in", "host", "path", "rule", "verdict"] and {r.host_in for r in clash.collect()} == {"h"}
    by_address = urls.judge_urls(pages, listed.limit(0), rules=(), addresses=spark.createDataFrame([("a.org/x",), ("x.com/fr/",), (None,), ("nowhere",)], "key string"))
    assert {r.page_id for r in by_address.where("verdict = 'block'").collect()} == {3, 10}
    assert urls.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0), rules=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.Cascade(hashes=2, bits_per_key=3).fit(keys)
    assert len(cascade.levels) > 3
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    parted = urls.Cascade(hashes=2, bits_per_key=3, part=700).fit(keys)
    assert parted.parts == 5 and keys.where(parted.contains(F.col("key")) != F.col("listed")).count() == 0
    marked = parted.mark(keys, F.col("key"), "on", at_once=2)
    assert marked.count() == 20000 and marked.where("on <> listed").count() == 0


def test_production_list_has_several_levels(spark, monkeypatch):
    made = []
    monkeypatch.setattr(urls, "Cascade", lambda: made.append(urls_cascade()) or made[-1])
    urls.op9_urls(spark, "/root/testdata/sf0.1")
    assert len(made[0].levels) > 1


def test_mixing_of_one_doc_id(spark, request):
    # small ranges as they are, not put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [(None, f"w{k} " * (1 + k % 40), "xyz"[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.range(600).select(F.col("id").alias("row"), (F.col("id") % 40).alias("size"), F.lit(1).alias("place"), F.lit(0).alias("epoch"), F.lit("a").alias("order"), F.lit(9.0).alias("target"))
    assert mixing.sliced(items).groupBy("slice").count().agg(F.max("count")).first()[0] < 400
    by_size, shuffled = mixing.mix_sources(docs).toPandas(), mixing.mix_sources(docs, shuffle_by=("text",)).toPandas()
    for got in (by_size, shuffled):
        assert len(got) == 600 and got["taken"].sum() == got["size"].sum()
    few = lambda got: got[(got["source"] == "z") & (got["taken"] > 0)]["size"]
    assert few(by_size).max() < 40 and few(shuffled).max() == 40
    again = mixing.mix_sources(docs.repartition(7), shuffle_by=("text",)).toPandas()
    assert sorted(shuffled[["size", "taken"]].values.tolist()) == sorted(again[["size", "taken"]].values.tolist())


def test_mixing_carries_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "r"), (2, None, None, 8, "s")], "doc_id long, text string, source string, size int, row string")
    got = mixing.mix_sources(docs, carry=("size", "row"))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "source", "size_in", "row"]
    assert {(r.doc_id, r["size"], r.size_in, r.row) for r in got.collect()} == {(1, 2, 7, "r"), (2, 0, 8, "s")}
