"""Sitemaps as a data source: batch, stream, index, pushed filters and files that cannot be read."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from lodestone.sources import sitemap_source as s
from lodestone.sources.pages import sitemaps


def _map(urls):
    return "<urlset>" + "".join(f"<url><loc> {u} </loc><lastmod>2024</lastmod></url>\n" for u in urls) + "</urlset>"


@pytest.fixture
def folder(tmp_path):
    for i in range(5):
        (tmp_path / f"map-{i}.xml").write_text(_map(f"https://shop.example.org/p{i}/{j}?a=1&amp;b={j}" for j in range(30)))
    (tmp_path / "zipped.xml.gz").write_bytes(gzip.compress(_map(["https://other.example.org/é"]).encode()))
    (tmp_path / "broken.xml.gz").write_bytes(b"no gzip at all")
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


def _read(spark, **options):
    spark.dataSource.register(s.SitemapSource)
    return spark.read.format("sitemaps").options(**options).load()


def test_batch_and_errors(spark, folder):
    found = _read(spark, path=str(folder), taskBytes="3000")
    got = found.collect()
    good = [r["url"] for r in got if r["error"] is None]
    assert len(good) == 151 and "https://shop.example.org/p4/29?a=1&b=29" in good and "https://other.example.org/é" in good
    assert [r["file"].rsplit("/", 1)[1] for r in got if r["error"] is not None] == ["broken.xml.gz"] and all((r["url"] is None) == (r["error"] is not None) for r in got)
    assert found.rdd.getNumPartitions() > 2
    assert sorted(r["url"] for r in sitemaps(spark, f"file://{folder}/map-*.xml").collect()) == sorted(u for u in good if "shop" in u)  # the column function


def test_index_with_missing_children(spark, folder):
    (folder / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>https://shop.example.org/{n}</loc></sitemap>" for n in ("map-1.xml", "gone.xml", "map-1.xml", "map-3.xml?x=1")) + "</sitemapindex>")
    got = _read(spark, path=f"{folder}/index.xml", index="true").groupBy("file").agg(F.count("url").alias("n"), F.count("error").alias("errors")).collect()
    assert {r["file"].rsplit("/", 1)[1]: (r["n"], r["errors"]) for r in got} == {"map-1.xml": (30, 0), "map-3.xml": (30, 0), "gone.xml": (0, 1)}


def test_pushed_filters(spark, folder):
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    want = lambda **o: sorted(r["url"] for r in _read(spark, path=str(folder), **o).where(F.col("url").startswith("https://shop.example.org/p2/") & F.col("file").isin(f"{folder}/map-2.xml", f"{folder}/map-3.xml")).collect())
    plain = want()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert want(pushFilters="true") == plain and len(plain) == 30
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)
    reader = s.PushingReader({"path": str(folder)})
    left = list(reader.pushFilters([s.StringStartsWith(("url",), "https://o"), s.EqualTo(("error",), "x"), s.EqualTo(("file",), f"{folder}/zipped.xml.gz")]))
    parts = reader.partitions()
    assert len(left) == 1 and [f for p in parts for f in p.files] == [f"{folder}/zipped.xml.gz"]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1


def test_stream_agrees_with_batch_and_goes_on_after_a_restart(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")
    spark.dataSource.register(s.SitemapSource)

    def run():
        stream = spark.readStream.format("sitemaps").option("path", str(folder)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/check").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["file"], r["url"] or "", r["error"] is None) for r in spark.read.parquet(f"{at}/out").collect())

    batch = lambda: sorted((r["file"], r["url"] or "", r["error"] is None) for r in _read(spark, path=str(folder)).collect())
    assert run() == batch() == run()  # a further run finds nothing new
    (folder / "later.xml").write_text(_map(["https://shop.example.org/later"]))
    assert run() == batch()


def test_blocks_and_plans(monkeypatch):
    urls = [f"https://shop.example.org/{'x' * (i % 40)}{i}" for i in range(500)]
    monkeypatch.setattr(s, "LONGEST", 200)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(s, "BLOCK", size)
        assert list(s.addresses(io.BytesIO(_map(urls).encode()))) == urls
        assert list(s.addresses(io.BytesIO(b"<loc>" + b"y" * 5000 + _map(["https://a.example.org"]).encode())))[-1:] == ["https://a.example.org"]
    assert [p.files for p in s.planned([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10)] == [["a", "b"], ["c"], ["d"]]
