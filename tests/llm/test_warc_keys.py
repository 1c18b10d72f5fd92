"""Archives of pages whose keys are no numbers."""

from acreline.llm import warc
from acreline.llm.common import new_dir


def test_string_keys_come_back(spark):
    """Any signs, the word null, empty keys, nulls and repeated rows; the digest of a revisit is its response's."""
    keys = ["a", "null", "", None, "x>y\r\nz: é", "urn:null", "a b%20", "10", "9"]
    pages = [(k, f"http://h/{i}", f"<p>{i % 3}</p>", "clash") for i, k in enumerate(keys)] + [("a", "http://h/0", "<p>0</p>", "clash")]
    paths = warc.write_archives(spark.createDataFrame(pages, "name string, link string, body string, path string"), new_dir(spark, "warc"), "name", "link", "body")
    got = warc.read_archives(paths).collect()
    assert sorted((r.page_id is None, r.page_id or "", r.url) for r in got) == sorted((p[0] is None, p[0] or "", p[1]) for p in pages)
    low = {}
    for k, _, h, _ in pages:
        if k is not None:
            low[h] = min(low.get(h, k), k)
    html = {r.payload_digest: r.html for r in got if r.record_type == "response"}
    for r in got:
        h = html[r.payload_digest]
        assert r.refers_to == (None if r.page_id == low[h] else low[h]) and (r.record_type == "response") == (r.refers_to is None)


def test_number_keys_keep_their_type(spark):
    for kind in ("int", "bigint", "decimal(20,0)"):
        pages = spark.createDataFrame([(1, "u", "x"), (None, "u", "x"), (2, "u", "y")], "page_id long, url string, html string").selectExpr(f"cast(page_id AS {kind}) AS page_id", "url", "html")
        got = warc.read_archives(warc.write_archives(pages, new_dir(spark, "warc")))
        assert dict(got.dtypes)["page_id"] == kind and {r.page_id for r in got.collect()} == {1, None, 2}


def test_repeated_row_is_no_single_archive(spark):
    pages = spark.range(20_000).selectExpr("1L AS page_id", "'u' AS url", "'same' AS html").repartition(8)
    paths = warc.write_archives(pages, new_dir(spark, "warc"))
    n = [r.n_records for r in paths.collect()]
    assert sum(n) == 20_000 and max(n) < 10_000
