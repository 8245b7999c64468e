"""What the tables of the tests don't show: cut references, one small file, many pages a city."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plinth.functions.html import _job_type, _listings, article_text, listing
from plinth.functions.identity import with_identity
from plinth.plans import feature_queries
from plinth.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_cut_references_are_as_in_the_sql(spark, tmp_path):
    heads = ["and&amp", "and&amp;&am", "a&quot", "b&", "c&lt d", "x &amp;lt; y&nbsp;z", "&copy 2024 &copy;"]
    pages = [(k, f'<title>t</title><article><h1>{h}</h1><p>more&amp;&amp;</p></article><script>"&amp"</script>') for k, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r["page_id"]: r["article"] for r in QUERIES["q_html_article_udf"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["q_html_article_udf"]).fetchall()) and got[0] == "and&amp more&&"
    assert article_text(pages[0][1]) == "and& more&&"
    assert article_text("<article>a&amp<script>b&amp</script><!-- & --></article>", terminated=True) == "a&amp b&amp"


@pytest.mark.parametrize("name", ["q_detail_fields", "q_listing_meta", "q_invalid_postings"])
def test_one_small_file_is_worked_on_by_all_cores(spark, name):
    """The driver's part table of a million rows is one row group, so its pages were parsed by one task."""
    tasks = QUERIES[name](spark, SF).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= 4 * spark.sparkContext.defaultParallelism


def test_an_identity_computes_each_part_of_its_url_once(spark):
    """The parts written into each other were dozens of regular expressions a row."""
    jobs = spark.range(1).select(F.lit("t").alias("title"), F.lit("Tempe").alias("city"), F.col("id").cast("string").alias("url"), F.col("id").alias("pos"))
    plan = with_identity(jobs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 12


def test_a_batch_of_listings_is_never_whole_as_python_objects():
    item = '<li class="list-item" data-job-id="{0}"><a class="item-details-link" href="/jobs/{0}/y">Post {0}</a></li>'.format
    pages = ["".join(item(20 * n + k) for k in range(20)) for n in range(320)]
    kind = pa.struct([("jobs", pa.list_(to_arrow_type(_job_type()))), ("next_page", pa.int32()), ("reported_count", pa.int32())])
    columns = (*(pa.array([v] * len(pages)) for v in ("Tempe", "https://e.gov", "tempe")), pa.array(range(len(pages))), pa.array(pages))
    tracemalloc.start()
    whole = [listing(h, "Tempe", "https://e.gov", "tempe", n) for n, h in enumerate(pages)]
    all_at_once, expected = tracemalloc.get_traced_memory()[1], pa.array(whole, kind)
    del whole
    tracemalloc.stop()
    tracemalloc.start()
    got = _listings(columns, kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(expected) and peak < all_at_once / 3


def test_stored_pages_are_read_a_block_at_a_time(spark, tmp_path, monkeypatch):
    """Each page read all pages of its city, so a city's reads grew with the square of its pages."""
    block = feature_queries.PAGE_BLOCK
    rows = spark.range(1, 2 * block + 3).select(F.lit("a").alias("agency"), F.floor(F.col("id") / block).alias("block"), F.col("id").alias("page"), F.concat(F.lit("p"), "id").alias("html"))
    rows.repartition("block").write.partitionBy("agency", "block").parquet(f"{tmp_path}/pages")
    read, read_table = [], feature_queries.pq.read_table
    monkeypatch.setattr(feature_queries.pq, "read_table", lambda *a, **how: read.append(1) or read_table(*a, **how))
    fetch = feature_queries._stored_fetch(f"{tmp_path}/pages")
    assert all(fetch("u", {"agency": "a", "page": n}) == f"p{n}" for n in range(1, 2 * block + 3)) and len(read) == 3
