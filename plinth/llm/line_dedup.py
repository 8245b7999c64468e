"""Line dedup by site-relative frequency, with DataFrame functions only.

A line with a word (anything but space and \\x09-\\x0D) is boilerplate of a site if it stands on
MIN_PAGES pages of the site or more and on more than MAX_RATIO of all pages of the site. Every
occurrence of a boilerplate line is dropped from the site's pages. The site is the page's host; the documents table
has no url, so its query takes `source` for it.

The count goes by site and a 64-bit hash of the line first, summed on the map side, so a site or a
line with a third of all rows costs each task one row. Only lines whose hash passes are counted
again as text, so colliding hashes never decide. A site has at most (its mean distinct lines) /
MAX_RATIO boilerplate lines, so a site's list is bounded whatever the table's size. Lists of BROADCAST_BYTES together
are broadcast; larger ones are joined, and there a site with more than 1 / HOT_PARTS of all pages is dealt over as many
tasks as its size asks for, its list repeated for each.

Defined results: a null text stays null and is a page of its site without lines; an empty one
stays empty. Null is a site of its own. Repeated rows are pages each. Documents that lose every
line stay, with an empty text. An empty table gives an empty one. Further columns pass through, whatever their names (one
with the name of a made column, n_lines and n_dropped if no others are told, is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, hot_keys, sha256_text, table, written

MAX_RATIO = 0.10
MIN_PAGES = 5
BROADCAST_BYTES = 8 << 20
HAS_WORD = r"[^\x20\x09-\x0D]"


def _site(site: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), col(site).cast("string")), F.lit("n"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The boilerplate lines of every site: site, line, n_pages, and total, the site's pages."""
    rows = docs.select(_site(site).alias("site"), col(text).cast("string").alias("text"))
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    lines = rows.select("site", F.explode(F.array_distinct(_lines("text"))).alias("line"))
    lines = lines.where(F.col("line").rlike(HAS_WORD)).withColumn("h", F.xxhash64("line"))
    passed = F.col("n") > F.col("total") * F.lit(max_ratio)
    likely = lines.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    likely = written(likely.join(totals, "site").where(passed).select("site", "h"), "line-hashes")
    size = likely.agg(F.sum(F.octet_length("site") + 24)).first()[0] or 0
    likely = F.broadcast(likely) if size <= BROADCAST_BYTES else likely
    exact = lines.join(likely, ["site", "h"], "left_semi").groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return exact.join(totals, "site").where(passed).select("site", "line", F.col("n").alias("n_pages"), "total")


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the boilerplate lines gone from text, and two columns more, names: the lines of the page and those dropped."""
    found = boilerplate(docs, site, text, max_ratio, min_pages)
    own, drop, part, parts, every, kept = fresh(docs, "_site", "_drop", "_part", "_parts", "_all", "_kept")
    lists = found.groupBy("site").agg(F.collect_list("line").alias(drop), F.sum(F.octet_length("line") + 16).alias("bytes"), F.first("total").alias("total"))
    lists = written(lists.withColumnRenamed("site", own), "boilerplate")
    size = lists.agg(F.sum("bytes")).first()[0] or 0
    rest = [c for c in docs.columns if c.lower() not in (n.lower() for n in names)]
    rows = docs.select(*map(col, rest)).withColumn(own, _site(site))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(lists.select(own, drop)), own, "left")
    else:
        hot = hot_keys(lists, own, "total", rows.count())
        hot = docs.sparkSession.createDataFrame([], f"`{own}` string, parts int") if hot is None else hot
        hot = hot.withColumnRenamed("parts", parts)
        by = F.xxhash64(*[col(f.name) for f in docs.select(*map(col, rest)).schema if "map<" not in f.dataType.simpleString()])
        dealt = rows.join(F.broadcast(hot), own, "left").withColumn(part, F.pmod(by, F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
        repeated = lists.select(own, drop).join(F.broadcast(hot), own, "left")
        repeated = repeated.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
        joined = dealt.join(repeated, [own, part], "left")
    # the page's own boilerplate lines first (a hash set of the list), then a filter by those few
    joined = joined.withColumn(every, _lines(col(text).cast("string"))).withColumn(drop, F.array_intersect(F.coalesce(drop, F.array().cast("array<string>")), every))
    joined = joined.withColumn(kept, F.when(F.size(drop) > 0, F.filter(every, lambda x: ~F.array_contains(F.col(drop), x))).otherwise(F.col(every)))
    left = F.when(F.size(drop) > 0, F.array_join(kept, "\n")).otherwise(col(text))
    count = lambda x: F.when(col(text).isNull(), F.lit(0)).otherwise(x).cast("long")
    return joined.select(*[left.alias(c) if c == text else col(c) for c in rest], count(F.size(every)).alias(names[0]), count(F.size(every) - F.size(kept)).alias(names[1]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_boilerplate(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", sha256_text(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def dedup_sql(source: str) -> str:
    """The same rule as SQL over a relation with doc_id, source and text."""
    return rf"""
    select d.doc_id, len(d.l)::bigint as n_lines, (len(d.l) - len(d.k))::bigint as n_dropped, d.k as kept_lines
    from (
      select p.doc_id, p.l, case when b.drops is null then p.l else list_filter(p.l, lambda x: not list_contains(b.drops, x)) end as k
      from (select doc_id, source, case when text is null then [] else string_split(text, chr(10)) end as l from {source}) p
      left join (
        select source, list(line) as drops from (
          select source, line, count(*) as n, any_value(total) as total from (
            select q.source, t.total, unnest(list_distinct(string_split(q.text, chr(10)))) as line
            from {source} q join (select source, count(*) as total from {source} group by source) t on t.source is not distinct from q.source)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line)
        where n >= {MIN_PAGES} and n > total * {MAX_RATIO}::double group by source) b
      on b.source is not distinct from p.source) d"""


OP5_SQL = f"select doc_id, n_lines, n_dropped, sha256(coalesce(array_to_string(kept_lines, chr(10)), '')) as kept_sha256 from ({dedup_sql('documents')})"
