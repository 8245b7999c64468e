"""Queries of the operators that keep state, indexes or counts: cells, the transactional cache, as-of joins, upserts, sketches, table functions."""

from __future__ import annotations

import datetime
import json

import pyarrow.parquet as pq
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.documents import profile_keywords
from ..functions.html import parse_listings
from ..functions.table_functions import register
from ..functions.text import advice_card, fenced, rounded_score
from ..operators.asof import asof
from ..operators.cells import search_cells, write_cells
from ..operators.dedup import fingerprints
from ..operators.filters import filter_jobs
from ..operators.models import embedded, hashed_words
from ..operators.observed import Progress
from ..operators.spread import spread
from ..schemas import PROFILE
from ..sources.cache_store import commit_jobs, opened, read_committed
from ..sources.portal import portal_source
from ..sources.sketches import replaced, sketched, total
from ..streaming.ingest import lifetimes
from .profile import upserted
from .queries import ASOF, DIMENSIONS, HOURS, _scratch, _t, query

NEAR = 10


def _cells(spark, sf_dir, **how):
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = f"{_scratch(spark)}/index"
    write_cells(vectors, path, "vec_id")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search_cells(spark, path, asked, "vec_id", NEAR, **how).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
select query_id, r::integer as rank, vec_id, round(d, 6) as distance from (
  select *, row_number() over (partition by query_id order by d, vec_id) as r from (
    select q.vec_id as query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as d
    from embeddings q, embeddings e where q.vec_id % 20 = 0))
where r <= {NEAR}""")
def q_cells_exact(spark, sf_dir):
    """Every twentieth vector against all by the cell index, going on until no cell can hold a nearer one."""
    return _cells(spark, sf_dir, exact=True)


@query()
def q_cells_approximate(spark, sf_dir):
    """The same by as many cells as the index was found to need; tests measure the recall."""
    return _cells(spark, sf_dir)


def _as_jobs(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("Opening "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("city"), F.concat(F.lit("https://jobs.example.gov/jobs/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.col("lang").alias("department"), F.col("doc_id").alias("pos"))


@query(f"""
with d as (select *, doc_id // 2 as job from documents),
old as (select source, count(distinct job) as n from d group by source),
new as (select source, count(distinct job) as n from d where lang = 'en' group by source)
select o.source as city, case when o.source like '%1' then coalesce(new.n, 0) else o.n end as jobs, case when o.source like '%1' then coalesce(new.n, 0) else o.n end as job_count
from old o left join new using (source)""")
def q_cache_commit(spark, sf_dir):
    """All sources as cities in one save, then some of them again with fewer jobs in another."""
    jobs, path = _as_jobs(spark, sf_dir), _scratch(spark)
    cities = jobs.select("city").distinct()
    again = F.col("city").like("%1")
    commit_jobs(jobs, cities, path, ASOF - datetime.timedelta(hours=1))
    commit_jobs(jobs.where(again & (F.col("department") == "en")), cities.where(again), path, ASOF)
    found, manifest = read_committed(spark, path, "title string, city string, url string, department string, pos long, job_id string", ASOF, HOURS)
    per = found.groupBy("city_key").agg(F.count(F.lit(1)).alias("jobs"))
    return manifest.join(per, "city_key", "left").select("city", F.coalesce("jobs", F.lit(0)).alias("jobs"), "job_count")


@query("""
select count(*) as unfiltered, count(*) filter (list_has_all(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), ['small'])) as retained from part""")
def q_search_counts(spark, sf_dir):
    """The counts of one run of a filtered search, observed on its way."""
    progress = Progress()
    jobs = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("department"))
    kept = progress.at(filter_jobs(progress.at(jobs, "unfiltered"), title="Small"), "retained")
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(progress.counts().values())], "unfiltered long, retained long")


_PLACE = "row(ts, event_id)"


@query(f"""
with u as (
  select user_id as session_id, min(ts) as first_at,
    arg_max(event_type, {_PLACE}) filter (event_type <> 'error') as name,
    arg_max(props, {_PLACE}) filter (value > 20) as degree,
    count(*) filter (event_type = 'error') > 0 as sets, arg_max(value > 30, {_PLACE}) filter (event_type = 'error') as tells,
    arg_max(event_id, {_PLACE}) filter (event_type = 'error') as told
  from events where user_id is not null and ts is not null group by user_id)
select coalesce(c_custkey, session_id) as session_id, coalesce(u.name, c_name) as name, coalesce(u.degree, c_mktsegment) as degree,
  case when coalesce(sets, false) then case when tells then 'parsed ' || told end else 'old' end as summary,
  strftime(coalesce(case when c_custkey % 2 = 0 then timestamp '2023-01-01' end, first_at), '%Y-%m-%d %H:%M:%S') as created_at
from customer full join u on c_custkey = session_id
where coalesce(c_custkey, session_id) is not null""")
def q_profile_upsert(spark, sf_dir):
    """Customers as profiles; events as updates of users, some of whom are customers."""
    parsed = lambda summary: F.struct(*(summary.alias(f.name) if f.name == "summary" else F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE["resume_parsed"].dataType))
    none = lambda *told: [F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE if f.name not in told]
    old = F.when(F.col("c_custkey") % 2 == 0, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at")
    profiles = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("degree"), parsed(F.lit("old")).alias("resume_parsed"), old, *none("name", "degree", "resume_parsed", "created_at"))
    error = F.col("event_type") == "error"
    resume = F.when(error & (F.col("value") > 30), parsed(F.concat(F.lit("parsed "), F.col("event_id").cast("string")))).alias("resume_parsed")
    updates = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(~error, F.col("event_type")).alias("name"), F.when(F.col("value") > 20, F.col("props")).alias("degree"), resume, error.alias("sets_resume_parsed"), *none("name", "degree", "resume_parsed"))
    made = upserted(profiles, updates)
    return made.select("session_id", "name", "degree", F.col("resume_parsed.summary").alias("summary"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""
select e.event_id, max(e.user_id) as user_id, arg_max(v.value, row(v.ts, v.event_id)) as version_value, arg_max(v.event_id, row(v.ts, v.event_id)) as version_id
from events e left join (select * from events where event_type = 'purchase') v on v.user_id = e.user_id and v.ts <= e.ts
where e.event_type <> 'purchase' group by e.event_id""")
def q_cache_asof(spark, sf_dir):
    """Each event of a user with the user's last purchase at its time, as a search sees the last version of a city's cache."""
    events = _t(spark, sf_dir, "events")
    versions = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("cached_at"), F.col("value").alias("version_value"), F.col("event_id").alias("version_id"), F.col("event_id").alias("seq"))
    rows = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return asof(rows, versions, "user_id", "ts", "cached_at", ["version_value", "version_id"], "seq").select("event_id", "user_id", "version_value", "version_id")


@query("select count(*)::bigint as job_count, count(distinct md5(text)) as exact, true as within from documents")
def q_cache_sketches(spark, sf_dir):
    """Different texts over all sources, by merged sketches of the sources (one of them sketched again), held against the exact count."""
    jobs = _t(spark, sf_dir, "documents").select(F.col("source").alias("city"), F.md5("text").alias("job_id"))
    manifest = replaced(sketched(jobs, "city", "job_id"), sketched(jobs.where(F.col("city").like("%1")), "city", "job_id"), "city")
    exact = jobs.agg(F.count_distinct("job_id").alias("exact"))
    return total(manifest).join(exact).select("job_count", "exact", F.col("exact").between(F.col("lower"), F.col("upper")).alias("within"))  # one row each


def _listing_pages(spark, sf_dir):
    """Part names as postings, ten to a page, brands as cities; each posting is on its page and on the next one."""
    part = _t(spark, sf_dir, "part").where("p_partkey is not null")
    item = F.format_string('<li class="list-item" data-job-id="%d"><a class="item-details-link" data-department-name="%s" href="/careers/x/jobs/%d/y">%s</a><ul class="list-meta"><li>Tempe, AZ</li></ul></li>', "p_partkey", "p_brand", "p_partkey", "p_name")
    rows = part.select(F.col("p_brand").alias("city"), "p_partkey", item.alias("item"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = rows.withColumn("page", (F.floor(F.col("p_partkey") / 10) + F.col("k")).cast("int"))
    pages = rows.groupBy("city", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "").alias("html"))
    return pages.withColumns({"origin": F.lit("https://www.governmentjobs.com"), "agency": F.lit("Tempe")})


@query("select p_partkey as posting, p_name as title, (p_partkey // 10 + k)::integer as source_page from part, (values (0), (1)) t(k)")
def q_posting_rows(spark, sf_dir):
    register(spark)
    _listing_pages(spark, sf_dir).createOrReplaceTempView("listing_pages")
    return spark.sql("select cast(j.posting_id as long) as posting, j.title, j.source_page from listing_pages p, lateral posting_rows(p.html, p.city, p.origin, p.agency, p.page, fields => 'posting_id, title, source_page') j")


@query("select p_partkey as posting, p_brand as city, p_name as title, 'Tempe, AZ' as location, (p_partkey // 10)::integer as source_page from part")
def q_city_postings(spark, sf_dir):
    register(spark)
    _listing_pages(spark, sf_dir).createOrReplaceTempView("listing_pages")
    return spark.sql("select cast(posting_id as long) as posting, city, title, location, source_page from city_postings(table(listing_pages))")


@query("""
with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before, lead(ts) over (partition by user_id order by ts) as after from events where user_id is not null and ts is not null),
last as (select max(ts) - interval 1 hour as watermark from events)
select user_id, 'new' as event, count(*) as n from e where before is null or ts > before + interval 6 hour group by user_id
union all
select user_id, 'expired', count(*) from e, last where (after is null and ts + interval 6 hour <= watermark) or after > ts + interval 6 hour group by user_id""")
def q_lifetimes(spark, sf_dir):
    """Users of the events as cities whose cache lives for six hours after each event: how often each was new and expired."""
    path = _scratch(spark)
    events = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = lifetimes(stream, ["user_id"], "at", datetime.timedelta(hours=6))
    done = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    done.awaitTermination()
    return spark.read.schema("user_id long, at timestamp, event string, event_at timestamp").parquet(f"{path}/out").groupBy("user_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("""
select p_partkey, case when p_partkey % 3 > 0 then (p_partkey % 50 + 2)::integer end as next_page, (p_partkey * 1000 + 7)::integer as reported_count, p_type as categories, p_brand as department
from part""")
def q_listing_meta(spark, sf_dir):
    """A listing page a part: its next page, the count it reports, and the prefixed entries of its posting."""
    follow = F.when(F.col("p_partkey") % 3 > 0, F.format_string('<ul class="pagination"><li><a rel="next" aria-disabled="false" href="/careers/Home?page=%d">Next</a></li></ul>', F.col("p_partkey") % 50 + 2)).otherwise(F.lit('<ul class="pagination"><li><a rel="next" aria-disabled="true" href="?page=9">Next</a></li></ul>'))
    html = F.concat(
        F.lit('<span id="job-postings-number">'), F.format_number(F.col("p_partkey") * 1000 + 7, 0), F.lit("</span><ul>"),
        F.format_string('<li class="list-item" data-job-id="%d"><a class="item-details-link" href="/careers/x/jobs/%d/y">Post</a><ul class="list-meta"><li>Tempe, AZ</li><li>Full Time</li><li>Category: %s</li><li>Department: %s</li></ul></li>', "p_partkey", "p_partkey", "p_type", "p_brand"),
        F.lit("</ul>"), follow,
    )
    part = spread(_t(spark, sf_dir, "part").where("p_partkey is not null").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    pages = part.select("p_partkey", F.lit("Tempe").alias("city"), F.lit("https://www.governmentjobs.com").alias("origin"), F.lit("tempe").alias("agency"), F.lit(1).alias("page"), html.alias("html"))
    found = parse_listings(pages)
    return found.select("p_partkey", "next_page", "reported_count", F.col("jobs")[0]["raw_data"]["categories"].alias("categories"), F.col("jobs")[0]["department"].alias("department"))


@query("select event_id, format('{:.1f}', value * 7 / 3)::double as score from events where value is not null")
def q_score_rounding(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("value is not null").select("event_id", rounded_score(F.col("value") * 7 / 3).alias("score"))


@query(r"""
select conv_id, turn, md5(case when turn % 3 = 2 or inner_ = '' then trim(reply) else inner_ end) as digest from (
  select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as inner_,
    case turn % 3 when 0 then 'Here: ```json' || chr(10) || text || chr(10) || '``` ok' when 1 then '```' || chr(10) || text else text end as reply from conversations)""")
def q_code_fence(spark, sf_dir):
    """Turns of conversations as replies of a model: fenced, fenced without an end, and bare."""
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here: ```json\n"), "text", F.lit("\n``` ok"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), "text")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fenced(reply)).alias("digest"))


@query("""
select p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' ') || [p_brand, p_type, upper(p_name)], lambda x: lower(x)))), '|') as keywords from part""")
def q_keyword_sets(spark, sf_dir):
    parsed = F.struct(F.split("p_name", " ").alias("skills"))
    keywords = profile_keywords({"resume_parsed": parsed, "interests": F.array("p_brand", "p_type", F.upper("p_name"))}.__getitem__)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(keywords), "|").alias("keywords"))


_WORD = "select p_partkey, w, count(*) as n from (select p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) as w from part) where w <> '' group by all"


@query(f"""
with b as (select p_partkey, ('0x' || substr(md5(w), 15, 2))::integer % {DIMENSIONS} as i, sum(case when substr(md5(w), 1, 1) >= '8' then n else -n end) as v from ({_WORD}) group by all)
select p.p_partkey, coalesce(string_agg(i || ':' || round(v / s, 4), ' ' order by i), '') as vector
from part p left join (select *, sqrt(sum(v * v) over (partition by p_partkey)) as s from b) b on b.p_partkey = p.p_partkey and v <> 0 group by p.p_partkey""")
def q_embedding_vectors(spark, sf_dir):
    """Part names by the hashing provider with a hash that SQL has: the places of each vector that aren't 0."""
    made = _t(spark, sf_dir, "part").select("p_partkey", embedded(F.col("p_name"), hashed_words(DIMENSIONS, "md5"), DIMENSIONS).alias("e"))
    places = F.filter(F.transform("e", lambda x, i: F.struct(i.alias("i"), F.round(x.cast("double"), 4).alias("x"))), lambda p: p["x"] != 0)
    return made.select("p_partkey", F.array_join(F.transform(places, lambda p: F.concat(p["i"].cast("string"), F.lit(":"), p["x"].cast("string"))), " ").alias("vector"))


@query("select o_custkey, md5(string_agg(distinct o_orderkey::varchar, '|' order by o_orderkey::varchar)) as fingerprint from orders group by o_custkey")
def q_fingerprints(spark, sf_dir):
    """The orders of each customer as the jobs of an index, hashed without an array of them."""
    return fingerprints(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


_NONE = {"strengths": "No specific strengths identified", "keywords": "No keywords suggested", "skill-gaps": "No major skill gaps", "improvements": "No specific improvements suggested"}
_HEAD = {"strengths": "Your strengths", "keywords": "Keywords to add", "skill-gaps": "Skill gaps to address", "improvements": "Resume improvements"}
_ITEMS = {"strengths": "case when event_id % 2 = 0 then '<li>' || event_type || '</li><li>a &amp; b</li>' end", "keywords": "'<li>' || replace(props, '\"', '&quot;') || '</li>'", "skill-gaps": "null", "improvements": "null"}


@query("select event_id, '<article class=\"advice\">' || " + " || ".join(f"""'<section class="{n}"><h4>{_HEAD[n]}</h4>' || coalesce('<ul>' || {x} || '</ul>', '<p>{_NONE[n]}</p>') || '</section>'""" for n, x in _ITEMS.items()) + " || '</article>' as card from events")
def q_advice_card(spark, sf_dir):
    strengths = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("a & b"))).otherwise(F.array().cast("array<string>"))
    advice = F.struct(strengths.alias("strengths"), F.array("props").alias("keywords"), F.array().cast("array<string>").alias("skill_gaps"), F.lit(None).cast("array<string>").alias("improvements"))
    return _t(spark, sf_dir, "events").select("event_id", advice_card(advice).alias("card"))


PAGE_BLOCK = 500


def _stored_fetch(path: str):
    """A fetch function over listing pages in a folder: agency=<agency>/block=<page div PAGE_BLOCK>/*.parquet with page and html.

    Pages are asked for in turn, so the block of the last one is kept: a page costs the same however many its agency has.
    """
    kept: dict[tuple, dict[int, str]] = {}

    def fetch(url: str, params: dict) -> str:
        block = params["agency"], params["page"] // PAGE_BLOCK
        if block not in kept:
            store, root = opened(path)
            pages = pq.read_table(f"{root}/agency={block[0]}/block={block[1]}", columns=["page", "html"], filesystem=store, partitioning=None)
            kept.clear()
            kept[block] = dict(zip(pages["page"].to_pylist(), pages["html"].to_pylist()))
        return kept[block][params["page"]]

    return fetch


@query("""
select p_partkey as posting, p_name as title, p_brand as city, ((row_number() over (partition by p_brand order by p_partkey) - 1) // 10 + 1)::integer as source_page from part""")
def q_portal_table(spark, sf_dir):
    """Brands as cities of the portal source: part names as postings, ten a page, pages read in turn until the reported count is reached."""
    per = Window.partitionBy("p_brand")
    part = _t(spark, sf_dir, "part").where("p_partkey is not null").select("p_partkey", "p_brand", "p_name", ((F.row_number().over(per.orderBy("p_partkey")) - 1) / 10).cast("int").alias("at"), F.count(F.lit(1)).over(per).alias("total"))
    item = F.format_string('<li class="list-item" data-job-id="%d"><a class="item-details-link" href="/careers/x/jobs/%d/y">%s</a></li>', "p_partkey", "p_partkey", "p_name")
    listed = part.groupBy("p_brand", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "").alias("items"), F.max("total").alias("total"))  # ten a group
    follow = F.when(F.col("total") > (F.col("at") + 1) * 10, F.format_string('<ul class="pagination"><li><a rel="next" aria-disabled="false" href="?page=%d">Next</a></li></ul>', F.col("at") + 2)).otherwise("")
    html = F.concat(F.lit('<span id="job-postings-number">'), F.col("total").cast("string"), F.lit("</span><ul>"), F.col("items"), F.lit("</ul>"), follow)
    path = f"{_scratch(spark)}/pages"
    agency = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    stored = listed.select((F.col("at") + 1).alias("page"), html.alias("html"), agency.alias("agency")).withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    stored.repartition("agency", "block").write.partitionBy("agency", "block").parquet(path)
    cities = [(r["p_brand"], f"https://www.governmentjobs.com/careers/{r['agency']}") for r in part.select("p_brand", agency.alias("agency")).distinct().collect()]  # a catalog of cities
    spark.dataSource.register(portal_source(_stored_fetch(path)))
    found = spark.read.format("portal").option("cities", json.dumps(cities)).option("max_pages", "100000").load()
    return found.select(F.col("posting_id").cast("long").alias("posting"), "title", "city", "source_page")
