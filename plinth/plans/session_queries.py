"""Queries of resumes, profiles, advice, grids and the clearing of tables, each with its SQL."""

from __future__ import annotations

import datetime
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions.documents import advice_prompt, resume_prompt
from ..functions.html import parse_listings
from ..functions.text import stripped
from ..operators.filters import profile_complete
from ..operators.models import hashed_words
from ..operators.spread import spread
from ..schemas import DEGREES, INTERESTS, PROFILE
from ..sources import index
from ..sources.cache import clear, load, save
from ..sources.grid import jobs_of_grids
from ..sources.resumes import extracted
from .profile import advised, candidate_name, gaps, keywords, parsed_resumes, session_minutes, store, with_defaults
from .queries import ASOF, HOURS, _scratch, _t, query

_TRIM = "regexp_replace({}, '^\\\\s+|\\\\s+$', '', 'g')"


@query("select o_orderkey, o_orderdate::date::varchar as posted, floor(o_totalprice)::bigint::varchar || ' a year' as salary from orders")
def q_stripped_fields(spark, sf_dir):
    """Dates and salaries with white space around them, as pages have them."""
    pad = lambda x: stripped(F.concat(F.lit(" \t"), x, F.lit("\n ")))
    orders = _t(spark, sf_dir, "orders")
    return orders.select("o_orderkey", pad(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("posted"), pad(F.concat(F.floor("o_totalprice").cast("string"), F.lit(" a year"))).alias("salary"))


def _profiles(spark, sf_dir):
    """Customers as profiles: some without interests, resume or degree."""
    c = _t(spark, sf_dir, "customer").where("c_custkey is not null")
    key = F.col("c_custkey")
    told = {
        "name": F.when(key % 4 > 0, F.col("c_name")).otherwise(""), "degree": F.when(key % 3 > 0, F.col("c_mktsegment")),
        "interests": F.when(key % 5 > 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")), "resume_text": F.when(key % 2 == 0, F.concat(F.lit("I am "), F.col("c_name"))).otherwise(""),
        "resume_parsed": F.when(key % 2 == 0, F.struct(*(F.col("c_name").alias("name") if f.name == "name" else F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE["resume_parsed"].dataType))),
        "created_at": F.lit(ASOF.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(mins=(key % 500).cast("int"), secs=F.lit(30)),
    }
    return c.select("c_custkey", *(told.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in PROFILE))


@query("select c_custkey % 500 as minutes, count(*) as n from customer group by 1")
def q_session_minutes(spark, sf_dir):
    return session_minutes(_profiles(spark, sf_dir), ASOF).groupBy("minutes").agg(F.count(F.lit(1)).alias("n"))


@query("select case when c_custkey % 2 = 0 then c_name else '' end as candidate_name from customer")
def q_candidate_name(spark, sf_dir):
    return candidate_name(_profiles(spark, sf_dir))


@query("select c_custkey, c_custkey % 4 > 0 and c_custkey % 3 > 0 and c_custkey % 5 > 0 and c_custkey % 2 = 0 as complete from customer")
def q_profile_complete(spark, sf_dir):
    return _profiles(spark, sf_dir).select("c_custkey", F.coalesce(profile_complete(), F.lit(False)).alias("complete"))


@query(f"""
select c_custkey, case when c_custkey % 4 > 0 then c_name else 'User' end as name, case when c_custkey % 3 > 0 then c_mktsegment else '{DEGREES[0].replace("'", "''")}' end as degree,
  case when c_custkey % 5 > 0 then c_mktsegment else '{INTERESTS[0]}' end as interests from customer where c_custkey % 2 = 0""")
def q_profile_defaults(spark, sf_dir):
    return with_defaults(_profiles(spark, sf_dir)).select("c_custkey", "name", "degree", F.array_join("interests", "|").alias("interests"))


@query("select p_partkey, case p_partkey % 5 when 0 then 1 when 1 then 0 when 2 then 0 when 3 then 1 else 2 end::integer as jobs from part")
def q_invalid_postings(spark, sf_dir):
    """Pages of one to two postings: good, without a title, without an id, one twice, and two good ones."""
    item = '<li class="list-item" {}><a class="item-details-link" href="/careers/x/{}/y">{}</a></li>'.format
    good, other = item('data-job-id="7"', "jobs/7", "Clerk"), item('data-job-id="8"', "jobs/8", "Pilot")
    kinds = F.array(*(F.lit(h) for h in (good, item('data-job-id="7"', "jobs/7", " "), item("", "none", "Clerk"), good + good, good + other)))
    html = F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("html")
    part = spread(_t(spark, sf_dir, "part").where("p_partkey is not null").select("p_partkey"), "p_partkey")
    pages = part.select("p_partkey", F.lit("Tempe").alias("city"), F.lit("https://e.gov").alias("origin"), F.lit("tempe").alias("agency"), F.lit(1).alias("page"), html)
    return parse_listings(pages).select("p_partkey", F.size("jobs").alias("jobs"))


@query("""
select s_suppkey, 'Post of ' || s_name as title, 'https://hr.example.gov/jobs/' || s_suppkey as url, case when s_suppkey % 2 = 0 then 'Room ' || s_nationkey else 'Tempe' end as location, 'Dept ' || s_nationkey as department
from supplier where s_suppkey % 7 > 0""")
def q_grid_rows(spark, sf_dir):
    """Grid pages of the second platform, a supplier a row; one in seven has no title and is no posting."""
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    key, nation = (F.col(c).cast("string") for c in ("s_suppkey", "s_nationkey"))
    title = F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("Post of "), F.col("s_name"))).otherwise("")
    row = F.concat(
        F.lit('<tr class="ps_grid-row">'), cell(key), cell(F.concat(F.lit("Dept "), nation)), cell(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Room "), nation)).otherwise("")), cell(F.lit("")), cell(F.lit("")),
        cell(F.concat(F.lit('<a href="/jobs/'), key, F.lit('">'), title, F.lit("</a>"))), F.lit("</tr>"),
    )
    rows = spread(_t(spark, sf_dir, "supplier").where("s_suppkey is not null").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    pages = rows.select(F.lit("Tempe").alias("city"), F.lit("https://hr.example.gov/psc/x/y").alias("base_url"), F.concat(F.lit("<table>"), row, F.lit("</table>")).alias("html"))
    return jobs_of_grids(pages).select(F.col("source_job_id").cast("long").alias("s_suppkey"), "title", "url", "location", "department")


def _docx(texts: pd.Series) -> pd.Series:
    """Texts as the least DOCX files that hold them."""

    def one(text: str) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{line.replace('&', '&amp;').replace('<', '&lt;')}</w:t></w:r></w:p>" for line in text.split("\n"))
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return texts.map(one)


@query(f"""
select doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.DOCX' when 2 then '.odt' when 3 then '.txt' else '.docx' end as path,
  case when doc_id % 5 in (0, 1) then md5({_TRIM.format("text")}) end as digest,
  case doc_id % 5 when 2 then 'unsupported' when 3 then 'too large' when 4 then 'docx: BadZipFile' end as error from documents""")
def q_resume_files(spark, sf_dir):
    """Documents as resume files: text, DOCX, of an unknown kind, too large, and broken ones."""
    kind = (F.col("doc_id") % 5).cast("int")
    ends = F.element_at(F.array(*map(F.lit, (".txt", ".DOCX", ".odt", ".txt", ".docx"))), kind + 1)
    packed = F.pandas_udf(_docx, "binary")
    content = F.when(kind == 1, packed(F.when(kind == 1, F.col("text")).otherwise(""))).otherwise(F.col("text").cast("binary"))
    files = _t(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), ends).alias("path"), F.when(kind == 3, 6 << 20).otherwise(10).cast("long").alias("length"), content.alias("content"))
    return extracted(files).select("path", F.md5("text").alias("digest"), "error")


_ASK = 125


def _summaries(prompts: list[str]) -> list[str]:
    """A provider that tells how long a resume is, and fails for the shortest ones."""
    asked = len("Extract the resume below as JSON with the keys skills, experience, education, projects, certifications and summary.\n\n")
    return ["no JSON" if len(p) - asked < _ASK else "```json\n" + json.dumps({"summary": f"{len(p) - asked} characters", "skills": ["reading"]}) + "\n```" for p in prompts]


@query(f"""
select doc_id::varchar as path, case when doc_id % 3 = 0 then 'known' when least(length(text), 10000) < {_ASK} then 'Error parsing resume' else least(length(text), 10000) || ' characters' end as summary
from documents where text not in (select text from documents where doc_id % 3 = 0) or doc_id % 3 = 0
union all
select doc_id::varchar, 'known' from documents where doc_id % 3 <> 0 and text in (select text from documents where doc_id % 3 = 0)""")
def q_resume_memo(spark, sf_dir):
    """Documents as resumes: texts whose parse is known aren't asked for again, others are parsed once a text."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    resumes = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    kind = PROFILE["resume_parsed"].dataType
    known = F.struct(*(F.lit("known").alias(f.name) if f.name == "summary" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind)).cast(kind)
    memo = docs.where("doc_id % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), known.alias("resume_parsed")).dropDuplicates(["text_hash"])
    return parsed_resumes(resumes, memo, _summaries).select("path", F.col("resume_parsed.summary").alias("summary"))


def _advice(prompts: list[str]) -> list[str]:
    """A provider that finds the position's first word missing and suggests its last one."""
    positions = [p.split("Position: ")[1].split("\n")[0].split() for p in prompts]
    return [json.dumps({"skill_gaps": p[:1], "keywords": p[-1:]}) for p in positions]


@query("""
select p_partkey::varchar as job_id, 'gap' as part, case when p_partkey % 4 = 0 then 'known' else string_split(p_name, ' ')[1] end as told from part
union all
select p_partkey::varchar, 'keyword', string_split(p_name, ' ')[-1] from part where p_partkey % 4 <> 0""")
def q_advice(spark, sf_dir):
    """Parts as jobs: advice that is known isn't asked for again; gaps and keywords as rows."""
    jobs = _t(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").cast("string").alias("job_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit("").alias("requirements"))
    none = F.array().cast("array<string>")
    known = F.struct(F.array(F.lit("known")).alias("skill_gaps"), *(none.alias(n) for n in ("keywords", "improvements", "strengths")), F.lit(None).cast("string").alias("error"))
    memo = jobs.where(F.col("job_id").cast("long") % 4 == 0).select("job_id", known.alias("advice"))
    advice = advised(jobs, memo, "I can read.", _advice)
    return gaps(advice).select("job_id", F.lit("gap").alias("part"), F.col("gap").alias("told")).unionByName(keywords(advice).select("job_id", F.lit("keyword").alias("part"), F.col("keyword").alias("told")))


@query("""
select doc_id, md5('Extract the resume below as JSON with the keys skills, experience, education, projects, certifications and summary.' || chr(10) || chr(10) || left(coalesce(text, ''), 10000)) as resume,
  md5('Compare the candidate with the position. Answer in JSON with the lists skill_gaps, keywords, improvements and strengths.' || chr(10) || chr(10) || 'Position: ' || source || chr(10) || 'Description: ' || left(coalesce(text, ''), 500) || chr(10) || 'Requirements: ' || chr(10) || chr(10) || 'Candidate:' || chr(10) || lang) as advice
from documents""")
def q_prompts(spark, sf_dir):
    """What a model is asked of each document as a resume, and as a job."""
    job = F.struct(F.col("source").alias("title"), F.col("text").alias("description"), F.lit("").alias("requirements"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(resume_prompt(F.col("text"))).alias("resume"), F.md5(advice_prompt(job, F.col("lang"))).alias("advice"))


@query("""
select count(*) as jobs, min(c_name) as first_title from (select *, row_number() over (partition by c_custkey // 3 order by c_custkey) as r from customer) where r = 1""")
def q_session_store(spark, sf_dir):
    """A session's jobs as a view, the best of each identity."""
    url = F.concat(F.lit("https://jobs.example.gov/jobs/"), F.floor(F.col("c_custkey") / 3).cast("string"))
    store(_t(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_name").alias("title"), F.lit("Tempe").alias("city"), url.alias("url"), F.col("c_custkey").alias("pos")), "session_jobs")
    return spark.sql("select count(*) as jobs, min(title) as first_title from session_jobs")


@query("select source as city, count(*) as jobs from documents where source <> (select min(source) from documents) group by source")
def q_cache_clear(spark, sf_dir):
    """All sources cached, then the first one's folders cleared."""
    docs, path = _t(spark, sf_dir, "documents"), _scratch(spark)
    jobs = docs.select(F.concat(F.lit("Opening "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("city"), F.concat(F.lit("https://jobs.example.gov/jobs/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("pos"))
    save(jobs, jobs.select("city").distinct(), path, ASOF - datetime.timedelta(hours=1))
    clear(spark, path, docs.agg(F.min("source")).first()[0])
    found, manifest = load(spark, path, ASOF, HOURS)
    per = found.groupBy("city_key").agg(F.count(F.lit(1)).alias("jobs"))
    return manifest.join(per, "city_key").select("city", "jobs")


@query("select p_brand, count(*) as n from part where p_partkey % 2 = 1 group by p_brand")
def q_index_clear(spark, sf_dir):
    """An index of all parts is cleared and extended with half of them."""
    part, path = _t(spark, sf_dir, "part").where("p_partkey is not null"), f"{_scratch(spark)}/index"
    empty = F.lit("")
    jobs = part.select(F.col("p_partkey").cast("string").alias("job_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("department"), *(empty.alias(c) for c in ("location", "city", "description", "requirements", "job_type")), "p_partkey")
    index.extend(jobs, path, hashed_words(16), 16)
    index.clear_index(spark, path)
    half = jobs.where("p_partkey % 2 = 1")
    index.extend(half, path, hashed_words(16), 16)
    return index.vectors_of(half, path).groupBy(F.col("department").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))
