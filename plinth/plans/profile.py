"""The profile of a session as a one-row table, and the operators over resumes and advice."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import advice_prompt, resume_prompt
from ..functions.text import present
from ..operators.dedup import deduplicate_jobs
from ..operators.joins import memo_hits, memo_misses
from ..operators.models import Generate, generated, parsed_advice, parsed_resume
from ..schemas import DEGREES, INTERESTS, PROFILE, RESUME
from ..sources.resumes import extracted

KEEP = object()


def new_profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None,) * len(PROFILE)], PROFILE)


def updated(profile: DataFrame, asof: datetime.datetime, resume_parsed: object = KEEP, **fields) -> DataFrame:
    """None keeps a field; resume_parsed may be set to None. created_at is set once."""
    spark = profile.sparkSession
    told = {k: v for k, v in fields.items() if v is not None} | ({} if resume_parsed is KEEP else {"resume_parsed": resume_parsed})
    new = spark.createDataFrame([tuple(told.get(f.name) for f in PROFILE)], PROFILE)
    merged = profile.crossJoin(new.select([F.col(c).alias(f"_n_{c}") for c in new.columns]))  # one row each
    columns = [F.col(f"_n_{c}").alias(c) if c in told else F.col(c) for c in PROFILE.names if c != "created_at"]
    return merged.select(*columns, F.coalesce("created_at", F.lit(asof.isoformat(sep=" ")).cast("timestamp_ntz")).alias("created_at"))


def upserted(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """The profiles of many sessions (session_id, then PROFILE) after updates, of known sessions and new ones.

    updates: session_id, at, seq, the fields of PROFILE but created_at, and sets_resume_parsed. Of each field the last update (by at, then
    seq) that tells it counts; null tells nothing, but resume_parsed is set, to null too, where sets_resume_parsed says so.
    created_at is that of the profile, else the time of the session's first update. Updates without a session or a time don't
    count. The updates of a session meet as partial results, one a task, so many of one session are no hot key.
    """
    place = F.struct("at", "seq")
    fields = [c for c in PROFILE.names if c not in ("created_at", "resume_parsed")]
    told = updates.where("session_id is not null and at is not null").groupBy("session_id").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_{c}") for c in fields),
        F.max_by(F.struct("resume_parsed"), F.when(F.coalesce("sets_resume_parsed", F.lit(False)), place)).alias("_resume_parsed"),
        F.min("at").alias("_created_at"),
    )
    both = profiles.join(told, "session_id", "full_outer")
    merged = {c: F.coalesce(f"_{c}", c) for c in (*fields,)}
    merged["resume_parsed"] = F.when(F.col("_resume_parsed").isNotNull(), F.col("_resume_parsed")["resume_parsed"]).otherwise(F.col("resume_parsed"))
    merged["created_at"] = F.coalesce("created_at", F.col("_created_at").cast("timestamp_ntz"))
    return both.select("session_id", *(merged[c].alias(c) for c in PROFILE.names))


def with_defaults(profile: DataFrame) -> DataFrame:
    """What a search takes where the user told nothing; without a resume text there is no row."""
    return profile.where(F.length("resume_text") > 0).withColumns({
        "name": F.coalesce(present(F.col("name")), F.lit("User")),
        "degree": F.coalesce(present(F.col("degree")), F.lit(DEGREES[0])),
        "interests": F.when(F.size("interests") > 0, F.col("interests")).otherwise(F.array(F.lit(INTERESTS[0]))),
    })


def session_minutes(profile: DataFrame, asof: datetime.datetime) -> DataFrame:
    now = F.lit(asof.isoformat(sep=" ")).cast("timestamp_ntz")
    return profile.select(F.timestamp_diff("MINUTE", "created_at", now).alias("minutes"))


def parsed_resumes(resumes: DataFrame, memo: DataFrame, generate: Generate) -> DataFrame:
    """path, text, resume_parsed of resumes (path, text): parses known for a text are used again.

    memo: text_hash, resume_parsed. A text is parsed once however many files have it.
    """
    keyed = resumes.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    new = memo_misses(keyed.select("text_hash", "text").dropDuplicates(["text_hash"]), memo, "text_hash")
    made = new.select("text_hash", parsed_resume(generated(resume_prompt(F.col("text")), generate)).alias("resume_parsed"))
    return keyed.join(memo.select("text_hash", "resume_parsed").unionByName(made), "text_hash").drop("text_hash")


def processed_resumes(files: DataFrame, memo: DataFrame, generate: Generate, max_mb: int = 5) -> DataFrame:
    """path, text, resume_parsed, candidate_name and warning of resume files (path, length, content): extracted, then parsed or known.

    A file without text has its error for a warning; a parse that failed is null, with a warning, and the text stays.
    """
    texts = extracted(files, max_mb)
    good = parsed_resumes(texts.where("error is null").select("path", "text"), memo, generate)
    failed = F.col("resume_parsed")["error"]
    told = F.when(failed.isNotNull(), F.concat(F.lit("not parsed: "), failed))
    good = good.withColumn("warning", told).withColumn("resume_parsed", F.when(F.col("warning").isNull(), F.col("resume_parsed")))
    bad = texts.where("error is not null").select("path", "text", F.lit(None).cast(RESUME).alias("resume_parsed"), F.col("error").alias("warning"))
    every = good.unionByName(bad)
    return every.withColumn("candidate_name", F.coalesce(F.col("resume_parsed")["name"], F.lit(""))).select("path", "text", "resume_parsed", "candidate_name", "warning")


def gaps(advice: DataFrame) -> DataFrame:
    """One row for each skill gap of each job."""
    return advice.select("job_id", F.explode(F.col("advice")["skill_gaps"]).alias("gap"))


def keywords(advice: DataFrame) -> DataFrame:
    """One row for each keyword that a job's advice suggests."""
    return advice.select("job_id", F.explode(F.col("advice")["keywords"]).alias("keyword"))


def advised(jobs: DataFrame, memo: DataFrame, profile_text: str, generate: Generate) -> DataFrame:
    """job_id and advice of jobs; advice in memo (job_id, advice) isn't asked for again."""
    known = memo_hits(memo, jobs, "job_id").select("job_id", "advice")
    new = memo_misses(jobs, memo, "job_id")
    job = F.struct("title", "description", "requirements")
    return known.unionByName(new.select("job_id", parsed_advice(generated(advice_prompt(job, F.lit(profile_text)), generate)).alias("advice")))


def candidate_name(profile: DataFrame) -> DataFrame:
    """The name that the parsed resume tells, or an empty one."""
    return profile.select(F.coalesce(F.col("resume_parsed")["name"], F.lit("")).alias("candidate_name"))


def store(jobs: DataFrame, view: str = "matched_jobs") -> DataFrame:
    """The session's jobs as a view, the best of each identity."""
    unique = deduplicate_jobs(jobs)
    unique.createOrReplaceTempView(view)
    return unique
