"""Schemas of the engine's tables. Nothing is inferred; a missing field is null."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType, TimestampNTZType

S = StringType()


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


RAW_DATA = _struct(platform=S, posting_id=S, source_job_id=S, agency_code=S, job_number=S, categories=S, source_page=IntegerType())

TEXT_FIELDS = ("title", "city", "url", "description", "location", "department", "salary", "posted_date", "closing_date", "job_id", "requirements", "job_type")

JOB = StructType([*(StructField(n, S) for n in TEXT_FIELDS), StructField("scraped_at", TimestampNTZType()), StructField("raw_data", RAW_DATA), StructField("match_score", DoubleType())])

RESUME = _struct(
    skills=ArrayType(S),
    experience=ArrayType(_struct(title=S, company=S, duration=S, description=S)),
    education=ArrayType(_struct(degree=S, field=S, institution=S, year=S)),
    projects=ArrayType(_struct(name=S, description=S, technologies=ArrayType(S))),
    certifications=ArrayType(S),
    summary=S,
    error=S,
    name=S,
)

PROFILE = _struct(
    name=S, degree=S, interests=ArrayType(S), resume_text=S, resume_filename=S, target_job_title=S, target_location=S, resume_parsed=RESUME,
    created_at=TimestampNTZType(),
)

ADVICE = _struct(skill_gaps=ArrayType(S), keywords=ArrayType(S), improvements=ArrayType(S), strengths=ArrayType(S), error=S)

CACHE_FILE = _struct(city=S, cached_at=S, job_count=IntegerType(), jobs=ArrayType(JOB))

EMBEDDING = ArrayType(FloatType())

#: Choices offered to a user.
INTERESTS = (
    "Public Administration",
    "Engineering & Public Works",
    "Information Technology",
    "Public Safety (Police/Fire)",
    "Urban Planning & Development",
    "Finance & Budgeting",
    "Human Resources",
    "Parks & Recreation",
    "Library Services",
    "Community Services",
    "Legal Services",
    "Environmental Services",
)
DEGREES = (
    "High School Diploma/GED",
    "Some College",
    "Associate's Degree",
    "Bachelor's Degree",
    "Master's Degree",
    "Doctoral Degree (PhD/JD/MD)",
)
