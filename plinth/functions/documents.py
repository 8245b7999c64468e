"""The texts that are embedded or sent to a model, put together from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import labelled, or_empty, present

PARAGRAPH = "\n\n"


def job_text(get=F.col) -> Column:
    """What is embedded of a job; empty fields are left out, and the city stands in for the location."""
    place = F.coalesce(present(get("location")), get("city"))
    return F.concat_ws(
        PARAGRAPH, labelled("Title", get("title")), labelled("Department", get("department")), labelled("Location", place),
        labelled("Description", get("description")), labelled("Requirements", get("requirements")), labelled("Type", get("job_type")),
    )


def _lines(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(items, "\n")))


def _list(label: str, items: Column) -> Column:
    return labelled(label, F.array_join(items, ", "))


def _more(before: str, x: Column) -> Column:
    return F.when(F.length(x) > 0, F.concat(F.lit(before), x)).otherwise("")


def resume_text(get=F.col) -> Column:
    """What is embedded of a profile; a null resume_parsed is one without entries."""
    parsed = get("resume_parsed")
    experience = F.transform(parsed["experience"], lambda x: F.concat(or_empty(x["title"]), F.lit(" at "), or_empty(x["company"]), _more(": ", x["description"])))
    education = F.transform(parsed["education"], lambda x: F.concat(or_empty(x["degree"]), F.lit(" in "), or_empty(x["field"]), F.lit(" from "), or_empty(x["institution"])))

    def project(x: Column) -> Column:
        used = F.array_join(x["technologies"], ", ")
        return F.concat(or_empty(x["name"]), F.lit(": "), or_empty(x["description"]), F.when(F.length(used) > 0, F.concat(F.lit(" (Technologies: "), used, F.lit(")"))).otherwise(""))

    return F.concat_ws(
        PARAGRAPH, labelled("Target role", get("target_job_title")), labelled("Preferred location", get("target_location")), _list("Interests", get("interests")),
        labelled("Education", get("degree")), _list("Skills", parsed["skills"]), _lines("Experience", experience), _lines("Education Details", education),
        _lines("Projects", F.transform(parsed["projects"], project)),
    )


def profile_keywords(get=F.col) -> Column:
    """The distinct lower-case skills and interests."""
    lower = lambda items: F.transform(F.coalesce(items, F.array().cast("array<string>")), F.lower)
    return F.array_union(lower(get("resume_parsed")["skills"]), lower(get("interests")))


def keyword_overlap(keywords: Column, *parts: Column) -> Column:
    """The share of an array of keywords that the parts' text contains; 0 without any."""
    text = F.lower(F.concat_ws(" ", *[or_empty(p) for p in parts]))
    return F.coalesce(F.try_divide(F.size(F.filter(keywords, lambda k: F.contains(text, k))), F.size(keywords)), F.lit(0.0))


def chat_prompt(turn: Column, role: Column, text: Column) -> Column:
    """An aggregate: `role: text` lines of a conversation in the order of turn. The prompt is one value, so a conversation has to fit one anyway."""
    lines = F.array_sort(F.collect_list(F.struct(turn.alias("turn"), F.concat(role, F.lit(": "), text).alias("line"))))
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def resume_prompt(text: Column, limit: int = 10_000) -> Column:
    ask = "Extract the resume below as JSON with the keys skills, experience, education, projects, certifications and summary.\n\n"
    return F.concat(F.lit(ask), F.substring(or_empty(text), 1, limit))


def advice_prompt(job: Column, profile_text: Column, limit: int = 500) -> Column:
    ask = "Compare the candidate with the position. Answer in JSON with the lists skill_gaps, keywords, improvements and strengths.\n\n"
    part = lambda name: F.substring(or_empty(job[name]), 1, limit)
    return F.concat(
        F.lit(ask), F.lit("Position: "), or_empty(job["title"]), F.lit("\nDescription: "), part("description"), F.lit("\nRequirements: "), part("requirements"),
        F.lit("\n\nCandidate:\n"), or_empty(profile_text),
    )
