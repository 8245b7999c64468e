"""Text as columns: cleaning, terms, presentation. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a place.
LOCATION_STOP_WORDS = ("arizona", "az", "city", "of", "state", "county", "town")

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def present(x: Column) -> Column:
    """x, or null where it is empty."""
    return F.nullif(x, F.lit(""))


def clean_text(x: Column) -> Column:
    """Runs of white space (Unicode's too) as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(or_empty(x), _SPACE, " "))


def normalized(x: Column) -> Column:
    """Cleaned and in lower case (ß and final sigma are not folded further)."""
    return F.lower(clean_text(x))


def terms(x: Column, ignored: tuple[str, ...] = ()) -> Column:
    """The lower-case runs of a-z and 0-9, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(or_empty(x)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*ignored)) if ignored else found


def has_all(wanted: Column, have: Column) -> Column:
    """Whether every wanted term is there; no terms: true."""
    return F.size(F.array_except(wanted, have)) == 0


def labelled(label: str, x: Column) -> Column:
    """`label: x`, null where x is null or empty (so concat_ws leaves it out)."""
    return F.when(F.length(x) > 0, F.concat(F.lit(f"{label}: "), x))


def rounded_score(x: Column) -> Column:
    """To one decimal, ties by the exact binary value (72.35 is 72.3)."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit("")).cast("double")


def posting_id(x: Column) -> Column:
    return F.regexp_extract(or_empty(x), r"(?:/jobs/|^)(\d+)(?:/|$)", 1)


def fenced(reply: Column) -> Column:
    """What a model's reply holds within a code fence (a `json` mark dropped), or the reply."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|$)", 1)
    return F.trim(F.coalesce(present(inner), reply))


def html_escaped(x: Column) -> Column:
    """With & < > and quotes as references."""
    for char, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(char), F.lit(by))
    return x


def score_badge(score: Column) -> Column:
    """high from 60, med from 40, else low; what is no number counts as 0."""
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.when(s >= 60, "high").when(s >= 40, "med").otherwise("low")


def score_shown(score: Column) -> Column:
    """The score as `n/100`, ties to even."""
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.concat(F.bround(s, 0).cast("int").cast("string"), F.lit("/100"))


def flat(df: DataFrame, *keep: str) -> DataFrame:
    """df with scalars only: nested columns but those of keep become JSON, others that aren't plain become text."""
    plain = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}

    def one(name: str, kind: str) -> Column:
        if kind in plain or name in keep:
            return F.col(name)
        return (F.to_json(name) if kind.startswith(("struct", "array", "map")) else F.col(name).cast("string")).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def card(title: Column, place: Column, location: Column, score: Column, tailored: Column) -> Column:
    """A job as a piece of HTML; texts are escaped and a missing score is 0."""
    own = lambda x, other: html_escaped(F.coalesce(present(or_empty(x)), F.lit(other)))
    mark = F.when(F.coalesce(tailored, F.lit(False)), F.lit('<p class="tailored">Resume tailored</p>')).otherwise("")
    return F.concat(
        F.lit('<article class="job"><h3>'), own(title, "Untitled"), F.lit('</h3><span class="score score-'), score_badge(score), F.lit('">'), score_shown(score),
        F.lit('</span><p class="place">'), own(place, ""), F.lit('</p><p class="location">'), own(location, ""), F.lit("</p>"), mark, F.lit("</article>"),
    )


def stripped(x: Column) -> Column:
    """Dates and salaries stay as they are written, without white space at the ends."""
    return F.regexp_replace(or_empty(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def advice_card(advice: Column) -> Column:
    """A job's advice (ADVICE) as a piece of HTML: four lists, each with a sentence where it is empty; texts are escaped."""

    def part(name: str, heading: str, none: str) -> Column:
        items = F.transform(F.coalesce(advice[name], F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), html_escaped(or_empty(x)), F.lit("</li>")))
        told = F.when(F.size(items) > 0, F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))).otherwise(F.lit(f"<p>{none}</p>"))
        return F.concat(F.lit(f'<section class="{name.replace("_", "-")}"><h4>{heading}</h4>'), told, F.lit("</section>"))

    return F.concat(
        F.lit('<article class="advice">'), part("strengths", "Your strengths", "No specific strengths identified"), part("keywords", "Keywords to add", "No keywords suggested"),
        part("skill_gaps", "Skill gaps to address", "No major skill gaps"), part("improvements", "Resume improvements", "No specific improvements suggested"), F.lit("</article>"),
    )
