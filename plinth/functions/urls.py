"""Canonical URLs and platforms as columns.

parse_url isn't used: it gives null for hosts and paths that are fine elsewhere (underscores, spaces,
stray percent signs). One pattern splits the URL instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized, or_empty, present

#: Query keys that only track, besides utm_*.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
#: What a URL's text tells of its platform; the first that fits counts.
PLATFORM_PATTERNS = (
    ("governmentjobs.com", "NeoGov"),
    ("neogov.com", "NeoGov"),
    ("hcmprod", "PeopleSoft"),
    ("peoplesoft", "PeopleSoft"),
)
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    """As forms encode it: ~ stays and * is escaped."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _authority(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_replace(_authority(F.trim(or_empty(url))), r":[^:\]]*$", ""))


def query_pairs(url: Column) -> Column:
    """The query's (key, value) pairs, decoded, in order; `a` is `a=`, and `&&` holds none."""
    pieces = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), F.when(F.contains(p, F.lit("=")), _decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")))


def is_tracking(key: Column) -> Column:
    return F.startswith(F.lower(key), F.lit("utm_")) | F.lower(key).isin(*TRACKING_KEYS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once for a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def _url_parts(url: Column) -> Column:
    """What canonical_url puts together, each part once."""
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), "/{2,}", "/"), "/+$", "")
    kept = F.array_sort(F.filter(query_pairs(url), lambda p: ~is_tracking(p["key"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.struct(url.alias("url"), F.lower(_part(url, 1)).alias("scheme"), host(url).alias("host"), F.regexp_extract(_authority(url), r":(\d+)$", 1).alias("port"), path.alias("path"), query.alias("query"))


def _joined(parts: Column) -> Column:
    scheme, port = parts["scheme"], parts["port"]
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    head = F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":")))
    path = F.when(parts["path"] == "", "/").otherwise(parts["path"])

    def with_place(place: Column) -> Column:
        plain = F.endswith(place, F.lit("governmentjobs.com")) & F.contains(F.lower(path), F.lit("/jobs/"))
        query = F.when(plain | (parts["query"] == ""), "").otherwise(F.concat(F.lit("?"), parts["query"]))
        return F.concat(head, F.when(place == "", "").otherwise(F.concat(F.lit("//"), place)), path, query)

    return F.when(parts["url"] == "", "").otherwise(_let(F.concat(parts["host"], F.when(default, "").otherwise(F.concat(F.lit(":"), port))), with_place))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, user, fragment or tracking keys, the query sorted.

    On governmentjobs.com job pages the whole query goes. A port that isn't a number stays as text. Every part is computed once: written
    into each other the parts would be computed dozens of times a row.
    """
    return _let(F.trim(or_empty(url)), lambda whole: _let(_url_parts(whole), _joined))


def detected_platform(url: Column) -> Column:
    """The platform that the URL's text names, or null."""
    text, out = F.lower(or_empty(url)), F.lit(None).cast("string")
    for pattern, name in reversed(PLATFORM_PATTERNS):
        out = F.when(F.contains(text, F.lit(pattern)), name).otherwise(out)
    return out


def platform_name(told: Column, url: Column) -> Column:
    """The platform told, else by the host, else the host, else unknown; url is canonical."""

    def by_host(h: Column) -> Column:
        known = F.when(F.endswith(h, F.lit("governmentjobs.com")) | F.endswith(h, F.lit("neogov.com")), "neogov").when(F.contains(h, F.lit("peoplesoft")) | F.contains(h, F.lit("hcmprod")), "peoplesoft")
        return known.when(h != "", h)

    return F.coalesce(present(normalized(told)), _let(host(url), by_host), F.lit("unknown"))
