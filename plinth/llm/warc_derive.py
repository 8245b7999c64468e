"""WARC derivative builder: a metadata and a conversion record for each response record.

A response record has record_id, target_uri, date, headers (status line and header lines as the
server sent them) and payload (HTML). Its metadata record is `application/warc-fields`: the
status, the source's header lines, title and the source's digests. Its conversion record is
`text/plain`: the visible text. Both refer to the response (WARC-Refers-To, with its target URI
and date) and carry the source's payload digest; the conversion also names its metadata record
(WARC-Concurrent-To). Record ids are UUIDs made from the response's id and the record's type, so a
task that runs again makes the same ids.

One pass of DataFrame functions over the records, without a shuffle. `as_warc` gives each record
as WARC/1.1 text and `write_warc` writes such files (records end in two CRLFs).

Defined results: a null payload is an empty one; null headers leave only the digests in the
metadata; a null target URI or date leaves its field out (null columns). Repeated responses give
repeated records. An empty table gives an empty one. Further columns named in `keep` pass through (one with the name of a record's column is
that column, once).
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of HTML: elements that break a line.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|thead|tr|ul"
#: The named references of HTML 4 (Python's table of them) and XML's apos.
ENTITIES = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'"}
QUOTED = r"""(</?[A-Za-z][^<>]*=[ \t\r\n]*)(?:"[^">]*>[^"]*"|'[^'>]*>[^']*')"""
#: Pattern and replacement, in order; both engines read them alike. Elements of raw text and comments end with the page at last,
#: and an attribute's value goes before tags do if a `>` stands in it (two of a tag's attributes; the rest of a tag with more would stay).
STEPS = (
    (r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|title\b.*?(?:</title\s*>|\z)|head\b.*?</head\s*>)", ""),
    (QUOTED, "$1"),
    (QUOTED, "$1"),
    (rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n"),
    (r"</?[A-Za-z!][^>]*>", ""),
)
SPACES = ((r"[ \t\r\f\x0B\x{00A0}]{2,}|[\t\r\f\x0B\x{00A0}]", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""))
RECORD = ("record_type", "record_id", "refers_to", "target_uri", "refers_to_date", "concurrent_to", "content_type", "source_headers", "source_payload_digest", "block_digest", "content_length", "block")
MAX_NAME = 16
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def _references(text: Column) -> Column:
    """Character references as characters, once each; those that name none stay. The text is in the plan once."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(piece: Column, i: Column) -> Column:
        """What follows an `&`, with it; the first piece follows none."""
        end = F.instr(piece, ";")
        name = F.substr(piece, F.lit(1), F.least(end, F.lit(MAX_NAME)) - 1)
        digits, hexes = F.regexp_extract(name, "^#([0-9]{1,7})$", 1), F.regexp_extract(name, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        point = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        good = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")).when(point.isNull(), F.try_element_at(known, name))
        told = F.when((i > 0) & (end > 1) & (end < MAX_NAME), char)
        return F.when(i == 0, piece).otherwise(F.coalesce(F.concat(told, F.substr(piece, end + 1)), F.concat(F.lit("&"), piece)))

    return F.array_join(F.transform(F.split(text, "&", -1), one), "")


def plain_text(html: Column) -> Column:
    """The visible text of HTML: block elements break lines, spaces and empty lines collapse."""
    for pattern, by in STEPS:
        html = F.regexp_replace(html, pattern, by)
    html = _references(html)
    for pattern, by in SPACES:
        html = F.regexp_replace(html, pattern, by)
    return html


def title(html: Column) -> Column:
    text = _references(F.regexp_extract(html, TITLE, 1))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B\x{00A0}]+", " "))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def urn(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records. The crawl's own headers aren't in the table, so the least ones stand in."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    seed = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(payload.cast("binary"), 256))
    return pages.select("page_id", urn(seed).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"))


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The two records that each response record gives, with RECORD columns."""
    payload = F.coalesce("payload", F.lit(""))
    keep = [c for c in keep if c.lower() not in RECORD]
    text, heading, made = fresh(records, "_text", "_title", "_record")
    base = records.select(
        *keep, F.col("record_id").alias("refers_to"), "target_uri", F.col("date").alias("refers_to_date"),
        F.coalesce("headers", F.lit("")).alias("source_headers"), digest(payload).alias("source_payload_digest"),
        plain_text(payload).alias(text), title(payload).alias(heading),
    )
    fields = F.concat(
        F.when(F.col("source_headers") != "", F.concat(F.lit("http-header: "), F.replace("source_headers", F.lit(CRLF), F.lit(CRLF + "http-header: ")), F.lit(CRLF))).otherwise(""),
        F.lit("title: "), F.col(heading), F.lit(CRLF), F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF),
    )
    meta_id = urn(F.concat_ws("|", F.lit("metadata"), "refers_to"))
    text_id = urn(F.concat_ws("|", F.lit("conversion"), "refers_to"))
    both = F.array(
        F.struct(F.lit("metadata").alias("type"), meta_id.alias("id"), F.lit(None).cast("string").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), text_id.alias("id"), meta_id.alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col(text).alias("block")),
    )
    rows = base.withColumn(made, F.explode(both))
    return rows.select(
        *keep, F.col(made)["type"].alias("record_type"), F.col(made)["id"].alias("record_id"), "refers_to", "target_uri", "refers_to_date",
        F.col(made)["concurrent_to"].alias("concurrent_to"), F.col(made)["content_type"].alias("content_type"), "source_headers", "source_payload_digest",
        digest(F.col(made)["block"]).alias("block_digest"), F.octet_length(F.col(made)["block"]).cast("long").alias("content_length"), F.col(made)["block"].alias("block"),
    )


def as_warc(records: DataFrame) -> DataFrame:
    """One column, value: each record as WARC/1.1 text without its closing CRLFs."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")

    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", F.col("refers_to_date")),
        field("WARC-Target-URI", F.col("target_uri")), field("WARC-Refers-To", F.col("refers_to")), field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To-Date", F.col("refers_to_date")), field("WARC-Concurrent-To", F.col("concurrent_to")), field("WARC-Block-Digest", F.col("block_digest")),
        field("WARC-Source-Payload-Digest", F.col("source_payload_digest")), field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length")),
    )
    return records.select(F.concat(head, F.lit(CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """The records as WARC files in a folder, one a partition; not compressed, as readers of gzipped ones want a member a record, which no writer of Spark makes."""
    as_warc(records).write.option("lineSep", CRLF * 2).text(path)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages", "page_id", "url", "html")), keep=("page_id",))


def _sql_text(expr: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, by in STEPS:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    expr = _sql_references(expr)
    for pattern, by in SPACES:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, 'g')"
    return expr


def _sql_references(expr: str) -> str:
    known = "map {" + ", ".join(f"'{n}': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in ENTITIES.items()) + "}"
    name = "regexp_extract(x, '^([^;]+);', 1)"
    point = f"coalesce(try_cast(regexp_extract({name}, '^#([0-9]{{1,7}})$', 1) as int), try_cast('0x' || nullif(regexp_extract({name}, '^#[xX]([0-9A-Fa-f]{{1,6}})$', 1), '') as int))"
    char = f"case when {point} between 1 and 55295 or {point} between 57344 and 1114111 then chr({point}) when {point} is null then {known}[{name}] end"
    told = f"coalesce({char} || substr(x, length({name}) + 2), '&' || x)"
    return f"array_to_string(list_transform(string_split({expr}, '&'), lambda x, i: case when i = 1 then x else {told} end), '')"


def _sql_urn(seed: str) -> str:
    h = f"md5({seed})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


OP1_SQL = f"""
with r as (
  select page_id, url as target_uri, coalesce(html, '') as payload,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) as source_headers,
    'response|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, '')) as seed from pages),
t as (
  select page_id, target_uri, source_headers, {_sql_urn('seed')} as refers_to, 'sha256:' || sha256(payload) as source_payload_digest,
    {_sql_text('payload')} as text,
    trim(regexp_replace({_sql_references(f"regexp_extract(payload, '{TITLE}', 1)")}, '[ \\t\\r\\n\\f\\x0B\\x{{00A0}}]+', ' ', 'g')) as title from r),
b as (
  select *, {_sql_urn("'metadata|' || refers_to")} as meta_id, {_sql_urn("'conversion|' || refers_to")} as text_id,
    'http-header: ' || replace(source_headers, chr(13) || chr(10), chr(13) || chr(10) || 'http-header: ') || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) || 'source-payload-digest: ' || source_payload_digest || chr(13) || chr(10) as fields from t),
u as (
  select page_id, 'metadata' as record_type, meta_id as record_id, refers_to, target_uri, null::varchar as concurrent_to, 'application/warc-fields' as content_type, source_headers, source_payload_digest, fields as block from b
  union all
  select page_id, 'conversion', text_id, refers_to, target_uri, meta_id, 'text/plain; charset=utf-8', source_headers, source_payload_digest, text from b)
select page_id, record_type, record_id, refers_to, target_uri, '{DATE}' as refers_to_date, concurrent_to, content_type, source_headers, source_payload_digest,
  'sha256:' || sha256(block) as block_digest, octet_length(encode(block))::bigint as content_length, block from u
"""
