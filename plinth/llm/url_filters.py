"""URL filters by a sort-merge range join over reversed-host keys.

The key of a host is its labels in reverse order, each with a closing dot (`www.example.net` is
`net.example.www.`). All hosts below a rule's host are then one interval of keys: those that
begin with the rule's key. Pages are sorted by key within their partitions and merged with the
sorted rule keys in one sweep; a stack holds the rule hosts whose intervals contain the current
key, each nested in the one below it. Of all rules on the stack whose path begins the page's
path, the one with the longest host and path together wins; of equally long ones the longer host.

Rules go to the tasks in blocks of BLOCK_RULES rules and BLOCK_BYTES bytes at most, in the order of a hash. One block
is swept over the pages where they are: nothing is shuffled, so a site with a third of all pages is no harder
than others. More blocks are swept one after another over the table's different (host, path) pairs, which carry
the best rule so far, with the length of its host, from block to block (written in between), and the pages take their pair's rule
by a join that deals a pair with very many pages over several tasks. The result doesn't depend on the number of blocks.

Defined results: a null url, or one without `://`, has an empty host and path and no rule. No
host is below an empty rule host. A rule with a null host, path or verdict fits nothing. Repeated rules
count once (block wins over allow); repeated pages are judged each, and ids may be null. Without a fitting rule the
verdict is DEFAULT. An empty table gives an empty one; further columns pass through `filter_urls` (one named host, path,
rule or verdict is replaced).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, discard, fresh, give_back, hot_keys, join_spread, table, written

DEFAULT = "allow"
BLOCK_RULES, BLOCK_BYTES = 100_000, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: verdict, host, path
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What stands between the host and the next `?` or `#`."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(name: str) -> str:
    return "".join(f"{label}." for label in reversed(name.split("."))) if name else ""


#: A rule, its verdict and the length of its host.
Best = tuple[str | None, str, int]
NONE: Best = (None, DEFAULT, 0)


class Sweep:
    """The rules of one block, sorted by key; `rule_of` takes sorted keys."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_key: dict[str, dict[str, Best]] = {}
        for verdict, name, prefix in sorted(rules, key=lambda r: (r[0] == "block", r[0] or "")):
            if name and prefix is not None and verdict:
                by_key.setdefault(host_key(name), {})[prefix] = (name + prefix, verdict, len(name))
        self.keys = sorted(by_key)
        self.paths = [by_key[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in paths}, reverse=True) for paths in self.paths]
        self.at, self.stack = 0, []

    def start(self, key: str) -> None:
        """Open the intervals that begin before key and contain it, and go on from there."""
        self.stack, self.at = [], bisect_left(self.keys, key)
        for end, c in enumerate(key):
            if c == "." and (i := bisect_left(self.keys, key[: end + 1])) < self.at and self.keys[i] == key[: end + 1]:
                self.stack.append(i)

    def rule_of(self, key: str, page_path: str) -> Best:
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            self._close(self.keys[self.at])
            self.stack.append(self.at)
            self.at += 1
        self._close(key)
        best = None
        for i in reversed(self.stack):
            for n in self.lengths[i]:
                if n <= len(page_path) and (found := self.paths[i].get(page_path[:n])):
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best or NONE

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()


def _better(a: Best, b: Best) -> Best:
    """Of two fitting rules the longer one; of equally long ones that of the longer host. Rules that agree in both are one."""
    return max(a, b, key=lambda r: (-1, 0) if r[0] is None else (len(r[0]), r[2]))


def _swept(rules: list[tuple[str, str, str]]):
    """Sweeps rows sorted by key; rule, verdict and length are those of the blocks before, if the rows have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep, last = Sweep(rules), None
        for batch in batches:
            out = []
            for k, page_path in zip(batch["key"], batch["path"]):
                if last is None:
                    sweep.start(k)
                last = k
                out.append(sweep.rule_of(k, page_path))
            if "rule" in batch:
                out = [_better(a, (r if isinstance(r, str) else None, v, n)) for a, r, v, n in zip(out, batch["rule"], batch["verdict"], batch["length"])]
            batch["rule"], batch["verdict"], batch["length"] = [r[0] for r in out], [r[1] for r in out], [r[2] for r in out]
            yield batch
        give_back()

    return run


def _blocks(rules: DataFrame, block_rules: int) -> Iterator[list[tuple[str, str, str]]]:
    """The different rules in blocks of bounded size; one block at least. Rules of one host may be in several."""
    block, size, n = [], 0, 0
    plain = rules.select(F.lower("verdict").alias("v"), F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"))
    plain = plain.where("v is not null and h <> '' and p is not null").groupBy("h", "p").agg(F.max("v").alias("v"))  # block > allow
    for row in plain.orderBy(F.xxhash64("h", "p")).toLocalIterator():
        more = len(row["h"]) + len(row["p"]) + 8
        if block and (len(block) >= block_rules or size + more > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row["v"], row["h"], row["p"]))
        size += more
        n += 1
    if block or not n:
        yield block


def match_rules(pages: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str, block_rules: int = BLOCK_RULES) -> DataFrame:
    """pages (host and path name their columns, without nulls) with the columns rule and verdict. rules: verdict, host, path."""
    row = [f"c{i}" for i in range(len(pages.columns))]  # whatever the names of pages' columns
    plain = pages.toDF(*row).withColumns({"host": F.col(row[pages.columns.index(host)]), "path": F.col(row[pages.columns.index(path)])})
    in_order = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")))

    def sweep(rows: DataFrame, block: list[tuple[str, str, str]]) -> DataFrame:
        rows = rows.withColumn("key", in_order).sortWithinPartitions("key")
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n not in ("rule", "verdict", "length")) + ", rule string, verdict string, length int"
        return rows.mapInPandas(_swept(block), schema).drop("key")

    blocks = _blocks(rules, block_rules)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return sweep(plain, block).select(*row, "rule", "verdict").toDF(*pages.columns, rule, verdict)
    pairs = written(sweep(plain.select("host", "path").distinct(), block), "rules")
    while more is not None:
        pairs, before = written(sweep(pairs, more), "rules"), pairs
        discard(before)
        more = next(blocks, None)
    whole = F.concat("host", "path").alias("pair")  # no host holds a slash, no path begins otherwise
    rows = plain.select(whole, F.monotonically_increasing_id().alias("id"), F.struct(*row).alias("row"))
    often = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    found = join_spread(rows, pairs.select(whole, "rule", "verdict"), "pair", hot_keys(often, "pair", "n", pages.count()), "id")
    return found.select("row.*", "rule", "verdict").toDF(*pages.columns, rule, verdict)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """pages with host, path, rule and verdict."""
    made = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in made]
    names = fresh(pages, *(f"_{m}" for m in made))
    rows = pages.select(*map(col, rest), host(col(url)).alias(names[0]), path(col(url)).alias(names[1]))
    return match_rules(rows, rules, *names, block_rules).toDF(*rest, *made)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

OP8_SQL = rf"""
with rules(v, h, p) as (values {_VALUES}),
r as (select page_id, row_number() over () as n, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
u as (
  select page_id, n, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, rule, coalesce(v, '{DEFAULT}') as verdict from (
  select u.page_id, u.host, u.path, h || p as rule, v,
    row_number() over (partition by u.n order by length(h || p) desc nulls last) as k
  from u left join rules on (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p))
where k = 1
"""
