"""Saved grid pages of the second platform: rows of cells by position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.html import parse

ROW_CLASSES = {"PSLEVEL1GRIDROW", "ps_grid-row"}
SCHEMA = "city string, title string, url string, source_job_id string, department string, location string, posted_date string, closing_date string"


def grid_rows(page: str | None, city: str, base_url: str) -> list[tuple]:
    """The rows with a title; a missing location is the city."""
    out = []
    for tr in parse(page).all(lambda n: n.tag == "tr" and bool(ROW_CLASSES & n.classes)):
        cells = [n.text() for n in tr.all(lambda n: n.tag in ("td", "span"))][:8] + [""] * 5
        link = tr.first(lambda n: n.tag == "a")
        title = link.text() if link else ""
        href = link.attrs.get("href", "") if link else ""
        if href and not href.startswith("http"):
            href = base_url.split("/psc/")[0] + href
        if title:
            out.append((city, title, href, cells[0], cells[1], cells[2] or city, cells[3], cells[4]))
    return out


def jobs_of_grids(pages: DataFrame) -> DataFrame:
    """pages: city, base_url, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for c, b, h in zip(batch["city"], batch["base_url"], batch["html"]) for r in grid_rows(h, c, b)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("city", "base_url", "html").mapInPandas(run, SCHEMA)
