"""The catalog of cities: platform and portal of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlatformNotSupportedError
from ..functions.urls import PLATFORM_PATTERNS

#: The cities with their platforms and portals.
CITIES = (
    ("Phoenix", "PeopleSoft", "https://hcmprod.phoenix.gov/psc/hcmprodtam/EMPLOYEE/COP_TAM/c/HRS_HRAM_FL.HRS_CG_SEARCH_FL.GBL?FOCUS=Applicant"),
    ("Scottsdale", "NeoGov", "https://www.governmentjobs.com/careers/scottsdaleaz"),
    ("Pima County", "NeoGov", "https://www.governmentjobs.com/careers/pima"),
    ("Tempe", "NeoGov", "https://www.governmentjobs.com/careers/tempe"),
    ("Mesa", "NeoGov", "https://www.governmentjobs.com/careers/mesaaz"),
    ("Glendale", "NeoGov", "https://www.governmentjobs.com/careers/glendaleaz"),
    ("Chandler", "NeoGov", "https://www.governmentjobs.com/careers/chandleraz"),
    ("Gilbert", "NeoGov", "https://www.governmentjobs.com/careers/gilbert"),
    ("Apache Junction", "NeoGov", "https://www.governmentjobs.com/careers/apachejunctionaz"),
    ("Avondale", "NeoGov", "https://www.governmentjobs.com/careers/avondale"),
    ("Buckeye", "NeoGov", "https://www.governmentjobs.com/careers/buckeyeaz"),
    ("Flagstaff", "NeoGov", "https://www.governmentjobs.com/careers/flagstaffaz"),
    ("Goodyear", "NeoGov", "https://www.governmentjobs.com/careers/goodyearaz"),
    ("Prescott", "NeoGov", "https://www.governmentjobs.com/careers/prescott"),
    ("Cottonwood", "NeoGov", "https://www.governmentjobs.com/careers/cottonwoodaz"),
)
PLATFORMS = ("NeoGov", "PeopleSoft")


def catalog(spark: SparkSession, more: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """city, platform, url; of added cities the last one counts."""
    known = {c: (p, u) for c, p, u in (*CITIES, *more)}
    return spark.createDataFrame([(c, p, u) for c, (p, u) in known.items()], "city string, platform string, url string")


def add_city(cities: DataFrame, city: str, platform: str, url: str) -> DataFrame:
    new = cities.sparkSession.createDataFrame([(city, platform, url)], "city string, platform string, url string")
    return cities.where(F.col("city") != city).unionByName(new)


def platform_of(city: str, url: str | None = None) -> tuple[str, str]:
    """(platform, url) of a city by its name, else by the url's text."""
    for name, platform, portal in CITIES:
        if name == city:
            return platform, url or portal
    for pattern, platform in PLATFORM_PATTERNS if url else ():
        if pattern in url.lower():
            return platform, url
    raise PlatformNotSupportedError(f"no platform known for {city} {url or ''}".strip())
