"""The cache as a data source with transactions: the jobs of a save and its manifest appear together or not at all.

`commit_jobs` writes through the data source `job_cache`. Each task writes Parquet files of its own under
path/data and tells the driver which; when all tasks are done, `commit` publishes them with one file,
path/commits/<number>.json, which appears by a rename and says of every city when it was cached, how many jobs it has and in which
files they are (cities that the save doesn't name keep what they had). A save that fails, at whatever point, publishes nothing: readers
see the cities as they were, and the files of its tasks are deleted (`vacuum` deletes those of lost executors and of older commits).
Tasks that run twice write different files, of which the driver lists those of one attempt.

One save at a time for a path: a second one that began before the first had ended raises. The driver holds a
line a city and the names of its files, no jobs. Files are read by Spark itself.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import CacheConflictError
from ..operators.dedup import deduplicate_jobs
from ..operators.filters import is_fresh
from .cache import city_key

MANIFEST = "city string, cached_at timestamp_ntz, job_count long, city_key string"
KEY, CITY, MARK = "city_key", "_city", "_mark"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: by city key its name, and its files with their rows."""

    cities: dict[str, str] = field(default_factory=dict)
    files: dict[str, list[tuple[str, int]]] = field(default_factory=dict)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else f"file://{path.removeprefix('file:')}")


def snapshot(path: str) -> tuple[int, dict[str, dict]]:
    """The number of the last commit (0: none) and its cities by key: city, cached_at, job_count, files."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
    if not names:
        return 0, {}
    with store.open_input_stream(f"{root}/commits/{names[-1]}") as stream:
        return int(names[-1].removesuffix(".json")), json.loads(stream.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, cached_at: str, after: int):
        self.path, self.cached_at, self.after, self.run = path, cached_at, after, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        context = TaskContext.get()
        task = f"{self.run}-{context.partitionId()}-{context.taskAttemptId()}"
        out, key, writer, n = Written(), None, None, 0

        def close() -> None:
            if writer is not None:
                writer.close()

        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                for city, name in set(zip(table[KEY].to_pylist(), table[CITY].to_pylist())):
                    out.cities[city] = max(name, out.cities.get(city, ""))  # of two spellings of a key one, always the same
                jobs = table.filter(pc.invert(table[MARK]))
                for own in dict.fromkeys(jobs[KEY].to_pylist()):  # rows come sorted by it
                    rows = jobs.filter(pc.equal(jobs[KEY], own)).drop_columns([CITY, MARK])
                    if own != key:
                        close()
                        store.create_dir(f"{root}/data/{own}", recursive=True)
                        key, name, n = own, f"data/{own}/{task}-{n}.parquet", n + 1
                        writer = pq.ParquetWriter(f"{root}/{name}", rows.schema, filesystem=store)
                        out.files.setdefault(own, []).append((name, 0))
                    writer.write_table(rows)
                    name, held = out.files[own][-1]
                    out.files[own][-1] = name, held + rows.num_rows
            close()
        except BaseException:
            close()
            _delete(store, root, out)
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        number, cities = snapshot(self.path)
        if number != self.after:
            self.abort(messages)
            raise CacheConflictError(f"{self.path}: another save was committed meanwhile")
        told = [m for m in messages if m is not None]
        new: dict[str, dict] = {}
        for key, name in sorted(pair for m in told for pair in m.cities.items()):
            new[key] = {"city": name, "cached_at": self.cached_at, "job_count": 0, "files": []}
        for m in told:
            for key, files in m.files.items():
                new[key]["files"] += [f for f, _ in files]
                new[key]["job_count"] += sum(n for _, n in files)
        store.create_dir(f"{root}/commits", recursive=True)
        part = f"{root}/commits/.{self.run}"
        with store.open_output_stream(part) as stream:
            stream.write(json.dumps(cities | new).encode())
        store.move(part, f"{root}/commits/{number + 1:020d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                _delete(store, root, m)


def _delete(store: fs.FileSystem, root: str, written: Written) -> None:
    for files in written.files.values():
        for name, _ in files:
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")


class JobCache(DataSource):
    """The data source `job_cache`; options: path, cached_at, and after: the number of the commit that the save began behind."""

    @classmethod
    def name(cls) -> str:
        return "job_cache"

    def schema(self) -> str:
        return MANIFEST

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["cached_at"], int(self.options["after"]))


def commit_jobs(jobs: DataFrame, cities: DataFrame, path: str, asof: datetime.datetime) -> None:
    """jobs (with city and pos), the best of each identity, and an entry for each of cities, those without jobs too."""
    jobs.sparkSession.dataSource.register(JobCache)
    after, _ = snapshot(path)
    unique = deduplicate_jobs(jobs)
    named = unique.select(*unique.columns, city_key(F.col("city")).alias(KEY), F.coalesce("city", F.lit("")).alias(CITY), F.lit(False).alias(MARK))
    marks = cities.select(F.coalesce("city", F.lit("")).alias(CITY)).distinct().withColumns({KEY: city_key(F.col(CITY)), MARK: F.lit(True)})
    rows = named.unionByName(marks, allowMissingColumns=True).hint("rebalance", KEY).sortWithinPartitions(KEY)
    rows.write.format("job_cache").mode("append").option("path", path).option("cached_at", asof.isoformat(sep=" ")).option("after", str(after)).save()


def read_committed(spark: SparkSession, path: str, schema: StructType | str, asof: datetime.datetime, max_age_hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The jobs of fresh cities (schema: that of the jobs saved), and the manifest's rows of fresh ones, both of one commit."""
    _, cities = snapshot(path)
    rows = [(c["city"], datetime.datetime.fromisoformat(c["cached_at"]), c["job_count"], key) for key, c in cities.items()]
    manifest = spark.createDataFrame(rows, MANIFEST).where(is_fresh(F.col("cached_at"), asof, max_age_hours))
    files = [f"{path.rstrip('/')}/{f}" for r in manifest.select(KEY).collect() for f in cities[r[KEY]]["files"]]
    full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = full if KEY in full.names else StructType([*full.fields, *StructType.fromDDL(f"{KEY} string").fields])
    return (spark.read.schema(full).parquet(*files) if files else spark.createDataFrame([], full)), manifest


def vacuum(path: str, keep: int = 1) -> int:
    """Delete the files that none of the last `keep` commits lists, and older commits. Only while no save or read is under way."""
    store, root = opened(path)
    number, _ = snapshot(path)
    kept, gone = set(), 0
    for info in store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and int(info.base_name.removesuffix(".json")) > number - keep:
            with store.open_input_stream(info.path) as stream:
                kept |= {f for c in json.loads(stream.read()).values() for f in c["files"]}
        else:
            store.delete_file(info.path)
            gone += 1
    for info in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True, recursive=True)):
        if info.is_file and info.path.removeprefix(f"{root}/") not in kept:
            store.delete_file(info.path)
            gone += 1
    return gone
