"""Nearest vectors by a cell index: a table of vectors partitioned by cell, and the cells' centroids.

The cells are fitted by k-means on directions (FIT_ITERATIONS rounds, on a sample of at most FIT_ROWS vectors and FIT_BYTES bytes,
chosen by a hash of the key); every vector is put into the cell of its nearest centroid. A cell of very many
rows is written by several tasks. A search looks into the `probes` cells nearest to each query (how many
give a recall of TARGET_RECALL is measured on the sample and kept with the index) and ranks
all their rows by exact distance, so distances are exact and only the choice of cells is approximate. With
`exact=True` it goes on into every cell that could hold a nearer row: by the triangle inequality of angles no row of a
cell is nearer than the query's angle to the centroid less the cell's radius.

Queries go in blocks of BLOCK_BYTES bytes; a block is broadcast, the rows of its cells are read where they are and each task
keeps the k best of each query, so no pair of a query and a row is ever a row of a table. Ties (distances rounded to
9 digits) go by key. A zero vector has distance 1 to all and a cell of its own (ZERO), which every search
looks into; null vectors, and those of other sizes or with NaN, are in no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .filters import valid_vector

FIT_ROWS, FIT_BYTES, FIT_ITERATIONS = 20_000, 64 << 20, 12
MAX_CELLS = 4096
TARGET_RECALL, TRIED, NEIGHBOURS = 0.95, 256, 10
BLOCK_BYTES = 8 << 20
ZERO = -1
DIGITS = 9


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of length one by k-means on directions; the first ones are chosen far from each other."""
    rng, units = np.random.default_rng(seed), _unit(sample)
    units = units[np.linalg.norm(units, axis=1) > 0]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    centres = units[rng.integers(len(units))][None, :]
    gap = 1 - units @ centres[0]
    while len(centres) < min(cells, len(units)) and gap.max() > 1e-12:
        weights = np.clip(gap, 0, None)
        centres = np.vstack([centres, units[rng.choice(len(units), p=weights / weights.sum())]])
        gap = np.minimum(gap, 1 - units @ centres[-1])
    for _ in range(FIT_ITERATIONS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def enough(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many cells a search must look into for TARGET_RECALL: measured on neighbours within the sample, which are farther than those in the whole table."""
    units = _unit(sample)
    if not len(units) or not len(centres):
        return 1
    cell = (units @ centres.T).argmax(axis=1)
    ranks = []
    for q in units[:: max(1, len(units) // TRIED)]:
        place = np.empty(len(centres), dtype=int)
        place[np.argsort(-(q @ centres.T), kind="stable")] = np.arange(len(centres))
        ranks += place[cell[np.argsort(-(units @ q), kind="stable")[:NEIGHBOURS]]].tolist()
    return int(np.quantile(ranks, TARGET_RECALL, method="higher")) + 1


def _valid(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    return vectors.where(F.coalesce(valid_vector(F.col(vector), dimensions), F.lit(False)))


def write_cells(vectors: DataFrame, path: str, key: str, vector: str = "embedding", cells: int | None = None) -> None:
    """Fit the cells (their number: the root of the rows, MAX_CELLS at most, if not told) and write path/cells and path/centroids."""
    spark = vectors.sparkSession
    first = vectors.where(F.size(vector) > 0).select(F.size(vector)).first()
    dimensions = first[0] if first else 1
    good = _valid(vectors, vector, dimensions).select(key, F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    rows = good.count()
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(rows)))
    most = max(1, min(FIT_ROWS, FIT_BYTES // max(1, 8 * dimensions)))
    sample = np.array(good.orderBy(F.xxhash64(key)).limit(most).select("vector").toPandas()["vector"].tolist()).reshape(-1, dimensions)
    centres = fitted(sample, cells)

    @F.pandas_udf("cell int, angle double")
    def cell(found: pd.Series) -> pd.DataFrame:
        units = _unit(np.array(found.tolist()).reshape(-1, dimensions))
        near = units @ centres.T if len(centres) else np.zeros((len(units), 1))
        zero = ~units.any(axis=1)
        return pd.DataFrame({"cell": np.where(zero, ZERO, near.argmax(axis=1)), "angle": np.where(zero, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))})

    placed = good.withColumn("c", cell("vector")).select(key, "vector", "c.angle", "c.cell").hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    placed.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")  # that of an empty table of cells can't be read from it
    probes = enough(sample, centres)
    about = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centroid array<double>, probes int")
    radius = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")) if rows else spark.createDataFrame([], "cell int, radius double, n long")
    about.join(radius.where(F.col("cell") != ZERO), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


class Probes:
    """A block of queries and the cells that each of them looks into."""

    def __init__(self, ids: list, queries: np.ndarray, k: int):
        self.ids, self.k, self.units = ids, k, _unit(queries)
        self.of: dict[int, np.ndarray] = {}

    def set(self, cells: list[int], wanted: np.ndarray) -> None:
        """wanted: a row a query, a column a cell."""
        self.of = {c: rows for c, column in zip(cells, wanted.T) if len(rows := np.flatnonzero(column))}


def _found(shared, key: str):
    """The k best rows of each query among the rows of its cells in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: Probes = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys, cells = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
            units = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)) if len(keys) else np.zeros((0, 1))
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                for q, near in zip(probes.of.get(int(cell), ()), np.round(1 - probes.units[probes.of.get(int(cell), [])] @ units[rows].T, DIGITS)):
                    kept = best.get(q)
                    if len(near) > probes.k:  # ties stay
                        some = np.flatnonzero(near <= np.partition(near, probes.k - 1)[probes.k - 1])
                        if kept is not None and len(kept[0]) == probes.k:
                            some = some[near[some] <= kept[0][-1]]
                        new = near[some], keys[rows[some]]
                    else:
                        new = near, keys[rows]
                    both = new if kept is None else (np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]]))
                    order = sorted(range(len(both[0])), key=lambda i: (both[0][i], both[1][i]))[: probes.k]
                    best[q] = both[0][order], both[1][order]
        out = [(probes.ids[q], key_, float(d)) for q, (ds, ks) in best.items() for d, key_ in zip(ds, ks)]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], shared.types[0]), pa.array(columns[1], shared.types[1]), pa.array(columns[2], pa.float64())], ["query_id", key, "distance"])

    return run


class _Shared:
    """A broadcast with the Arrow types of the two keys."""

    def __init__(self, broadcast, types: tuple[pa.DataType, pa.DataType]):
        self.broadcast, self.types = broadcast, types

    @property
    def value(self) -> Probes:
        return self.broadcast.value


def search_cells(spark: SparkSession, path: str, queries: DataFrame, key: str, k: int, probes: int | None = None, query_id: str = "query_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank, key and distance of the k rows nearest to each query (queries: query_id, vector), by `probes` cells each (None: as many as the index was found to need)."""
    index = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/cells")
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MAX_CELLS rows at most
    cells, centres = [r["cell"] for r in table], np.array([r["centroid"] for r in table])
    radius = np.array([r["radius"] for r in table])
    probes = probes or max([1, *(r["probes"] for r in table)])
    any_row = None if len(cells) else index.select(F.size("vector")).first()  # zero vectors only, or none
    dimensions = centres.shape[1] if len(cells) else any_row[0] if any_row else 1
    types = to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(index.schema[key].dataType)
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, `{key}` {index.schema[key].dataType.simpleString()}, distance double"
    good = _valid(queries, vector, dimensions).select(F.col(query_id).alias("query_id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    order = Window.partitionBy("query_id").orderBy("distance", key)

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def scan(block: Probes) -> DataFrame:
        wanted = index.where(F.col("cell").isin([*block.of])).select(key, "vector", "cell")
        return wanted.mapInArrow(_found(_Shared(spark.sparkContext.broadcast(block), types), key), schema)

    def searched(ids: list, vectors: list) -> DataFrame:
        block = Probes(ids, np.array(vectors), k)
        angles = np.arccos(np.clip(block.units @ centres.T, -1, 1)) if len(cells) else np.zeros((len(ids), 0))
        near = angles.argsort(axis=1, kind="stable")[:, :probes]
        looked = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(looked, near, True, axis=1)
        every = [*cells, ZERO]
        block.set(every, np.hstack([looked, np.ones((len(ids), 1), dtype=bool)]))
        found = ranked(scan(block))
        if not exact:
            return found
        furthest = {r["query_id"]: r["d"] for r in found.where(F.col("rank") == k).groupBy("query_id").agg(F.max("distance").alias("d")).collect()}  # a row a query of the block
        reach = np.array([math.acos(max(-1.0, 1 - d)) if (d := furthest.get(i)) is not None else math.pi for i in ids])
        more = Probes(ids, np.array(vectors), k)
        zero = ~more.units.any(axis=1)
        more.set(cells, ((angles - radius <= reach[:, None] + 1e-6) | zero[:, None]) & ~looked)
        return ranked(found.drop("rank").unionByName(scan(more))) if more.of else found

    out, ids, vectors, size = [], [], [], 0
    for row in good.toLocalIterator():
        ids.append(row["query_id"])
        vectors.append(row["vector"])
        size += 8 * dimensions + 64
        if size >= BLOCK_BYTES:
            out.append(searched(ids, vectors))
            ids, vectors, size = [], [], 0
    if ids or not out:
        out.append(searched(ids, np.zeros((0, dimensions)) if not ids else vectors))
    return reduce(DataFrame.unionByName, out).select("query_id", "rank", key, "distance")
