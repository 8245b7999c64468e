import numpy as np
import pytest

from plinth.operators import cells
from plinth.operators.search import nearest

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def queries_of(df, every=20):
    return df.where(f"vec_id % {every} = 0").withColumnRenamed("vec_id", "query_id")


def plain(vectors, k, every=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in enumerate(vectors) if v is not None]
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in good}
    return {(q, r + 1, i, d) for q in unit if q % every == 0 for r, (d, i) in enumerate(sorted((round(1 - float(unit[q] @ u), 9), i) for i, u in unit.items())[:k])}


def clustered(n, size=16, groups=12):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, size))
    return [centres[rng.integers(groups)] + 0.3 * rng.normal(size=size) for _ in range(n)]


def rows(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in df.collect()}


def recall(found, want):
    return len({x[::2] for x in found} & {x[::2] for x in want}) / len(want)


def test_exact_and_approximate(spark, tmp_path, monkeypatch):
    vectors = clustered(600)
    vectors[40:60] = [vectors[40]] * 20  # copies: ties
    vectors[100], vectors[101] = np.zeros(16), np.zeros(16)
    vectors[102] = None
    df, path, want = table(spark, vectors), str(tmp_path), plain(vectors, 10)
    cells.write_cells(df, path, "vec_id")
    assert rows(cells.search_cells(spark, path, queries_of(df), "vec_id", 10, probes=1, exact=True)) == want
    near = rows(cells.search_cells(spark, path, queries_of(df), "vec_id", 10, probes=6))
    assert recall(near, want) >= 0.9
    assert near == rows(cells.search_cells(spark, path, queries_of(df), "vec_id", 10, probes=6))
    monkeypatch.setattr(cells, "BLOCK_BYTES", 600)  # a few queries a block
    assert rows(cells.search_cells(spark, path, queries_of(df), "vec_id", 10, probes=2, exact=True)) == want


def test_only_the_probed_cells_are_read(spark, tmp_path):
    df = table(spark, clustered(300))
    cells.write_cells(df, str(tmp_path), "vec_id", cells=10)
    out = cells.search_cells(spark, str(tmp_path), queries_of(df, 300), "vec_id", 3, probes=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert out.count() == 3 and spark.read.parquet(f"{tmp_path}/cells").count() == 300


def test_agrees_with_nearest(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    cells.write_cells(df, str(tmp_path), "vec_id")
    queries = queries_of(df)
    approximate = cells.search_cells(spark, str(tmp_path), queries, "vec_id", 10)
    found = {}
    for r in approximate.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in queries.collect():
        want = {r["vec_id"] for r in nearest(df, q["embedding"], 10, "vec_id").collect()}
        hits, total = hits + len(want & found[q["query_id"]]), total + len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("vectors", [[], [[0.0, 0.0]], [[1.0, 2.0]], [None, [float("nan"), 1.0], [1.0, 0.0]], [[1.0, 1.0]] * 30])
def test_small_tables(spark, tmp_path, vectors):
    df = table(spark, vectors)
    cells.write_cells(df, str(tmp_path), "vec_id")
    got = rows(cells.search_cells(spark, str(tmp_path), queries_of(df, 1), "vec_id", 4, exact=True))
    assert got == plain([None if v is None or np.isnan(v).any() else v for v in vectors], 4, 1)


def test_fit_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "FIT_ROWS", 20)
    df = table(spark, clustered(200))
    cells.write_cells(df, str(tmp_path), "vec_id")
    assert spark.read.parquet(f"{tmp_path}/centroids").agg({"n": "sum"}).first()[0] == 200
