import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as an sf folder and gives its path."""

    def make(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


@pytest.fixture
def sql(tmp_path):
    """Rows of DuckDB SQL over the folder's tables, columns in the order asked for."""

    def run(query, columns, *tables):
        con = duckdb.connect()
        for t in tables:
            files = [str(f) for f in (tmp_path / f"{t}.parquet").glob("*.parquet")]
            con.execute(f"create view {t} as select * from read_parquet({files})")
        rel = con.sql(query)
        at = [list(rel.columns).index(c) for c in columns]
        return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)

    return run


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
