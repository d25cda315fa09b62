import os

import duckdb
import pytest

from tests.conftest import SMALL

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def against_oracle(spark, name, folder):
    """Spark rows equal to the oracle's, as sorted text."""
    from settlekit.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)

    def rows(found):
        return sorted(map(str, found))

    assert rows(tuple(r) for r in got.select(names).collect()) == rows(want.fetchall())


def save(spark, df, folder, name):
    """One Parquet file <folder>/<name>.parquet, readable by DuckDB too."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.Table.from_pandas(df, preserve_index=False) if not isinstance(df, pa.Table) else df, f"{folder}/{name}.parquet")
