"""The SQL of the queries that have some, over texts that are null, empty, repeated, long or tied."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.llm import queries
from test_operators import rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sql")
    made = [(d, t, lang, source) for d, t, lang, source, *_ in rows()]
    cols = [pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.string(), pa.string(), pa.string()))]
    pq.write_table(pa.table(cols, ["doc_id", "text", "lang", "source"]), path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(cols)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
