import duckdb
import pytest

from tests.llm.conftest import SMALL
from trellis.llm import queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    b = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=str)
    assert a == b


def test_contract_columns(spark):
    want = {
        "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3": "doc_id held_out lang_pred score", "op4": "doc_id n_bytes n_tokens over_limit",
        "op8": "page_id url text n_chars", "op10": "doc_id fingerprint component_id",
    }
    for name, q in queries.QUERIES.items():
        if (k := name.split("_")[0]) in want:
            assert set(want[k].split()) <= set(q(spark, SMALL).columns)
