"""The operators' queries against their SQL on the smallest tables; those without SQL must run with the columns promised."""

import glob

import duckdb
import pandas as pd
import pytest

from millrace.llm import queries as Q
from tools.compare import normal

COLUMNS = {
    "p1_found": ["doc_id", "subject"], "p3_found": ["source", "lang", "domain"], "p4_found": ["source"], "p5_found": ["doc_id_a", "doc_id_b"],
    "p6_found": ["doc_id", "train_ord"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, small):
    df = Q.QUERIES[name](spark, small)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if name in COLUMNS:
        assert list(df.columns) == COLUMNS[name]
    if name in Q.SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{small}/*.parquet"):
            con.sql(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
        rel = con.sql(Q.SQL[name])
        assert normal(got) == normal(pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object))


def test_entry_names():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
