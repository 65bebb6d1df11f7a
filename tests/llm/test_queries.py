"""Every query with SQL against DuckDB on the smallest tables, the others for the stated shape and a stable run."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from loomspan.llm import queries
from tools_compare import plain

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p6_found": {"line_id", "field_name", "pii_type"}, "p8_found": {"doc_id"}, "p10_found": {"doc_id"}, "p9_mix": {"doc_id", "source", "n_tokens", "copies"}}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.sql(queries.SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert Counter(tuple(plain(x[c]) for c in cols) for x in df.collect()) == Counter(tuple(plain(x[k]) for k in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_give_the_same_rows(spark, name):
    a, b = (Counter(map(str, queries.QUERIES[name](spark, DATA).collect())) for _ in range(2))
    assert a == b and COLUMNS.get(name, set()) <= set(queries.QUERIES[name](spark, DATA).columns)
