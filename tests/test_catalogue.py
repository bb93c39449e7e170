"""The registered queries against their SQL on the smallest driver tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
SOME = ["kg_topk_expr", "kg_optional_filter", "kg_not_exists_correlated", "kg_union", "kg_path_plus", "kg_graph_var", "kg_construct", "kg_shape_mincount", "kg_nt_roundtrip", "parse_date_forms", "weighted_score", "threshold_sweep"]


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in SF.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rows = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rows.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 10
