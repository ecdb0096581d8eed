"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from breakweave import registry

D = "/root/testdata/sf0.001"
SOME = ("failures", "causes", "annotations", "history_compare", "normalise", "exact_retry", "router", "reader_pytest", "reader_eslint", "reader_cargo", "reader_python", "repeats", "exit_status", "secondaries", "secondaries_large", "snippets", "raw_fallback", "bounded_capture", "document_azure_logissue")


def cells(rows):
    return sorted(tuple("" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{D}/{f}')")
    got = registry.queries()[name](spark, D)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert cells(got.select(*cols).collect()) == cells(want)
