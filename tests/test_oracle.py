"""Every registered query against its DuckDB oracle (sf0.001)."""
import re

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_compare import canon, duck

CORPUS = re.compile(r"op\d+_|pipeline$")  # tested with their subpackage
QUERIES = {k: f for k, f in entry.queries().items() if not CORPUS.match(k)}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if not CORPUS.match(k)}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_or_is_known_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"mon_run_observed"}, rows_only


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "run_count" in df.columns


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[key]).df()
    gc, gr = canon(got)
    wc, wr = canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_rows_only_queries_run(spark):
    for key in set(QUERIES) - set(ORACLE):
        assert QUERIES[key](spark, SF_SMALL).count() > 0
