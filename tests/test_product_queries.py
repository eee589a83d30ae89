"""Every query of the plans that has SQL against that SQL."""

import duckdb
import pytest

from friction.plans import engine_queries, product_queries, rule_queries, service_queries, stream_queries, wire_queries

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


ENGINE = ("element_map", "page_metadata", "choose_variant", "choose_variant_exploring", "dispatch", "detect_adaptive", "detect_adaptive_dense")
RULES = ("detect_all", "detect_dense", "rule_thrash", "rule_backtrack", "rule_hover_hunt", "rule_rapid_scroll", "rule_scroll_overshoot")
QUERIES = product_queries.queries() | service_queries.queries() | wire_queries.queries() | stream_queries.queries() | {k: engine_queries.queries()[k] for k in ENGINE} | {k: rule_queries.queries()[k] for k in RULES}
SQL = product_queries.oracle_sql() | service_queries.oracle_sql() | wire_queries.oracle_sql() | stream_queries.oracle_sql() | {k: engine_queries.oracle_sql()[k] for k in ENGINE} | {k: rule_queries.oracle_sql()[k] for k in RULES}


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert cols == sorted(want.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b and a
