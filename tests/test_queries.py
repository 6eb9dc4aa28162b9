"""Every query that has SQL gives what DuckDB gives; the others run."""

import re

import duckdb
import pytest

from turnmill.functions.text import VERBS
from turnmill.plans import queries
from turnmill.sources.adapters import prompts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer orders lineitem events documents pages labels conversations part supplier".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.ORACLE:
        want = duck.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_features_see_the_prompts(spark):
    """A turn with a prompt has its verb and files, one without has none, and every turn has one row."""
    got = {r.turn_id: r for r in queries.QUERIES["p2_prompt_features"](spark, SF).collect()}
    said = {r.turn_id: r.text for r in prompts(spark, SF).selectExpr("session * 10 + idx AS turn_id", "text").collect()}
    verb = lambda t: next((v for v in VERBS if re.search(rf"(?i)\b{v}", t)), "none")
    assert all(r.bucket.split(":")[1] == verb(said.get(i, "")) for i, r in got.items())
    assert len({r.bucket.split(":")[1] for r in got.values()}) > 2 and any(r.file_refs for r in got.values())
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet'").fetchall()[0][0]
