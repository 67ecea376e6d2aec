"""Every query with an oracle gives the oracle's rows; queries without one run."""

import pytest

from storyspark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def _rows(rows):
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(tidy, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(ORACLES[name]).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"select {quoted} from ({ORACLES[name]})").fetchall()
    assert _rows(tuple(r) for r in df.select(columns).collect()) == _rows(want)


@pytest.mark.parametrize("name", ["paragraph_curves", "three_act_structure", "pagerank", "louvain", "components", "chapter_parse", "lda_topics"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_components_whole(spark, duck):
    nodes = duck.sql("select count(distinct o_custkey) + count(distinct o_orderkey) from orders").fetchall()[0][0]
    assert QUERIES["components"](spark, SF).count() == nodes
    signups = duck.sql("select count(distinct user_id) + count(distinct event_id) from events where event_type = 'signup'").fetchall()[0][0]
    rows = QUERIES["identity_components"](spark, SF).collect()
    accounts = [r for r in rows if r["node"] >= 1 << 40]
    assert len(rows) == signups and len({r["node"] == r["representative"] for r in accounts}) == 2  # some merged, some kept apart


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
