"""Values of a report that its order leaves open come in the order of the table."""

import duckdb
import pytest

from assayflow.plans.queries import ORACLES, QUERIES
from test_queries import plain


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two parts of one name with differing sizes, in the same line of an order with the same quantity: once the one first, once the other."""
    d, con = tmp_path_factory.mktemp("ties"), duckdb.connect()
    con.execute("create table part as select * from (values (1, 'red bolt', 'T', 'B', 40), (2, 'red bolt', 'T', 'B', 4), (3, 'red bolt', 'T', 'B', 30)) t(p_partkey, p_name, p_type, p_brand, p_size)")
    con.execute("create table lineitem as select o::bigint as l_orderkey, 1 as l_linenumber, p::bigint as l_partkey, 10.0::double as l_quantity from (values (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 1), (3, 3), (3, 1), (3, 2)) t(o, p)")
    for t in ("part", "lineitem"):
        con.execute(f"copy {t} to '{d}/{t}.parquet' (format parquet)")
    return str(d), con


def test_report_has_the_rows_of_its_sql(spark, tables):
    d, con = tables
    other = con.execute(ORACLES["rule_based_report"])
    columns = [c[0] for c in other.description]
    own = [tuple(plain(r[c]) for c in columns) for r in QUERIES["rule_based_report"](spark, d).select(*columns).collect()]
    assert sorted(own) == sorted(tuple(map(plain, r)) for r in other.fetchall())


def test_questions_come_in_the_order_of_the_table(spark, tables):
    found = {r["doc_id"]: r["questions"] for r in QUERIES["build_questions"](spark, tables[0]).collect()}
    assert {k: ["low" if "my low" in v[0] else "high", len(v)] for k, v in found.items()} == {1: ["low", 5], 2: ["high", 5], 3: ["low", 5]}
