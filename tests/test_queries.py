"""Every registered query on the smallest given tables, compared with its DuckDB text."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_file
from playbill.plans import catalog
from tools import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.entries()))
def test_query(spark, duck, name):
    each = catalog.entries()[name]
    status, note, _ = check.compare(spark, duck, FOLDER, name, each.run, each.sql)
    assert status in (("ok", "EMPTY") if each.sql else ("rows-only",)), note


def test_partial_duplicates_with_many_sources(spark, duck, tmp_path):
    """Few venues and days give merges of long source lists, whose order the SQL must state."""
    for name in ("part", "supplier", "nation"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    duck.execute(f"""COPY (SELECT * REPLACE (1 + l_suppkey % 4 AS l_suppkey, TIMESTAMP '2000-01-01' AS l_shipdate) FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey
      LIMIT 1500) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    own = duck.cursor()
    own.execute("CREATE SCHEMA small; SET schema = 'small'")
    for name in ("part", "supplier", "nation", "lineitem"):
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    each = catalog.entries()["partial_duplicates"]
    status, note, _ = check.compare(spark, own, str(tmp_path), "partial_duplicates", each.run, each.sql)
    assert status == "ok", note


def test_queries_without_sql():
    """All others have a DuckDB text; these two are compared with cases told by hand in ``test_operators``."""
    assert {name for name, each in catalog.entries().items() if not each.sql} == {"crawl_frontier", "discovered_venue_links"}


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
