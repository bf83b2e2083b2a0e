"""The registered queries against their SQL on the smallest tables."""
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from noticeflow.plans.spread import spread
from noticeflow.queries import load, table

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
#: Streams and searches of over ten seconds each; ``tools/check_queries.py`` runs them too.
SLOW = ("activity_states_stream", "bucketed_merge", "delivered_once", "duplicates_one_side", "event_duplicates", "indexed_duplicates",
        "late_items_stream", "masked_stream", "polled_stream", "quotes_stream", "shared_default_list", "sleeping_sessions_stream",
        "strong_masking", "submit_path")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(load()[1]) - set(SLOW)))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_work_on_small_files_is_spread_over_the_cores(spark):
    """F18 to F28 (F24 ends in a grouping): a file of one row group was one task, whatever its rows ask for."""
    cores = spark.sparkContext.defaultParallelism
    for name in ("overlap_choice", "rule_roster", "response_scope", "response_warnings", "restored_items", "row_validation",
                 "rule_mobile", "token_assignment", "rule_name_before_contact", "rule_explicit_number"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores, name


def test_a_file_of_one_row_group_is_spread_although_it_is_cut_by_bytes(spark):
    """F19 to F27: a larger file came in as many tasks as there are cores, and one of these had all rows."""
    cores, bytes_a_task = spark.sparkContext.defaultParallelism, "spark.sql.files.maxPartitionBytes"
    spark.conf.set(bytes_a_task, "256")
    try:
        rows = table(spark, "/root/testdata/sf0.001", "customer")
        assert rows.rdd.getNumPartitions() >= cores
        dealt = spread(rows).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= cores and sum(r["count"] for r in dealt) == rows.count()
        run = entry.queries()["rule_roster"](spark, "/root/testdata/sf0.001")
        assert run.groupBy(F.spark_partition_id()).count().count() >= cores
    finally:
        spark.conf.unset(bytes_a_task)
