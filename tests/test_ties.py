"""Lines of an order that share a number, against the SQL, whose ORDER BY leaves them open: on one thread DuckDB keeps the order of the files."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import SF
from test_whole import rows_of

from lattiq.plans.queries import ORACLES, QUERIES

NAME = "value_distributions"


def checked(spark, folder, lineitem):
    c = duckdb.connect(config={"threads": 1})
    for t in ("orders", "customer", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lineitem}'")
    got = c.sql(ORACLES[NAME]).to_arrow_table()
    assert rows_of(QUERIES[NAME](spark, str(folder))) == rows_of(spark.createDataFrame(got))


@pytest.fixture
def tables(tmp_path):
    for t in ("orders", "customer", "part"):
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet"), tmp_path / f"{t}.parquet")
    return tmp_path, pq.read_table(f"{SF}/lineitem.parquet")


def test_the_first_line_in_the_files_counts_whatever_order_they_are_read_in(spark, tables):
    folder, lines = tables
    lines = lines.set_column(lines.column_names.index("l_linenumber"), "l_linenumber", pa.array([1] * len(lines), pa.int32()))
    (folder / "lineitem.parquet").mkdir()
    pq.write_table(lines.slice(0, 2000), folder / "lineitem.parquet/a.parquet")
    pq.write_table(lines.slice(2000), folder / "lineitem.parquet/b.parquet")  # the larger one, which Spark reads first
    checked(spark, folder, f"{folder}/lineitem.parquet/*.parquet")


def test_the_first_line_counts_over_row_groups_and_tasks(spark, tables):
    folder, lines = tables
    order = list(range(len(lines)))
    random.Random(7).shuffle(order)
    lines = pa.concat_tables([lines, lines.take(order)]).set_column(lines.column_names.index("l_linenumber"), "l_linenumber", pa.array([i % 2 for i in range(2 * len(lines))], pa.int32()))
    pq.write_table(lines, folder / "lineitem.parquet", row_group_size=500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        checked(spark, folder, f"{folder}/lineitem.parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_without_a_number_come_last_and_no_kind_is_a_kind(spark, tables):
    folder, lines = tables
    numbers = [None if i % 3 == 0 else x for i, x in enumerate(lines["l_linenumber"].to_pylist())]
    pq.write_table(lines.set_column(lines.column_names.index("l_linenumber"), "l_linenumber", pa.array(numbers, pa.int32())), folder / "lineitem.parquet")
    part = pq.read_table(folder / "part.parquet")
    kinds = [None if i % 4 == 0 else x for i, x in enumerate(part["p_type"].to_pylist())]
    pq.write_table(part.set_column(part.column_names.index("p_type"), "p_type", pa.array(kinds, pa.string())), folder / "part.parquet")
    checked(spark, folder, f"{folder}/lineitem.parquet")
