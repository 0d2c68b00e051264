"""First names of registers in their three layouts, and stacked passages."""

import pytest
from pyspark.sql import functions as F

from lexitide.sources import registers, sinks


@pytest.mark.parametrize(
    "raw, name",
    [("Mary Ann", "mary"), (' "JOHN" ', "john"), ("-Tom.", "tom"), ("O'Neil,", "o'neil"), ("Zoë", "zoë"), ("Al", None), ("J0hn", None), ("", None), ('""', None), (None, None), ("'--'", None)],
)
def test_first_name(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "s string").select(registers.first_name(F.col("s"))).first()[0] == name


def test_wide_rows_are_dated_by_their_own_column(spark):
    rows = [("3-4-1650", "John", "Mary", "1-1-1720", "Anne"), (None, "Peter", "Joan", "May 1651", "Ruth"), ("1499", "Giles", None, "16", "Hugh"), ("1700", "Simon", "Jane", None, None)]
    df = spark.createDataFrame(rows, "married string, husband string, wife string, baptised string, child string")
    got = registers.wide(df, {"husband": "married", "wife": "married", "child": "baptised"}, 1500, 1700)
    assert sorted(map(tuple, got.collect())) == [("jane", 1700), ("john", 1650), ("mary", 1650), ("ruth", 1651), ("simon", 1700)]
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert registers.wide(df.limit(0), {"husband": "married"}, 1500, 1700).count() == 0


def test_lines_of_a_register(spark, tmp_path):
    path = tmp_path / "register.txt"
    path.write_text('id,place,year,raw,name\n1,York,1650,Jno,"John"\n# 2,York,1650,x,Mary\n3,York,17x0,x,Mary\n 4,York, 1651 ,x,Joan,more\n5,York,1801,x,Emma\n6,York,1650,x\n', "utf-8")
    assert sorted(map(tuple, registers.lines(spark, str(path), 1800).collect())) == [("joan", 1651), ("john", 1650)]


def test_ranked_columns_and_tally(spark):
    df = spark.createDataFrame([(1, "John (12)", "Mary (9)", "Kim (3)"), (2, "Mary Ann (7)", None, "Lee (2)"), (3, "Rare (1)", "Jo (1)", "x")], "rank int, `1750` string, `1751` string, `1950` string")
    got = registers.ranked(df, "rank", 1800, most=2)
    assert sorted(map(tuple, got.collect())) == [("john", 1750), ("mary", 1750), ("mary", 1751)]
    assert registers.ranked(df, "rank", 1700).count() == 0
    other = spark.createDataFrame([("mary", 1700)], "name string, year int")
    assert [tuple(r) for r in registers.tally({"a": got, "b": other}, 2).collect()] == [("mary", 3, 2, 1700, 1751)]


def test_stacked_files_go_on_through_the_order(spark):
    rows = [("a", i, f"t{i}") for i in range(250)] + [("b", 5, "x"), ("b", 1, "y")]
    got = {(r["key"], r["file"]): r["markdown"] for r in sinks.stacked(spark.createDataFrame(rows, "key string, at int, text string").repartition(7), "key", "at").collect()}
    assert {k: v.count("## ") for k, v in got.items()} == {("a", 0): 100, ("a", 1): 100, ("a", 2): 50, ("b", 0): 2}
    assert got["a", 1].startswith("## 100\n\nt100\n\n## 101") and got["b", 0] == "## 1\n\ny\n\n## 5\n\nx"
