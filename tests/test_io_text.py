"""CSV source and sinks, text operators."""
import os

import pytest

from tessera.functions import text as TX
from tessera.sources import csv_io as IO
from tessera.session import scratch_dir


def test_csv_type_inference(spark):
    d = scratch_dir(spark, "csv").removeprefix("file:")
    os.makedirs(d)
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("a,b,c,d,e,f\n1,1.5,NA,true,2024-01-02,\n,2.5,x,False,2024-01-03,\n3,,y,true,2024-01-04,\n")
    df = IO.read_table(spark, d)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string", "f": "double"}
    rows = df.orderBy("e").collect()
    assert rows[0]["c"] is None and rows[1]["a"] is None and rows[2]["b"] is None


def test_csv_empty_file_guard(spark):
    d = scratch_dir(spark, "empty").removeprefix("file:")
    os.makedirs(d)
    open(os.path.join(d, "e.csv"), "w").close()
    with pytest.raises(Exception):
        IO.read_table(spark, d)


def test_csv_roundtrip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    path = IO.write_csv(df, scratch_dir(spark, "rt"))
    back = IO.read_table(spark, path)
    assert back.count() == df.count()
    assert back.select("c_custkey", "c_acctbal").exceptAll(df.select("c_custkey", "c_acctbal")).count() == 0


def test_code_blocks(spark):
    replies = spark.createDataFrame([
        (1, "Here:\n```python\nprint(1)\n```\nbye"),
        (2, "```python\na = 1\n```\nand\n```python\nb = 2\n```"),
        (3, "no code at all"),
        (4, "```python\nunclosed"),
    ], "id long, text string")
    out = {r["id"]: (r["code"], r["code_all"]) for r in
           TX.extract_code_blocks(replies, "text", all_blocks=True).collect()}
    assert out[1][0] == "print(1)"
    assert out[2][0] == "a = 1" and out[2][1] == ["a = 1", "b = 2"]
    assert out[3][0] == "" and out[4][0] == ""


def test_chat_context_positions(spark):
    conv = spark.createDataFrame([(1, 5, "user", "q1"), (1, 6, "assistant", "a1"), (1, 7, "user", "q2"),
                                  (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = TX.chat_context(conv, system_prompt="sys").orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.role) for r in out] == [
        (1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"), (2, 0, "system"), (2, 1, "user")]


def test_csv_explicit_schema_and_writers(spark):
    d = scratch_dir(spark, "csv-schema").removeprefix("file:")
    os.makedirs(d)
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    df = IO.read_table(spark, d, schema="a int, b string")
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.count() == 2
    lb = spark.createDataFrame([("rf", 0.9), ("lr", 0.8)], "model string, accuracy double")
    p1 = IO.write_leaderboard(lb, scratch_dir(spark, "lb"))
    p2 = IO.write_chart_data(df.where("a > 1"), scratch_dir(spark, "chart"))
    back = IO.read_table(spark, p1)
    assert dict(back.dtypes) == {"model": "string", "accuracy": "double"}
    assert {r.model: r.accuracy for r in back.collect()} == {"rf": 0.9, "lr": 0.8}
    assert IO.read_table(spark, p2).count() == 1
