"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed internal names, so that further
    columns of the input can never clash with those an operator adds."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def packed(texts) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes after one another, offsets of each text and of the end)."""
    raw = [utf8(t) for t in texts]
    ends = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=ends[1:])
    return np.frombuffer(b"".join(raw), np.uint8), ends


#: Parts that the rows without an id are numbered in.
NAMELESS = 256


def row_key(rows: DataFrame) -> DataFrame:
    """``rows(id, text, ...)`` with ``occ``, which tells rows of one id apart: 0
    where ids are unique (checked on the id column alone), else numbered in
    the order of their texts; rows without an id in parts by a hash of their
    text, since they may be many.  Equal rows are alike, so any order does."""
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if again.isEmpty():
        return rows.withColumn("occ", F.lit(0))
    part = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NAMELESS))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("id", "__part").orderBy("text"))
    return rows.withColumn("__part", part).withColumn(
        "occ", F.when(F.col("id").isNull(), place * NAMELESS + F.col("__part")).otherwise(place).cast("int")).drop("__part")
