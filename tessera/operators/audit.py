"""History of records: changes appended field by field, the time each value held, and the state at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE = "id string, field string, old string, new string, at timestamp, by string"


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str], at: Column, by: Column) -> DataFrame:
    """(id, field, old, new, at, by): a row for each field whose value differs between two states of a record.

    Both states are unpivoted and joined by record and field, so a record that is new or gone has a change for each
    field that is not null. Values are compared as text. One row per key in each state.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias(name)) for c in columns]))
        return df.select(F.col(f"`{key}`").cast("string").alias("id"), cells.alias("x")).select("id", "x.*").where(F.col(name).isNotNull())

    both = long(before, "old").join(long(after, "new"), ["id", "field"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("id", "field", "old", "new", at.alias("at"), by.alias("by"))


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Appends changes as the folder of a batch; a batch that is run again replaces its own folder and nothing else."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def log(spark, path: str) -> DataFrame:
    """All changes appended so far, with their batch."""
    return spark.read.schema(f"{CHANGE}, batch long").parquet(path)


def intervals(rows: DataFrame) -> DataFrame:
    """(id, field, value, since, until): the time each value held, until excluded and null while it holds.

    Of several changes of a field at one time the last by batch, then by value, counts.
    """
    order = [F.desc(c) for c in (["batch"] if "batch" in rows.columns else [])] + [F.desc_nulls_last("new")]
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id", "field", "at").orderBy(*order))).where("_n = 1")
    until = F.lead("at").over(Window.partitionBy("id", "field").orderBy("at"))
    return last.select("id", "field", F.col("new").alias("value"), F.col("at").alias("since"), until.alias("until"))


def state_at(held: DataFrame, when: Column, fields: list[str]) -> DataFrame:
    """The records as they were at a time: id and a column for each field, null where it had none; no row before a record's first change."""
    then = held.where((F.col("since") <= when) & (F.col("until").isNull() | (F.col("until") > when)))
    return then.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def as_of_join(rows: DataFrame, held: DataFrame, key: str, ts: str, field: str) -> DataFrame:
    """Adds ``field``: its value for each row's record at the row's time, null if it had none.

    Rows and changes are laid in one order by record and time and the last value before is carried on, so that a record
    with many rows and many changes is one sorted pass instead of a join of all with all. Records are split by range
    only at their own borders; one whose changes and rows exceed a task's memory spills.
    """
    packed = rows.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{ts}`").alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.lit(None).cast("struct<value:string>").alias("held"))
    of = held.where(F.col("field") == field).select("id", F.col("since").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(packed.schema["row"].dataType).alias("row"), F.struct("value").alias("held"))
    # Side 0 sorts first: a change at the row's own time counts.
    before = Window.partitionBy("id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = packed.unionByName(of).withColumn("now", F.last("held", ignorenulls=True).over(before)).where("side = 1")
    return carried.select("row.*", F.col("now.value").alias(field))
