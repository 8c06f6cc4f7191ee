"""Dense row numbers without a task that sees all rows.

Rows are counted per partition or file, the counts are summed up to offsets, and a row's number is its offset plus its place.
What goes through one task or the driver is one count per partition or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .shared import cut

#: Spark's running ids hold the partition above this bit and the place in it below.
_PLACE_BITS = 33


def dense(df: DataFrame, order: list[Column | str], name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with ``name``: ``start``, ``start`` + 1 and so on in ``order``. Rows that ``order`` leaves tied go by all their
    columns as text, so equal tables get equal numbers; rows that are equal throughout are interchangeable.

    The sorted rows are checkpointed, so their partitions are the same whenever they are read, also after an executor is lost."""
    rest = [F.col(f"`{c}`").cast("string") if kind.startswith(("map", "variant")) is False else F.to_json(F.col(f"`{c}`")) for c, kind in df.dtypes]
    held = cut(df.orderBy(*order, *rest).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", _PLACE_BITS), F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = {r["__part"]: r["at"] for r in counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")).collect()}
    if not offsets:
        return held.drop("__id").withColumn(name, F.lit(None).cast("long"))
    # one offset a partition of the sort: looked up in an array, by number
    at = F.array(*[F.lit(int(offsets.get(p, 0))) for p in range(max(offsets) + 1)])
    return held.withColumn(name, F.element_at(at, (part + 1).cast("int")) + place + start).drop("__id")


def within(df: DataFrame, key: str, order: list[Column | str], name: str = "place", start: int = 1) -> DataFrame:
    """``df`` with each row's place among those of its ``key``, in ``order``, from ``start``. Keys are not dealt to tasks: a key
    with most of the rows is numbered by as many tasks as any other rows are."""
    rows = dense(df, [key, *order], "__seq")
    firsts = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__seq").alias("__first"))
    return rows.join(firsts, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__seq") - F.col("__first") + start).drop("__seq", "__key", "__first")


def by_file(spark: SparkSession, path: str, schema: StructType, name: str = "seq") -> DataFrame:
    """Rows of a Parquet folder with dense numbers: files by name, rows as they stand in their file. Files may be read in
    pieces. Columns of partition folders are read with the others."""
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    return rows.join(offsets, "__file").withColumn(name, F.col("__at") + F.col("__row")).drop("__file", "__row", "__at")
