"""Stored tables: symbols in hash buckets, by month, with files sorted by time.

A batch writes a file a bucket and month that it has rows of, whatever the number of symbols. Ranges of time are cut by month, and
within a month by the bounds that Parquet keeps of each row group. compact() packs a partition's small files, and replace() gives
partitions new content: both write a new place, and the catalog's entry is moved to it, so a reader sees the old rows or the new ones.
Read tables by their names: folders that are no longer a partition's place keep their files until drop() is called.

Parquet enforces no keys and has no transactions: a table has one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import exists, remove, shared_dir, subfolders

#: Columns that a table is partitioned by, after its others.
KEYS = ["bucket", "open_month"]
#: Hash buckets of symbols; a table keeps its own number.
BUCKETS = 64
#: Files of a partition above which compact() packs it.
FILES = 4
#: Months that a filter names; more are told by their ends.
NAMED_MONTHS = 48


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def bucket_of(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def create(spark: SparkSession, table: str, schema: StructType, path: str | None = None, buckets: int = BUCKETS) -> None:
    """A table if there is none of that name, in the warehouse or at path."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(KEYS)}){place} TBLPROPERTIES ('tickforge.buckets' = '{buckets}')"
    )


def buckets_of(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('tickforge.buckets')").first()["value"])


def placed(rows: DataFrame, table: str) -> DataFrame:
    """rows (with symbol and open_date) as columns of the table, each in its partition."""
    spark = rows.sparkSession
    found = rows.withColumns({"bucket": bucket_of(F.col("symbol"), buckets_of(spark, table)), "open_month": month_of(F.col("open_date"))})
    return found.select(*spark.table(table).columns)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "open_time_ms", "symbol")


def append(rows: DataFrame, table: str) -> None:
    _sorted(placed(rows, table)).write.insertInto(table)


def bounds(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(month, first, last) of the rows' times: one value a month on the driver."""
    found = rows.groupBy(month_of(F.col("open_date")).alias("m")).agg(F.min("open_time_ms").alias("a"), F.max("open_time_ms").alias("z"))
    return [(r.m, r.a, r.z) for r in found.collect() if r.m is not None]


def within(stored: DataFrame, spans: list[tuple[str, int, int]]) -> DataFrame:
    """A table's rows of those spans: whole months are left out unread, then row groups by their bounds."""
    if not spans:
        return stored.where("false")
    low, high = min(a for _, a, _ in spans), max(z for _, _, z in spans)
    months = sorted({m for m, _, _ in spans})
    named = F.col("open_month").isin(months) if len(months) <= NAMED_MONTHS else F.col("open_month").between(months[0], months[-1])
    found = stored.where(named & F.col("open_time_ms").between(low, high))
    if 1 < len(months) <= NAMED_MONTHS:
        each = F.lit(False)
        for m, a, z in spans:
            each = each | ((F.col("open_month") == m) & F.col("open_time_ms").between(a, z))
        found = found.where(each)
    return found


def since(stored: DataFrame, date) -> DataFrame:
    """A table's rows from that date on."""
    return stored.where((F.col("open_month") >= F.lit(f"{date:%Y-%m}")) & (F.col("open_date") >= F.lit(date)))


def until(stored: DataFrame, date) -> DataFrame:
    """A table's rows before that date."""
    return stored.where((F.col("open_month") <= F.lit(f"{date:%Y-%m}")) & (F.col("open_date") < F.lit(date)))


def partitions(rows: DataFrame) -> list[tuple[int, str]]:
    """The partitions of placed rows, on the driver: buckets times months at most."""
    return [tuple(r) for r in rows.select(*KEYS).distinct().collect()]


def in_partitions(stored: DataFrame, keys: list[tuple[int, str]]) -> DataFrame:
    """Of a table's rows, those of the partitions."""
    chosen = F.lit(False)
    for month in sorted({m for _, m in keys}):
        chosen = chosen | ((F.col("open_month") == month) & F.col("bucket").isin([b for b, m in keys if m == month]))
    return stored.where(chosen)


def place_of(spark: SparkSession, table: str, bucket: int, month: str) -> str | None:
    """A partition's folder."""
    for r in spark.sql(f"DESCRIBE EXTENDED {table} PARTITION (bucket={bucket}, open_month='{month}')").collect():
        if r.col_name == "Location":
            return r.data_type
    return None


def replace(rows: DataFrame, table: str) -> list[str]:
    """Gives every partition that the rows (columns of the table) are in the rows as its whole content, each at once. Gives the folders
    that were left."""
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession, "partitions")
    _sorted(rows).write.partitionBy(*KEYS).parquet(folder)
    known = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    left = []
    for b in subfolders(spark, folder, "bucket="):
        for m in subfolders(spark, f"{folder}/{b}", "open_month="):
            bucket, month = int(b.partition("=")[2]), m.partition("=")[2]
            spec = f"PARTITION (bucket={bucket}, open_month='{month}')"
            if f"{b}/{m}" in known:
                left.append(place_of(spark, table, bucket, month))
                spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION '{folder}/{b}/{m}'")
            else:
                spark.sql(f"ALTER TABLE {table} ADD {spec} LOCATION '{folder}/{b}/{m}'")
    spark.catalog.refreshTable(table)
    return [p for p in left if p]


def compact(spark: SparkSession, table: str, files: int = FILES) -> list[str]:
    """Packs every partition of more than so many files into one, sorted by time. Gives the folders that were left."""
    held = spark.table(table).groupBy(*KEYS).agg(F.count_distinct(F.col("_metadata.file_path")).alias("n")).where(F.col("n") > files)
    many = partitions(held)
    return replace(in_partitions(spark.table(table), many), table) if many else []


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that are no longer a partition's place, when no reader needs them."""
    for f in folders:
        if exists(spark, f):
            remove(spark, f)
