"""Tables of a relational database, read in parallel by ranges of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 32, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table, or a query in brackets with a name, of a database.

    With a numeric, date or timestamp partition column the table is read in ranges between its least and greatest value,
    asked for first; rows whose column is null come with the first range. Without one a single task reads everything: right
    for small tables only. Filters and columns are pushed into the database. An empty table is read by one task."""
    held = {"url": url, "fetchsize": str(fetch), "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true", **options}
    plain = spark.read.format("jdbc").options(**held)
    if partition_column is None:
        return plain.option("dbtable", table).load()
    whole = spark.read.format("jdbc").options(**held, dbtable=table)
    name = next((c for c in whole.load().columns if c.lower() == partition_column.lower()), partition_column)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)
    low, high = plain.option("query", f"SELECT MIN({quoted}) AS LO, MAX({quoted}) AS HI FROM {table}").load().first()
    if low is None:
        return whole.load()
    return whole.options(partitionColumn=name, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()
