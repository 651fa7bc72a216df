"""Sinks (K-*): every write goes through Spark's committer, so readers see all of it or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, *order: str | Column) -> None:
    """K-06, K-07, K-11: a text report in order."""
    rows.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, *order: str, compress: bool = False) -> None:
    """K-01, K-03, K-05: one record a line, sorted over the whole output by ranges."""
    rows.orderBy(*order).write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def snapshot(path: str, **tables: DataFrame) -> None:
    """K-01, K-02: a device's state, a folder for each table of natural-key records."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """K-09, D-21: only the partitions that rows has are replaced."""
    rows.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def checksum(rows: DataFrame) -> DataFrame:
    """K-05: one digest for the rows in any order."""
    return rows.select(F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"))


def publish(new: DataFrame, old: DataFrame, path: str, *order: str, least: float = 0.9) -> bool:
    """K-05, D-23: writes compressed lines unless there is too much less than before; tells whether it did."""
    from lectern.operators.quality import shrink_gate

    if not shrink_gate(old, new, least).first()["accepted"]:
        return False
    write_json(new, path, *order, compress=True)
    return True


def compacted(rows: DataFrame, path: str, files: int, without: Column | None = None) -> None:
    """K-10: rewrites into fewer files, what is private left out."""
    (rows.filter(~without) if without is not None else rows).repartition(files).write.mode("overwrite").parquet(path)


def sections(results: DataFrame, kinds: dict[str, tuple[int, str]]) -> DataFrame:
    """K-11: ranked results (query, rank, kind, label) as one text a query, in sections: kind -> (place, heading)."""
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, (p, _) in kinds.items()])
    head = F.coalesce(*[F.when(F.col("kind") == k, F.lit(h)) for k, (_, h) in kinds.items()])
    rows = results.withColumn("place", place).withColumn("head", head).filter("place IS NOT NULL")
    body = rows.groupBy("query", "place", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("body"))
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\n", "head", "body").alias("text"))))
    return body.groupBy("query").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def appended_entry(entries: DataFrame, added: DataFrame) -> DataFrame:
    """K-12: day, text: new text below what the day has."""
    return entries.withColumnRenamed("text", "old").join(added, "day", "full").select("day", F.concat_ws("\n\n", "old", "text").alias("text"))
