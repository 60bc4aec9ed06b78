"""Sinks: snapshots, an object per book, and appended results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.texts import clean


def write_snapshot(df: DataFrame, path: str) -> None:
    """A table's next snapshot, written beside the old one, which it then replaces: ``df`` may read from ``path``."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new, gone = (hadoop.Path(path.rstrip("/") + suffix) for suffix in ("", ".next", ".previous"))
    df.write.mode("overwrite").parquet(new.toString())
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    if fs.exists(old):
        fs.rename(old, gone)
    if not fs.rename(new, old):
        fs.rename(gone, old)
        raise OSError(f"the snapshot {path} could not be replaced")
    fs.delete(gone, True)
    spark.catalog.refreshByPath(path)


def description_json(desc: DataFrame, subjects: DataFrame) -> DataFrame:
    """bookid and one JSON object: title, author, summary, subjects in order, category."""
    s = subjects.groupBy("bookid").agg(F.array_sort(F.collect_set("name")).alias("subjects"))
    d = desc.join(s, "bookid", "left")
    body = F.struct("bookid", "source_title", "source_author", "summary", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), "category")
    return d.select("bookid", F.to_json(body).alias("value"))


def id_map_json(books: DataFrame) -> DataFrame:
    """One JSON object per shard of the id map (external id: internal id); shards keep objects bounded."""
    shard = F.pmod(F.xxhash64("gutenbergbookid"), F.lit(64)).cast("int").alias("shard")
    m = books.where("gutenbergbookid is not null").groupBy(shard).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("gutenbergbookid").cast("string"), F.col("id"))))).alias("m"))
    return m.select("shard", F.to_json("m").alias("value"))


def content_objects(contents: DataFrame) -> DataFrame:
    """bookid, extension and body: markup as it is, text cleaned anew from the raw one."""
    html: Column = F.col("content_type") == "html"
    return contents.select("bookid", F.when(html, "html").otherwise("txt").alias("extension"), F.when(html, F.coalesce("html_content", "clean_content")).otherwise(clean(F.coalesce("raw_content", "clean_content"))).alias("body"))


def write_objects(objects: DataFrame, path: str) -> None:
    """One folder per extension and shard, a JSON line per book."""
    objects.withColumn("shard", F.pmod(F.xxhash64("bookid"), F.lit(256))).repartition("shard").write.mode("overwrite").partitionBy("extension", "shard").json(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)
