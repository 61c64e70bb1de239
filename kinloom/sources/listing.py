"""Listings of folders and of addresses in an object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind, sub_album
from ..operators.blocks import numbered


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, size, sub_album) of every file below a folder, empty ones too; paths start at the folder, contents are not read.

    One listing by the file system's own recursive call, on the driver: rows are made as it
    goes, in blocks that become partitions."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    found, walk = [], system.listFiles(root, True)
    while walk.hasNext():
        status = walk.next()
        found.append((status.getPath().toUri().getPath().removeprefix(base), status.getLen()))
    files = spark.createDataFrame(sorted(found), "path string, size long")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_kind(name).alias("kind"), "size", sub_album(F.col("path")).alias("sub_album"))


def manifest(files: DataFrame) -> DataFrame:
    """Images numbered by the order of their path, part by part."""
    images = numbered(files.where("kind = 'image'"), [F.split("path", "/")], "place")
    return images.withColumn("photo_id", F.lpad(F.col("place").cast("string"), 6, "0")).drop("place")


def scan_stats(files: DataFrame) -> DataFrame:
    """One row: files by kind and bytes in all."""
    return files.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("image", "raw", "video", "other")], F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def album_counts(files: DataFrame) -> DataFrame:
    return files.where("kind = 'image'").groupBy(F.when(F.col("sub_album") == "", "(root)").otherwise(F.col("sub_album")).alias("album")).agg(F.count("*").alias("n"))


def children(keys: DataFrame, prefix: str, key_col: str = "key") -> DataFrame:
    """Names directly below a prefix that ends in /; unfinished parts (.partial) are hidden."""
    rest = F.substring(F.col(key_col), len(prefix) + 1, 1 << 20)
    return keys.where(F.col(key_col).startswith(prefix) & ~F.col(key_col).endswith(".partial")).select(F.substring_index(rest, "/", 1).alias("name")).where("name <> ''").distinct()
