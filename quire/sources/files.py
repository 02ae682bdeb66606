"""Sources and sinks of a corpus: scans of folders, split text layers, JSON exports with a checksum, keyed sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_folder(path: str) -> str:
    """A folder of the file system; other schemes are refused for what only works on files."""
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:", path):
        raise ValueError(f"{path} is no local folder")
    return path


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """name, size, modified and checksum of the files, without driver-side listing of their contents."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(local_folder(folder))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum"))


def scan_changed(spark: SparkSession, folder: str, known: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """As `scan`, but only files that are not known (name, size, modified, checksum) with this size and time are read and hashed; the others keep their checksum."""
    path = F.element_at(F.split("path", "/"), -1).alias("name")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(local_folder(folder)).select(path, F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    old = known.select("name", "size", "modified", F.col("checksum").alias("_checksum"))
    seen = listed.join(old, ["name", "size", "modified"], "left")
    fresh = [r["path"] for r in seen.where(F.col("_checksum").isNull()).select("path").collect()]  # paths of new files alone, which Spark's reader takes from the driver
    kept = seen.where(F.col("_checksum").isNotNull()).select("name", "size", "modified", F.col("_checksum").alias("checksum"))
    if not fresh:
        return kept
    read = spark.read.format("binaryFile").load(fresh)
    return kept.unionByName(read.select(path, F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum")))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """Case does not matter, and numbers sort as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return df.orderBy(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(p)), name)


def split_pages(texts: DataFrame, key: str, text: str, expected: str | None = None) -> DataFrame:
    """One row a page of form-feed separated text; an empty tail is no page. expected: a column with the number of pages, asserted."""
    parts = F.split(F.regexp_replace(text, "\\f$", ""), "\\f")
    if expected is not None:
        parts = F.when(F.assert_true(F.size(parts) == F.col(expected), F.lit("the number of pages differs")).isNull(), parts)
    return texts.select(key, F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_export(spark: SparkSession, folder: str, datasets: dict[str, StructType]) -> dict[str, DataFrame]:
    """The JSON arrays of an export, each with its schema."""
    return {n: spark.read.schema(s).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/{n}.json") for n, s in datasets.items()}


def export_checksum(spark: SparkSession, folder: str, order: list[str]) -> str:
    """SHA-256 over the files' bytes in a fixed order (an export is small)."""
    f = spark.read.format("binaryFile").load([f"{folder}/{n}.json" for n in order])
    rank = F.array_position(F.array(*(F.lit(f"{n}.json") for n in order)), F.element_at(F.split("path", "/"), -1))
    parts = f.select(F.struct(rank.alias("rank"), F.hex("content").alias("h")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("all"))
    return parts.select(F.sha2(F.unhex(F.concat_ws("", F.transform("all", lambda x: x["h"]))), 256)).first()[0]


def count_mismatches(counts: dict[str, int], manifest: dict[str, int]) -> dict[str, tuple[int | None, int | None]]:
    """Datasets whose count is another than the manifest's: (found, promised)."""
    return {n: (counts.get(n), manifest.get(n)) for n in sorted({*counts, *manifest}) if counts.get(n) != manifest.get(n)}


def replace_groups(df: DataFrame, path: str, group: str) -> None:
    """Writes whole groups over their former rows; other groups stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(old: DataFrame, new: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """Keyed upsert: new rows win; `label` is kept from the old row where it has one."""
    n = new
    if label is not None:
        o = old.select(*keys, F.col(label).alias("_label"))
        n = new.join(o, keys, "left").withColumn(label, F.coalesce("_label", label)).drop("_label").select(*new.columns)
    return n.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def with_books(books: DataFrame, chunks: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """Books that are not missing and have chunks, some or all, by year."""
    b = books.where("status <> 'missing'").join(chunks.select("book"), "book", "left_semi")
    if slugs:
        b = b.where(F.col("slug").isin(slugs))
    return b.orderBy(F.col("year").asc_nulls_last(), "book")
