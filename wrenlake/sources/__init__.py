"""Reading: tables with explicit schemas, file listings, the newest of several files, JSON and allow-lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDINGS = "filename string, primary_label string, secondary_labels string, collection string"
WINDOW_LABELS = "filename string, start string, end string, primary_label string"
TAXONOMY = "primary_label string, scientific_name string"
MANIFEST = "source string, source_split string, source_id string, species_name string, common_name string, supercategory string, latitude string, longitude string, duration_sec string, sample_rate string, relative_path string, sha1 string, event_start_sec string"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; columns are texts, so that numeric-looking labels stay as they are."""
    return spark.read.schema(schema).option("header", True).csv(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def audio_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Audio files at any depth: path, length, time of change and, if asked for, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ogg,wav,mp3,flac}").load(folder)
    return files if content else files.drop("content")


def newest(files: DataFrame) -> DataFrame:
    """The file that changed last."""
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations joined with their audio and category, from one metadata document; the last of equal ids counts."""
    doc = spark.read.schema("audio array<struct<id:long,file_name:string,duration:double,latitude:double,longitude:double>>, categories array<struct<id:long,name:string,common_name:string,supercategory:string>>, annotations array<struct<audio_id:long,category_id:long>>").option("multiLine", True).json(path)

    def last(column: str) -> DataFrame:
        rows = doc.select(F.posexplode(column).alias("pos", "r"))
        return rows.groupBy("r.id").agg(F.max_by("r", "pos").alias("r")).select("r.*")

    links = doc.select(F.inline("annotations"))
    return links.join(last("audio").withColumnRenamed("id", "audio_id"), "audio_id").join(last("categories").withColumnRenamed("id", "category_id"), "category_id")


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, trimmed, without empty ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def first_column(df: DataFrame, *names: str) -> str | None:
    """The first of several column names that a table has, whatever their case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)
