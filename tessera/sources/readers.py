"""Readers of the file formats that the engine's programs take in, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.push import PushSource

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
PAIRS = "user_id string, business_id string"
ITEM_MODEL, USER_MODEL = "b1 string, b2 string, sim double", "u1 string, u2 string, sim double"
TAGGED = "hashtags array<struct<text: string>>, posted_at timestamp"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, decoded once; lines that aren't JSON and missing fields give nulls."""
    return spark.read.schema(schema).json(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, REVIEW)


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, BUSINESS)


def csv_rows(spark: SparkSession, path: str, schema: str = PAIRS, header: bool = True) -> DataFrame:
    """Comma-separated rows; the header is skipped in every file, not only in the first."""
    return spark.read.schema(schema).option("header", header).csv(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the first token of each line, and the empty word."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("word"))
    return lines.unionByName(spark.createDataFrame([("",)], "word string")).distinct()


def points(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) from lines ``id,f1,...,fd`` without a header."""
    parts = F.split("value", ",")
    return spark.read.text(path).filter(F.length("value") > 0).select(parts[0].alias("id"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("features"))


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in any file system Spark reads."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(s.getPath().toString()) for s in path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path) or [])


def point_chunks(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The chunks ``data0.txt``, ``data1.txt``, ... of a folder, in order; none is read before it is used."""
    number = lambda path: int("".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit()) or 0)
    return [points(spark, path) for path in sorted(files(spark, f"{folder}/data*.txt"), key=number)]


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) from lines that hold a JSON object id -> label each."""
    parsed = spark.read.text(path).select(F.from_json("value", T.MapType(T.StringType(), T.IntegerType())).alias("m"))
    return parsed.select(F.explode("m").alias("id", "label"))


def model(spark: SparkSession, path: str, schema: str = ITEM_MODEL) -> DataFrame:
    """A similarity model, written as JSON lines or as Parquet."""
    return spark.read.parquet(path) if files(spark, f"{path}/*.parquet") else json_lines(spark, path, schema)


def profile_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(business_id, word) and (user_id, word, weight) from a file of two JSON lines: businesses -> words, users -> word weights.

    Which line is which shows in what the first name stands for, a list or an object; the order of lines doesn't matter.
    """
    lines = spark.read.text(path)
    lists = F.col("value").rlike(r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[')
    parsed = lambda df, kind: df.select(F.explode(F.from_json("value", kind)).alias("k", "v"))
    of_business = parsed(lines.filter(lists), "map<string, array<string>>").select(F.col("k").alias("business_id"), F.explode("v").alias("word"))
    of_user = parsed(lines.filter(~lists), "map<string, map<string, double>>").select(F.col("k").alias("user_id"), F.explode("v").alias("word", "weight"))
    return of_business, of_user


def socket_json(spark: SparkSession, port: int, schema: str, host: str = "localhost") -> DataFrame:
    """A stream of JSON lines from a TCP socket, with ``seen_at``, the time each was read."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return lines.select(F.from_json("value", T.StructType.fromDDL(schema)).alias("r"), F.col("timestamp").alias("seen_at")).select("r.*", "seen_at")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of the files that appear in a folder, ``per_trigger`` at a time: what a push source is replayed from."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def push_stream(spark: SparkSession, messages: str, schema: str, per_second: float = 100.0) -> DataFrame:
    """A stream of messages that are pushed at a steady rate, whether or not they are asked for.

    There is no network service to listen to, so the messages are the JSON lines of a file, sent in
    order, ``per_second`` of them from the time the stream first starts. Offsets are line numbers, so a
    restarted stream goes on where it was.
    """
    spark.dataSource.register(PushSource)
    return spark.readStream.format("pushed").schema(schema).options(messages=messages, per_second=per_second).load()
