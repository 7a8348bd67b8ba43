"""Documents as files: discovery, digests, staging, content-addressed originals, and the dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are taken in, magic numbers of formats, and reasons of rejection.
EXTENSIONS = ("pdf", "csv", "ofx", "qfx", "qif", "sta", "mt940", "xml")
MAGIC = {"%PDF": "pdf", "<?xm": "xml", "OFXH": "ofx", "!Typ": "qif"}
REASONS = (
    "unreadable_document", "fingerprint_failed", "unknown_layout", "ambiguous_layout", "parse_failed", "parser_crashed",
    "validation_failed", "conflicting_statement", "original_missing",
)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, sha256, format and content of every document below a folder."""
    pattern = "*.{" + ",".join([*EXTENSIONS, *map(str.upper, EXTENSIONS)]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return described(found)


def described(found: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in MAGIC.items() for x in kv))
    opening = F.decode(F.substring("content", 1, 4), "ISO-8859-1")
    by_name = F.lower(F.substring_index("path", ".", -1))
    return found.withColumns({"sha256": F.sha2("content", 256), "format": F.coalesce(F.element_at(kinds, opening), by_name)})


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """The first file of each digest that is not in seen (sha256). Staging twice stages once."""
    return found.join(seen.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def put_originals(found: DataFrame, root: str) -> None:
    """Appends originals under the first two digits of their digest; those that are there stay as they are."""
    spark = found.sparkSession
    fresh = found.select("sha256", "content", F.substring("sha256", 1, 2).alias("shard"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = unseen(fresh, spark.read.parquet(root).select("sha256"))
    fresh.dropDuplicates(["sha256"]).write.mode("append").partitionBy("shard").parquet(root)


def originals(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("sha256", "content")


def dead_letters(rejected: DataFrame) -> DataFrame:
    """sha256, reason and detail as JSON of documents that contribute no rows; unknown reasons are refused."""
    reason = F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("unknown reason "), "reason")))
    return rejected.select("sha256", reason.alias("reason"), F.to_json("detail").alias("detail"))


def queue_depth(letters: DataFrame, cleared: DataFrame) -> DataFrame:
    """Documents of each reason that still wait."""
    return letters.join(cleared.select("sha256"), "sha256", "left_anti").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def model_votes(spark: SparkSession, folder: str) -> DataFrame:
    """(model, name, category) of reply files (name to category); a trailing number of a model's file supersedes lower ones."""
    lines = spark.read.option("wholetext", True).text(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    stem = F.regexp_replace("file", r"\.json$", "")
    answers = lines.select(F.regexp_replace(stem, r"-\d+$", "").alias("model"), "file", F.explode(F.from_json("value", "map<string,string>")).alias("name", "category"))
    return answers.groupBy("model", "name").agg(F.max_by("category", "file").alias("category"))


def listing(found: DataFrame, limit: int = 500) -> DataFrame:
    """The first documents by path, and in n_all how many there are in all."""
    return found.select("path", "sha256", "format", "length").orderBy("path").limit(limit).withColumn("n_all", F.lit(found.count()))
