"""Readers and writers for change-record files, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.sources.texts import write_texts  # noqa: F401  (a sink of these records)

PROJECT = r"([^/]+/[^/]+)/[^/]+$"


def read_json(spark: SparkSession, folder: str, schema: str, name: str = "*.json", project: bool = False) -> DataFrame:
    """All files called ``name`` below ``folder`` as rows; ``project`` adds the two folders above the file.

    Raises if there is no row, so that a wrong path is not an empty answer."""
    frame = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    if project:
        frame = frame.withColumn("project", F.regexp_extract(F.col("_metadata.file_path"), PROJECT, 1))
    if frame.isEmpty():
        raise ValueError(f"no {name} with records below {folder}")
    return frame


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return read_json(spark, folder, schemas.REPAIR, "dataset.json", project=True)


def read_change_sets(spark: SparkSession, folder: str, name: str = "sut_class_changes.json") -> DataFrame:
    """Change sets of the projects that have exactly one such file."""
    frame = spark.read.schema(schemas.CHANGE_SET).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    frame = frame.withColumns({"file": F.col("_metadata.file_path"), "project": F.regexp_extract(F.col("_metadata.file_path"), PROJECT, 1)})
    single = frame.groupBy("project").agg(F.countDistinct("file").alias("n")).where("n = 1").select("project")
    return frame.join(single, "project", "left_semi").drop("file")


def read_nested_map(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """A JSON object of objects as rows: one column for each level of keys, then ``value``."""
    frame = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))
    names: list[str] = []
    for key in keys:
        frame = frame.select(*names, F.explode("value").alias(key, "value"))
        names.append(key)
    return frame


def read_call_graphs(spark: SparkSession, folder: str, name: str = "call_graphs.json") -> DataFrame:
    """``project, commit, test, value`` of the projects that have exactly one such file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    files = text.withColumns({"file": F.col("_metadata.file_path"), "project": F.regexp_extract(F.col("_metadata.file_path"), PROJECT, 1)})
    single = files.groupBy("project").agg(F.count("*").alias("n"), F.first("value").alias("value")).where("n = 1")
    commits = single.select("project", F.explode(F.from_json("value", schemas.CALL_GRAPHS)).alias("commit", "tests"))
    return commits.select("project", "commit", F.explode("tests").alias("test", "value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``path, code, command, java_home, log`` of whole log files: three head lines, then the log."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n", 4).alias("p"))
    part = lambda i: F.get("p", F.lit(i))
    return text.select("path", part(0).try_cast("int").alias("code"), part(1).alias("command"), F.regexp_replace(part(2), "^JAVA_HOME=", "").alias("java_home"), part(3).alias("log"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTIONS).option("multiLine", True).json(path)


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """``commit, refactoringType, originalName, newName`` of a JSON object of lists by commit."""
    return read_nested_map(spark, path, schemas.RENAMES, ("commit",)).select("commit", F.inline("value"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``commit, test, element``: the distinct types and executables that a test refers to."""
    rows = read_nested_map(spark, path, schemas.ELEMENTS, ("commit", "test"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("value.types", none), F.coalesce("value.executables", none))
    return rows.select("commit", "test", F.explode(both).alias("element"))


def read_verdicts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all verdict files and one row ``n_files, n_empty``; a file of zero bytes brings no row and is counted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    total = len(files.inputFiles())  # the reader itself passes over files of zero bytes
    counts = files.agg(F.lit(total).cast("long").alias("n_files"), (F.lit(total) - F.count("*")).alias("n_empty"))
    rows = spark.read.schema(schemas.VERDICTS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows, counts


def write_json(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    frame.write.mode("overwrite" if overwrite else "ignore").json(path)


def write_csv(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    frame.write.mode("overwrite" if overwrite else "ignore").option("header", True).option("escape", '"').csv(path)


def write_array(frame: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """One pretty JSON array in a file called ``path``, for small results that people read; refuses more than ``rows``."""
    spark = frame.sparkSession
    texts = [r[0] for r in frame.select(F.to_json(F.struct("*"), {"pretty": "true"})).limit(rows + 1).toLocalIterator()]
    if len(texts) > rows:
        raise ValueError(f"more than {rows} rows for one file")
    _write_text(spark, path, "[" + ",\n".join(texts) + "]\n")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def annotate(frame: DataFrame, path: str, version: str) -> DataFrame:
    """``frame`` as a new version beside the table it was read from, never over it; read back."""
    target = f"{path.rstrip('/')}-{version}"
    frame.write.mode("errorifexists").parquet(target)
    return frame.sparkSession.read.parquet(target)


def stage(frame_of, spark: SparkSession, path: str) -> DataFrame:
    """A stage's table: computed and written if ``path`` does not exist, read otherwise."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        frame_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_verdicts(verdicts: DataFrame, n: int) -> DataFrame:
    """Expected indexes 0..n-1 without a verdict (``id`` as text of the index)."""
    have = verdicts.select(F.col("id").cast("long").alias("ind")).distinct()
    return verdicts.sparkSession.range(n).withColumnRenamed("id", "ind").join(have, "ind", "left_anti")
