"""Validation reports: semicolon CSV with a preamble of unknown length before the header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a report, in order; fixed values of the format.
COLUMNS = ["Focus node", "Source", "Value", "Severity", "Message", "Path", "Detail-message", "Detail-value"]
_NAMES = ["focus_node", "source", "value", "severity", "message", "path", "detail_message", "detail_value"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): the lines of each file; ``at`` puts those of a file in order.

    Files are read in ranges by many tasks: ``at`` is where a range starts and the number that its task gives the line.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.col("value").alias("line"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, preamble): report rows with object type and label, and the key/value lines before the header of each file."""
    all_lines = lines(spark, path)
    cells = F.transform(F.split("line", ";"), lambda c: F.trim(c))
    parted = all_lines.select("file", "at", "line", cells.alias("cells"))
    heads = parted.where(F.col("cells")[0] == COLUMNS[0]).groupBy("file").agg(F.min("at").alias("head"), F.min_by("cells", "at").alias("names"))
    wrong = heads.where(F.slice("names", 1, len(COLUMNS)) != F.array(*[F.lit(c) for c in COLUMNS])).first()
    if wrong is not None:
        raise ValueError(f"{wrong['file']}: the header is {';'.join(wrong['names'])}, not {';'.join(COLUMNS)}")
    heads = heads.drop("names")
    marked = parted.join(heads, "file", "left")
    preamble = marked.where("(head is null or at < head) and trim(line) <> ''").select("file", F.col("cells")[0].alias("key"), F.get("cells", F.lit(1)).alias("value"))
    body = marked.where("at > head and trim(line) <> ''").select("file", "at", F.from_csv("line", ", ".join(f"{n} string" for n in _NAMES), {"sep": ";"}).alias("r"))
    cfk = preamble.where("lower(key) in ('class', 'klasse', 'cfk')").groupBy("file").agg(F.first("value").alias("cfk"))
    detail = lambda name: F.nullif(F.trim(F.regexp_extract("detail_value", rf"{name}=([^,]*)", 1)), F.lit(""))
    rows = body.select("file", "at", *[F.trim(F.col(f"r.{n}")).alias(n) for n in _NAMES]).join(cfk, "file", "left")
    return rows.withColumn("object_type", detail("type")).withColumn("label", detail("label")), preamble


def check_set(preamble: DataFrame, required: list[str]) -> list[str]:
    """What is wrong with a set of reports: a class twice, a required class absent, more than one dataset file."""
    problems = []
    classes = preamble.where("lower(key) in ('class', 'klasse', 'cfk')")
    problems += [f"class {r['value']} has {r['count']} reports" for r in classes.groupBy("value").count().where("count > 1").collect()]
    spark = preamble.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "value string")
    problems += [f"class {r['value']} is absent" for r in wanted.join(classes.select("value"), "value", "left_anti").collect()]
    if preamble.where("lower(key) like '%rdf%file%' or lower(key) = 'dataset'").select("value").distinct().count() > 1:
        problems.append("the reports are of several dataset files")
    return problems
