"""Sources and sinks: JSON records, taxonomy CSV, Parquet, CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROGRAMME = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "institution", "url", "brief_description", "extended_description", "language", "city", "field", "level", "scraped_at")])
JOB = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "company", "location", "url", "description", "source", "posting_date", "scraped_at")] + [T.StructField("required_skills", T.ArrayType(T.StringType()))])
TAXONOMY = T.StructType([T.StructField(c, T.StringType()) for c in ("conceptUri", "skillType", "reuseLevel", "preferredLabel", "altLabels", "hiddenLabels", "status", "modifiedDate", "scopeNote", "definition", "inScheme", "description", "code")])


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records of a schema; a missing path is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_taxonomy(raw: DataFrame) -> DataFrame:
    """pos, uri, preferred_label, alt_labels, skill_type, reuse_level,
    description from the CSV's columns; rows without uri or label go."""
    first = raw.columns[0]
    raw = raw.withColumnRenamed(first, first.lstrip("\ufeff"))
    alts = F.filter(F.transform(F.split(F.coalesce("altLabels", F.lit("")), "\\n|\\\\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != F.trim("preferredLabel")))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = raw.withColumn("pos", F.monotonically_increasing_id()).where(blank("conceptUri").isNotNull() & blank("preferredLabel").isNotNull())
    return rows.select("pos", F.trim("conceptUri").alias("uri"), F.trim("preferredLabel").alias("preferred_label"), alts.alias("alt_labels"), F.col("skillType").alias("skill_type"), F.col("reuseLevel").alias("reuse_level"), F.coalesce(blank("description"), blank("definition")).alias("description"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return parse_taxonomy(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def write_export(df: DataFrame, path: str) -> None:
    """One timestamped folder; the caller keeps the pointer to the latest."""
    df.write.mode("overwrite").option("header", True).csv(path)


def match_targets(options: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """Options that hold a target, or all of them if none does."""
    low = F.lower(F.col(column))
    hit = F.exists(F.array(*(F.lit(t.lower()) for t in targets)), lambda t: F.contains(low, t)) if targets else F.lit(False)
    found = options.where(hit)
    return options if found.isEmpty() else found


def enrich(programmes: DataFrame, details: DataFrame) -> DataFrame:
    """Extended descriptions from ``details`` (url, extended_description) where given."""
    new = details.select("url", F.col("extended_description").alias("__new"))
    return programmes.join(new, "url", "left").withColumn("extended_description", F.coalesce("__new", "extended_description")).drop("__new")


def table_rows(html: Column) -> Column:
    """Cells of each table row, tags stripped."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", " "))))
