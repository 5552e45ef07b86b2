"""Archive scans, guarded loads and result sinks."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuequarry import schemas
from issuequarry.functions.instants import run_timestamp
from issuequarry.functions.text import strip
from issuequarry.operators import maintain, normalize
from issuequarry.session import checkpointed
from issuequarry.sources.paths import exists


def resolve_archive(spark: SparkSession, path: str) -> str | None:
    """The path itself, or the path with ``.gz``; null when neither exists."""
    for candidate in (path, f"{path}.gz"):
        if exists(spark, candidate):
            return candidate
    return None


def scan_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed archive scan: blank lines are skipped, a malformed line fails the job.

    A gzip file cannot be split, so its rows are spread right after the read.
    """
    found = resolve_archive(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(found)
    return rows.repartition(spark.sparkContext.defaultParallelism) if found.endswith(".gz") else rows


def scan_ndjson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw archive lines (column ``value``), blank ones dropped, malformed ones failing the job.

    ``arrival`` orders them by file, block and line; it is taken in the scan, before a gzip file is spread.
    """
    found = resolve_archive(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    lines = spark.read.text(found).select("value", place.alias("arrival")).filter(strip(F.col("value")) != "")
    if found.endswith(".gz"):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    well_formed = F.try_parse_json("value").isNotNull()
    failed = F.raise_error(F.concat(F.lit("malformed archive line: "), F.col("value"))).cast("string")
    return lines.select(F.when(well_formed, F.col("value")).otherwise(failed).alias("value"), "arrival")


def scan_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV of id, title, body, duplicate_of; a file without those columns is refused."""
    header = spark.read.option("header", True).csv(path).columns
    missing = {f.name for f in schemas.LABELLED_PAIRS.fields} - set(header)
    if missing:
        raise ValueError(f"labelled pairs need the columns {sorted(missing)}")
    typed = T.StructType([
        next((f for f in schemas.LABELLED_PAIRS.fields if f.name == name), T.StructField(name, T.StringType()))
        for name in header
    ])
    rows = spark.read.schema(typed).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[f.name for f in schemas.LABELLED_PAIRS.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> int:
    """Write a result table and return its row count, observed during the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt).save(path)
    return seen.get["rows"]


def archive_lines(spark: SparkSession, archives: Mapping[str, str]) -> DataFrame | None:
    """Lines of several archives (flavour to path) with their flavour; a missing file is skipped with a warning."""
    scans = []
    for flavor, path in archives.items():
        if resolve_archive(spark, path) is None:
            warnings.warn(f"archive of {flavor} missing: {path}", stacklevel=2)
            continue
        scans.append(scan_ndjson_lines(spark, path).withColumn("flavor", F.lit(flavor)))
    return reduce(DataFrame.unionByName, scans) if scans else None


def load_archives(
    spark: SparkSession, archives: Mapping[str, str], issues: DataFrame, labels: DataFrame,
    run_iso: str, force: bool = False, dependants: Sequence[DataFrame] = (),
) -> tuple[DataFrame, DataFrame, int, list[DataFrame]]:
    """Load archives (flavour to path) into empty tables.

    Tables that hold issues are left alone unless ``force``, which starts from
    empty ones. Ids begin anew then, so the ``dependants`` (vectors, neighbour
    rows: tables that name issues by id) are emptied too. Returns issues,
    labels, the number of records loaded, and the dependants.
    """
    dependants = list(dependants)
    if force:
        issues, labels = issues.limit(0), labels.limit(0)
        dependants = [table.limit(0) for table in dependants]
    elif issues.limit(1).count():
        return issues, labels, 0, dependants
    lines = archive_lines(spark, archives)
    if lines is None:
        return issues, labels, 0, dependants
    run_ts = run_timestamp(run_iso)
    # Line order decides which of two records with one key is last.
    records = checkpointed(normalize.normalize_archive(lines, run_ts), "records")
    loaded = maintain.upsert_issues(issues, records.drop("labels"))
    owners = records.join(loaded.select("id", *maintain.ISSUE_KEY), maintain.ISSUE_KEY)
    batch = owners.select(F.col("id").alias("issue_id"), "labels", "source", "arrival")
    return loaded, maintain.replace_labels(labels, batch, run_ts), records.count(), dependants
