"""Versioned Parquet tables: a write makes a new version, readers take the last complete one.

A version counts as complete once its ``_SUCCESS`` file exists, which Spark
writes after all data, so a lost job leaves no half-written table to read.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from postlake.sources import files


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def _next_version(spark: SparkSession, root: str) -> int:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 1
    used = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path)
            if s.getPath().getName().startswith("v=")]
    return max(used, default=0) + 1


def write_snapshot(df: DataFrame, root: str, partition_by=()) -> int:
    """Write the next version and return its number; fails if another writer took it."""
    version = _next_version(df.sparkSession, root)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/v={version:010d}")
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """One version of a table, the last complete one by default; None when there is none."""
    done = _versions(spark, root)
    if not done or (version is not None and version not in done):
        if version is not None:
            raise LookupError(f"{root} has no complete version {version}")
        return None
    return spark.read.parquet(f"{root}/v={version or done[-1]:010d}")


def write_together(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write tables that belong together, as roles and runs do, as one version: a small file that names the folders of
    all appears after the last of them, or not at all. Returns its number; FileExistsError if another writer took it first."""
    known = _together(spark, root)
    number = known[-1] + 1 if known else 1
    folders = {}
    for name, df in tables.items():
        folders[name] = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folders[name]}")
    files.write_json(spark, f"{root}/together/{number:010d}.json", folders)
    return number


def read_together(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """All tables of one version, the last by default; None when there is none."""
    known = _together(spark, root)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise LookupError(f"{root} has no version {version}")
    folders = files.read_json(spark, f"{root}/together/{version or known[-1]:010d}.json")
    return {name: spark.read.parquet(f"{root}/{folder}") for name, folder in folders.items()}


def _together(spark: SparkSession, root: str) -> list[int]:
    found = [n for n in files.names(spark, f"{root}/together") if n.endswith(".json") and not n.startswith(".")]
    return [int(n.removesuffix(".json")) for n in found]


def write_role(spark: SparkSession, root: str, role: str) -> None:
    """Declare whether a data set is 'live' or a frozen 'eval' copy."""
    if role not in ("live", "eval"):
        raise ValueError(f"unknown data set role {role!r}")
    write_snapshot(spark.range(1).selectExpr(f"'{role}' AS role"), f"{root}/dataset")


def read_role(spark: SparkSession, root: str) -> str:
    """Role of a data set; a missing, empty or ambiguous marker is an error."""
    marker = read_snapshot(spark, f"{root}/dataset")
    rows = marker.limit(2).collect() if marker is not None else []
    if len(rows) != 1:
        raise PermissionError(f"{root} does not declare its role")
    return rows[0]["role"]


def require_role(spark: SparkSession, root: str, role: str) -> None:
    found = read_role(spark, root)
    if found != role:
        raise PermissionError(f"{root} is {found!r}, this job needs {role!r}")
