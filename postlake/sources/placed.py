"""Tables whose rows lie by their key, so that joins on it exchange only the other side.

A placed table is a folder of bucketed files for each version, and a small file that says how they were dealt, which appears
last. A session that knows the place attaches the newest version by that file: the catalog needs to know nothing from before.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from postlake.sources import files


def place_rows(df: DataFrame, root: str, key, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a placed table at ``root`` and read it.

    Rows of a key lie in one of ``buckets`` files; by default as many as the session shuffles into, as Spark deals both sides
    of a join anew where a table has fewer. Tables that are joined with each other need the same number. Rows are dealt before
    they are written, so there is a file per bucket and not one per task and bucket.
    """
    spark, key = df.sparkSession, [key] if isinstance(key, str) else list(key)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, name = f"{root}/{uuid.uuid4().hex}", f"placed_{uuid.uuid4().hex}"
    # The exchange deals by the same hash as the buckets, so every task has whole buckets.
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", folder).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an outer table: the files stay
    entry = {"folder": folder, "schema": df.schema.jsonValue(), "key": key, "buckets": buckets}
    known = _versions(spark, root)
    files.write_json(spark, f"{root}/versions/{int(known[-1].removesuffix('.json')) + 1 if known else 1:010d}.json", entry)
    return placed(spark, root)


def _versions(spark: SparkSession, root: str) -> list[str]:
    return [n for n in files.names(spark, f"{root}/versions") if n.endswith(".json") and not n.startswith(".")]


def placed(spark: SparkSession, root: str) -> DataFrame:
    """The placed table at ``root``, by any session."""
    entry = files.read_json(spark, f"{root}/versions/{_versions(spark, root)[-1]}")
    name = f"placed_{entry['folder'].rsplit('/', 1)[1]}"
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(entry["schema"]).fields)
        key = ", ".join(f"`{c}`" for c in entry["key"])
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {entry['buckets']} BUCKETS "
                  f"LOCATION '{entry['folder']}'")
    return spark.table(name)
