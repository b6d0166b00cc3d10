"""Session settings the jobs are written for."""

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CONFIGURED = "spark.postlake.configured"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One key may hold a third of a join's rows: split its partition, even when
    # the split costs another shuffle further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streams remember a window of postings: on disk, not in the heap, and a batch checkpoints only what it changed.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists, once for each session, and send its workers the package."""
    if spark.conf.get(_CONFIGURED, None) is None:  # a setting as well, so that every session has its own
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        spark.conf.set(_CONFIGURED, "true")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to all Python workers, wherever the driver was started from; once for an application."""
    root = Path(__file__).parent
    if spark.sparkContext.applicationId in _SHIPPED or not root.is_dir():  # or it runs from an archive already
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="postlake-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "postlake.zip"
    with zipfile.ZipFile(path, "w") as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


def local_session(cores="*", shuffle_partitions=8, memory="8g") -> SparkSession:
    """Session for tests and for the benchmark on one machine."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("postlake")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a session on this machine alone gets a folder of its own where none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = _OWN.get(spark.sparkContext.applicationId)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="postlake-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that a lost executor or a second reader costs
    no re-run. ``stored_at`` of the result names the folder; its shuffle files go with the write. ``codec`` compresses
    it in another way than the session's, as ``zstd`` for texts."""
    spark = df.sparkSession
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again
