"""Small files and folders of any file system Spark reads, from the driver."""

import json
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is no such folder."""
    place, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    place, fs = _place(spark, path)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def read_json(spark: SparkSession, path: str):
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a file that appears as a whole; FileExistsError if there is one of that name."""
    jvm, (place, fs) = spark._jvm, _place(spark, path)
    fs.mkdirs(place.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), options)
    except Exception as exc:
        fs.delete(draft, False)
        if fs.exists(place):
            raise FileExistsError(path) from exc
        raise
