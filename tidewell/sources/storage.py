"""Small files on whatever file system a path names, by Hadoop's client: local, HDFS or an object store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _open(spark, path)
    return system.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, system = _open(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    target, system = _open(spark, path)
    return system.getContentSummary(target).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _open(spark, path)
    stream = system.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there, so that readers see the old text or the new one."""
    target, system = _open(spark, path)
    new, _ = _open(spark, f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex[:8]}")
    stream = system.create(new, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, options)
