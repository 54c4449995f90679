"""Directory listing and deletion on the cluster's file system (Hadoop
FileSystem API, so the same code works on HDFS, object stores and local
disks). Used for batch/version bookkeeping only; data goes through Spark."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def list_subdirs(spark: SparkSession, root: str, prefix: str, committed_only: bool = True) -> list[str]:
    """Values ``v`` of the sub-directories ``{root}/{prefix}{v}``; with
    ``committed_only``, only those holding a ``_SUCCESS`` marker."""
    fs, hpath, jvm = _fs(spark, root)
    if not fs.exists(hpath):
        return []
    out = []
    for status in fs.listStatus(hpath):
        name = status.getPath().getName()
        if not (status.isDirectory() and name.startswith(prefix)):
            continue
        if committed_only and not fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            continue
        out.append(name[len(prefix):])
    return out


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs(spark, path)
    return bool(fs.delete(hpath, True))


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in ``folder`` (none if it does not exist)."""
    fs, hpath, jvm = _fs(spark, folder)
    if not fs.exists(hpath):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hpath) if s.isFile()]


def match_paths(spark: SparkSession, pattern: str) -> list[tuple[str, float]]:
    """Paths that match a glob, with when they last changed (epoch seconds)."""
    fs, hpath, _ = _fs(spark, pattern)
    found = fs.globStatus(hpath)
    return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in found] if found else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, hpath, jvm = _fs(spark, path)
    stream = fs.open(hpath)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file under its name at once: False if there is one already."""
    folder, name = path.rsplit("/", 1)
    fs, hpath, jvm = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.getUri().getScheme() == "file":
        # Hadoop's rename on a local disk looks whether the name is free and then replaces
        # what is there: two writers may both succeed. Of two links one fails.
        def local(p):
            return jvm.java.io.File(p.toUri().getPath()).toPath()

        try:
            jvm.java.nio.file.Files.createLink(local(fs.makeQualified(hpath)), local(fs.makeQualified(draft)))
            fs.delete(draft, False)
            return True
        except Py4JJavaError:
            if fs.exists(hpath):
                fs.delete(draft, False)
                return False
            # a disk without links: renamed as elsewhere
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(hpath), options)
        return True
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if fs.exists(hpath):
            return False
        raise e
