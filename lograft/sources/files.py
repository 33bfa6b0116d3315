"""Small files and folders of the shared file system, through Spark's own access to it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it; None if it is on a file system of another kind."""
    files, target = _at(spark, path)
    where = files.makeQualified(target).toUri()
    return where.getPath() if where.getScheme() == "file" else None


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file, and its folder."""
    files, target = _at(spark, path)
    files.create(target, True).close()


def remove(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``, sorted; none if there is no such folder."""
    files, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file; None if it is missing or was never finished."""
    files, target = _at(spark, path)
    if not files.exists(target):
        return None
    size = files.getFileStatus(target).getLen()
    stream = files.open(target)
    try:
        content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()
    return content[:-1] if content.endswith("\n") else None


def write_text(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file once; False if a finished one is there already. The last line end says that it is finished."""
    files, target = _at(spark, path)
    if read_text(spark, path) is not None:
        return False
    files.delete(target, False)  # left over from a writer that stopped half-way
    stream = files.create(target, False)
    try:
        stream.write(bytearray((content + "\n").encode()))
    finally:
        stream.close()
    return True


def move_into(spark: SparkSession, source: str, folder: str) -> None:
    """Move a file into a folder; one that has been moved before stays as it is."""
    files, target = _at(spark, source)
    into = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.mkdirs(into)
    if files.exists(target) and not files.rename(target, spark._jvm.org.apache.hadoop.fs.Path(into, target.getName())):
        raise OSError(f"cannot move {source} to {folder}")
