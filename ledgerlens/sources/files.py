"""Small files and listings in the shared folder, through Spark's own file
systems (a folder may lie in any store that Spark reads)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, size) of what lies in a folder; a missing one is empty."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return [(st.getPath().getName(), st.isDirectory(), st.getLen()) for st in fs.listStatus(where)]


#: Stores that show an object only when it is whole; where they can create one
#: exclusively (S3: conditional writes), that decides between two writers.
OBJECT_STORES = ("s3", "s3a", "gs")


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file that must not be there yet, whole or not at all; False if it
    is there. The store decides between two writers: one of them gets False.
    The text is written beside it and then linked (local files) or renamed
    (HDFS and its like, where a rename never replaces a file)."""
    jvm = spark.sparkContext._jvm
    fs, where = _at(spark, path)
    scheme = fs.getUri().getScheme()
    if fs.exists(where):
        return False
    beside = where if scheme in OBJECT_STORES else jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    try:
        out = fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if scheme == "file":
            local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (where, beside)]
            jvm.java.nio.file.Files.createLink(*local)
            return True
        return beside is where or fs.rename(beside, where)
    except Exception:  # noqa: BLE001 - each store has its own class for a file that is there
        if fs.exists(where):
            return False
        raise
    finally:
        if beside is not where:
            fs.delete(beside, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def numbered_folders(spark: SparkSession, root: str, name: str, complete: bool = True) -> list[int]:
    """Numbers n of the folders ``<root>/<name>=<n>``, ascending (a listing
    by the driver); by default of those with a ``_SUCCESS`` marker."""
    out = []
    for folder, is_folder, _ in listing(spark, root):
        label, _, number = folder.partition("=")
        if is_folder and label == name and number.isdigit():
            if not complete or exists(spark, f"{root}/{folder}/_SUCCESS"):
                out.append(int(number))
    return sorted(out)
