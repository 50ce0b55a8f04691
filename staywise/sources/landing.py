"""Landing raw files and unpacking archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.session import ship_code


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def path_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below ``path`` and the time of its last change, as the file system tells them."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(hadoop_path).getLength(), system.getFileStatus(hadoop_path).getModificationTime()


def land_once(spark: SparkSession, source: str, target: str) -> bool:
    """Copy ``source`` to ``target`` as it is, unless the target exists. True when copied."""
    if path_exists(spark, target):
        return False
    if not path_exists(spark, source):
        raise FileNotFoundError(f"no such source: {source}")
    configuration = spark._jsc.hadoopConfiguration()
    hadoop = spark._jvm.org.apache.hadoop.fs
    src, dst = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(
        src.getFileSystem(configuration), src, dst.getFileSystem(configuration), dst, False, configuration
    )
    return True


def _member_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as unpacked:
                for member in unpacked.infolist():
                    if member.is_dir():
                        continue
                    with unpacked.open(member) as handle:
                        reader = io.TextIOWrapper(handle, encoding="utf-8", newline="\n")
                        number = 0
                        while lines := reader.readlines(1 << 20):
                            yield pd.DataFrame(
                                {
                                    "archive": archive,
                                    "member": member.filename,
                                    "number": range(number, number + len(lines)),
                                    "line": [line.rstrip("\r\n") for line in lines],
                                }
                            )
                            number += len(lines)


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every member of the zip files at ``path``; one task per archive."""
    ship_code(spark)
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInPandas(_member_lines, "archive string, member string, number bigint, line string")


def extract_zip(spark: SparkSession, path: str, target: str) -> bool:
    """Write the members of zip files below ``target/archive=<file>/member=<path>``; other names are left alone.

    Members keep their whole path (``/`` is escaped by the writer) and their order of lines.
    """
    if not path.endswith(".zip"):
        return False
    lines = zip_lines(spark, path).withColumn("archive", F.element_at(F.split("archive", "/"), -1))
    ordered = lines.repartition("archive", "member").sortWithinPartitions("archive", "member", "number")
    ordered.drop("number").write.mode("errorifexists").partitionBy("archive", "member").text(target)
    return True
