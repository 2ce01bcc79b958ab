"""Tables and documents that are replaced as a whole: readers see the old one or the new one, and writers may read what they replace.

A table is a folder of versions. A new one is written beside them and appears by a rename, which the file system does at
once or not at all; a writer that dies leaves a folder that nobody reads. The last version but one stays for those who
still read it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION, STAGED = "version-", "_staged-"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions at a path, in order."""
    where, fs, _ = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[len(VERSION) :]) for n in names if n.startswith(VERSION) and n[len(VERSION) :].isdigit())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the latest version, or None."""
    known = versions(spark, path)
    return f"{path}/{VERSION}{known[-1]}" if known else None


def publish(rows: DataFrame, path: str, form: str = "json") -> int:
    """Writes rows, which may read the version that they replace, and makes them the latest; returns its number. Of two
    writers at once both appear, one after the other."""
    spark = rows.sparkSession
    _, fs, at = _hadoop(spark, path)
    staged = f"{path}/{STAGED}{uuid.uuid4().hex}"
    rows.write.format(form).save(staged)
    while True:
        known = versions(spark, path)
        number = known[-1] + 1 if known else 1
        target = at(f"{path}/{VERSION}{number}")
        # a rename onto a folder that another writer made meanwhile would move into it
        if not fs.exists(target) and fs.rename(at(staged), target):
            break
    for old in known[:-1]:
        fs.delete(at(f"{path}/{VERSION}{old}"), True)
    return number


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One indented JSON file; what was there before is replaced at once."""
    where, fs, at = _hadoop(spark, path)
    staged = at(where.getParent(), f"{STAGED}{uuid.uuid4().hex}")
    out = fs.create(staged)
    try:
        out.write(bytearray((json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode("utf-8", "surrogatepass")))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(where), overwrite)
