"""Tables that are replaced by moving a pointer.

Each write fills a folder of its own; then one small manifest that names it is
put beside the earlier ones under the next number.  Readers take the newest
manifest, so they see a whole run: the one before until the new one is
complete, also when its writer dies on the way.  Two writers never take the
same number: the second one fails.  The folders of the newest `keep` manifests
stay, so a reader that has begun is not disturbed by the next write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from newsloom.session import remove_path

_FOLDER = "_pointer"
_DIGITS = 12


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests, oldest first; the folder holds a few."""
    fs, folder = _files(spark, f"{path}/{_FOLDER}")
    if not fs.exists(folder):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if len(n) == _DIGITS + 5 and n.endswith(".json"))


def _manifest(path: str, number: int) -> str:
    return f"{path}/{_FOLDER}/{number:0{_DIGITS}d}.json"


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """A manifest, the newest by default; None if there is none."""
    known = manifests(spark, path)
    if not known:
        return None
    fs, target = _files(spark, _manifest(path, known[-1] if number is None else number))
    stream = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def point_to(spark: SparkSession, path: str, folder: str, **facts) -> int:
    """Make a folder under `path` the present one; returns the manifest's number."""
    known = manifests(spark, path)
    number = known[-1] + 1 if known else 0
    fs, draft = _files(spark, f"{path}/{_FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps({"folder": folder, **facts}).encode()))
    finally:
        out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(_manifest(path, number))
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"another writer has published {path} as number {number}")
    return number


def forget(spark: SparkSession, path: str, number: int) -> None:
    """Remove a manifest; what it names stays."""
    remove_path(spark, _manifest(path, number))


def drop_before(spark: SparkSession, path: str, keep: int) -> None:
    """Remove the manifests before the newest `keep`, and their folders; the manifest goes first."""
    for number in manifests(spark, path)[:-keep]:
        folder = read_manifest(spark, path, number)["folder"]
        forget(spark, path, number)
        remove_path(spark, f"{path}/{folder}")


def replace_table(df: DataFrame, path: str, keep: int = 2, **facts) -> None:
    """Write a table and point to it once it is whole."""
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    point_to(spark, path, folder, **facts)
    drop_before(spark, path, keep)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The table that the newest manifest names; without one, empty if a schema is given."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        if schema is None:
            raise FileNotFoundError(f"nothing is published at {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{manifest['folder']}")
