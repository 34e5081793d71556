"""State tables without a table format: each write is a new version folder, readers take the newest complete one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Versions that stay: readers of an older one have that long to finish.
KEEP = 10


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path or a file URI."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Folders and files below ``root`` by pattern, sorted."""
    fs, path = file_system(spark, root)
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, pattern)) or []
    return sorted(s.getPath().toString() for s in found)


def committed(spark: SparkSession, root: str, key: str) -> dict[int, str]:
    """Number and folder of every ``key=<number>`` whose write has finished: only those carry the marker of the committer."""
    found = [p.rsplit("/", 1)[0] for p in listed(spark, root, f"{key}=*/_SUCCESS")]
    return dict(sorted((int(p.rsplit("=", 1)[1]), p) for p in found))


def drop(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _folders(spark: SparkSession, root: str) -> list[str]:
    return list(committed(spark, root, "v").values())


def latest(spark: SparkSession, root: str, schema: T.StructType | str, back: int = 0) -> DataFrame:
    """The newest version, or an older one (``back`` = 1 is the one before); empty when there is none."""
    folders = _folders(spark, root)
    if len(folders) <= back:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folders[-1 - back])


def last_good(spark: SparkSession, root: str, schema) -> DataFrame:
    """The newest version that can be read; a damaged one falls back to the one before it."""
    for back in range(max(1, len(_folders(spark, root)))):
        try:
            df = latest(spark, root, schema, back)
            df.limit(1).count()
            return df
        except Exception:  # noqa: BLE001 - any unreadable version is skipped
            continue
    return spark.createDataFrame([], schema)


def publish(df: DataFrame, root: str, version: int, keep: int = KEEP) -> str:
    """Write one version. Writing the same version again (a retried batch) replaces it with the same rows.

    Versions before the last ``keep`` ones are dropped, so a job that publishes with every batch has a bounded number of folders.
    """
    path = f"{root}/v={version:012d}"
    df.write.mode("overwrite").parquet(path)
    for old in _folders(df.sparkSession, root)[:-keep]:
        drop(df.sparkSession, old)
    return path


def next_version(spark: SparkSession, root: str) -> int:
    done = committed(spark, root, "v")
    return max(done) + 1 if done else 0
