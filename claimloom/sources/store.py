"""Tables that jobs write: batches appended once, and partitions replaced one by one.

A table of batches is a folder with a folder a batch, each written by one job and marked when
that job commits. A batch that is there is never written again, so a driver that tries a job
a second time adds nothing, and what earlier batches hold stays byte for byte. A batch whose job
was lost before it committed has no mark: readers pass over it, and the next try overwrites it.
The marks are Spark's own ``_SUCCESS`` files; don't switch them off.

Tables are in the folder that driver and executors share, which the session names in
spark.checkpoint.dir, unless a path is given.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "batch"
_LOCAL: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; local masters without one get a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _LOCAL[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table: computed once, whatever reads them, and safe from lost executors."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def part_of(key: str, parts: int) -> Column:
    """A number below ``parts`` for each key, to partition by where keys are too many for a folder each."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote a folder came to its end."""
    files, place = _at(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def _balanced(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.hint("rebalance", *by) if by else rows


def append(rows: DataFrame, path: str, batch: str, by: Sequence[str] = ()) -> bool:
    """Adds rows as one batch, in partitions by the columns ``by``; False if that batch is there already.

    Two jobs must not append the same batch at the same time. Rows are rebalanced by ``by``,
    which must have few values: each partition becomes few files, a hot one as many as its size needs."""
    if not batch:
        raise ValueError("a batch needs a name")
    spark, target = rows.sparkSession, f"{path}/{BATCH}={quote(batch, safe='')}"
    if committed(spark, target):
        return False
    _balanced(rows, by).write.mode("overwrite").partitionBy(*by).parquet(target)
    return True


def batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of committed batches."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath().toString() for s in files.listStatus(place) if s.isDirectory()]
    return sorted(f for f in found if f.rsplit("/", 1)[-1].startswith(f"{BATCH}=") and committed(spark, f))


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed batches: the columns of schema, and ``batch``. Filters on it and on what it is partitioned by prune folders.

    No batch gives no rows."""
    full = StructType(list(schema.fields)).add(BATCH, "string")
    found = batches(spark, path)
    if not found:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*found)


def replace(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes rows in place of the partitions (by the columns ``by``) that they have; others stay as they are.

    rows may be computed from the same table: files are moved in when all are written."""
    _balanced(rows, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
