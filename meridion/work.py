"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only where a local session names none is one made."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="meridion-")
        place = _local[app]
    return place.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/meridion/{name}-{uuid.uuid4().hex}"


def file_print(spark: SparkSession, df: DataFrame) -> str:
    """Changes with the files that a DataFrame reads: their names, sizes and times."""
    out, conf = [], spark._jsc.hadoopConfiguration()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        s = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()[:24]


#: Tables kept for this application, by what they were made of: folder and schema.
_kept: dict[tuple, tuple] = {}


def kept(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """A small table that many queries of a session start from: written once, read by all of them.

    It is built again where its input files have changed, or where the written copy is gone.
    """
    key = (spark.sparkContext.applicationId, name, *[file_print(spark, df) for df in inputs])
    if key in _kept:
        folder, schema = _kept[key]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(folder)
    df = build()
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    _kept[key] = folder, df.schema
    return spark.read.schema(df.schema).parquet(folder)
