"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/loomframe-shared"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place, files = _folder(df.sparkSession, path)
            files.delete(place, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written as Parquet and read again, which ends the lineage. The folder goes when the driver's JVM ends, or earlier
    by `drop_stored`."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    place, files = _folder(df.sparkSession, path)
    files.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)
