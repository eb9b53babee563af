"""Tables in the folder that driver and executors share: how plans cut their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="graphlane-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; what is left of it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _leaving:
        _leaving.add(path)
        atexit.register(_leave, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _leave(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the JVM may be gone; a stopped application's folder can be removed by hand
        pass


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, outlives executors and is computed once."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.gl_path = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("gl_path", None) if table is not None else None
        if path:
            _delete(table.sparkSession, path)


def clear_tables(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, once the results that read them are stored elsewhere."""
    _delete(spark, tables_dir(spark))


class Parts:
    """A table that grows by parts: a part is written once and merged when as much has come after it, so a loop that
    adds to it for many rounds neither rewrites the whole each time nor reads very many parts."""

    def __init__(self, name: str, *parts: DataFrame) -> None:
        self.name, self.parts = name, [(part, part.count()) for part in parts]

    def add(self, part: DataFrame) -> None:
        """part: a written table, which may be gone after that."""
        self.parts.append((part, part.count()))
        while len(self.parts) > 1 and 2 * self.parts[-1][1] >= self.parts[-2][1]:
            (a, n), (b, m) = self.parts[-2:]
            self.parts[-2:] = [(written(a.unionByName(b), self.name), n + m)]
            dropped(a, b)

    def whole(self) -> DataFrame:
        out = self.parts[0][0]
        for part, _ in self.parts[1:]:
            out = out.unionByName(part)
        return out
