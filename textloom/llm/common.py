"""What the operators of this subpackage share: the scratch folder and skew-proof joins."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; everything else is part of a word.
WORD_RE = r"[^\x20\x09-\x0D]+"

BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master, as in tests, may go without; a cluster without one is an error, since
    no folder of a single machine is seen by the others.
    """
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


class Scratch:
    """Tables written to the shared folder to cut lineage, so a lost executor costs a re-read only.

    A table read back has no partitioning of its own: a join on it gets plain exchanges, whose
    hot partitions Spark can split at run time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/textloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop_all)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Python nodes of the table get BATCH_ROWS texts at once, which bounds both sides' buffers."""
        path, conf = f"{self.folder}/{name}", self.spark.conf
        rows = conf.get(BATCH_CONF)
        conf.set(BATCH_CONF, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(BATCH_CONF, rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self) -> None:
        """At exit only: results are lazy and may still read the tables."""
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the session is already going down
                pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys that are broadcast at most: two longs each, some tens of MB in all.
BROADCAST_KEYS = 1_000_000


def counted(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if they were counted to be few; else Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def give_back() -> None:
    """Return freed memory of a Python worker to the system: idle workers live on beside the next stage's."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A worker function over batches that gives back memory after each of them."""

    def fed(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    return lambda batches: run(fed(batches))
