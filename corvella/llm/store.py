"""Tables written between the steps of an operator.

They stand in the shared folder that the cluster names in spark.checkpoint.dir,
so that a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.operators.cut import shared_dir


class Cuts:
    """Intermediate tables of one run of an operator: cut() writes and rereads one, drop() deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/corvella-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvella_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._corvella_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys that may be sent to every task: 16 MB or so for one long.
FEW_ROWS = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """A written table of narrow keys as the small side of a join: sent to the large side if it has at most FEW_ROWS rows, so that texts need not move, and else built into hash tables beside them."""
    return F.broadcast(keys) if keys.count() <= FEW_ROWS else keys.hint("shuffle_hash")


#: Spark bounds Arrow batches by rows alone, and its usual bound, in texts of some size, fills a worker's memory.
BATCH_KEY, USUAL, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, whose texts go to Python: batches hold 1000 rows in a session that has not set another number."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_KEY) == USUAL:
        conf.set(BATCH_KEY, TEXTS)
    return docs


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
