"""What the training-data operators share: shared storage, column picking, digests."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BATCH = "8m"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, as in tests on one
    machine, a folder of our own is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has in the shared folder. Results that still read them are lost."""
    remove_path(spark, own_dir(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that new_path() named and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    return written_at(df, name, compression)[0]


def written_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables in the shared folder that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove_path(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written_at(df, name)
        self.paths.append(path)
        return out


def small_arrow_batches(df: DataFrame) -> None:
    """Bound what a task holds of whole texts in Arrow form, in the JVM and in its Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no extra column can clash with what an operator adds."""
    small_arrow_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 on division by 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def hash_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone: samples are the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a task's share of an input, as Catalyst estimates it (compressed files), should not pass by far.
PART_BYTES = 128 << 20


def part_count(df: DataFrame) -> int:
    """Parts for an explicit repartitioning: the session's shuffle partitions, or more where the input's bytes ask for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 55  # what has no files counts as endless
    return max(shuffle_partitions(df.sparkSession), -(-size // PART_BYTES) if known else 1)


def in_doc_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id and text, dealt into parts that are ranges of doc_id and sorted within; rows without an id first.

    Rows of one doc_id are in order of their text's hash, equal rows in that of their place in the
    input, so that a range may end between any two rows, however many share an id.
    """
    rows = id_text(docs)
    order = ("doc_id", F.xxhash64("text"), F.col("place"))
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(parts or part_count(rows), *order).sortWithinPartitions(*order).select("doc_id", "text")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, whatever its letters' case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quantiles(df: DataFrame, column: str, parts: int) -> list[int]:
    """Distinct bounds, ascending, that cut a long column into about equal parts; none for an empty table."""
    if parts < 2:
        return []
    wanted = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(column, wanted, 10_000)).first()[0] or []))


def quiet_threads() -> None:
    """One thread for each Python worker: the cores belong to Spark's tasks. Few rounds of cycle search."""
    gc.set_threshold(100_000, 50, 100)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
