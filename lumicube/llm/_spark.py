"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows of an Arrow batch where the session has Spark's default of 10,000: texts are long, and the batches of
#: a task's input and output are held in memory on both sides.
BATCH_ROWS = 1000
#: A key with more rows than MIN_HOT is hot and is dealt over tasks, the HOT_KEYS most frequent ones at most (the
#: others are joined undealt, and adaptive execution may still split them).
MIN_HOT, HOT_KEYS = 10_000, 10_000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing of it.

    The folder is the cluster's ``spark.checkpoint.dir``.  Only where none is set, as in tests on one
    machine, a temporary folder is taken.
    """
    bounded_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scrap(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``cut`` that no later plan reads."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete_folder(df.sparkSession, file.get())


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """(key, parts) of the keys whose number of rows ``n`` is above MIN_HOT; HOT_KEYS rows at most."""
    hot = counts.filter(F.col(n) > MIN_HOT).orderBy(F.desc(n), *on).limit(HOT_KEYS)
    return hot.select(*on, F.ceil(F.col(n) / MIN_HOT).cast("int").alias("parts"))


def salted_join(many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame, salt: list[str], how: str = "inner") -> DataFrame:
    """Equality join whose hot keys are dealt: rows of ``many`` by a hash of ``salt``, rows of ``one`` to every deal.

    ``hot`` is what ``hot_keys`` gives, so its broadcast is bounded.  ``how`` may be inner, left or left_anti.
    """
    parts = F.coalesce("parts", F.lit(1))
    left = many.join(F.broadcast(hot), on, "left").withColumn("deal", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("parts")
    right = one.join(F.broadcast(hot), on, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*on, "deal"], how).drop("deal")
