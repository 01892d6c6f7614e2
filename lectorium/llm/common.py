"""What the operators of this package share: reading tables, materialising, small-side checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words everywhere in this package.
WORD_GAP = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: Texts that go to a Python worker at a time.
BATCH_TEXTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; an empty array for null and for texts without a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP + "+"), lambda w: w != "")


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectorium-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder and cut the lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """A folder that a job has written and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only when the counted side has at most ``limit`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two seeded 64-bit hashes, so thin tables need not carry the text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second key"), text).alias("k2")]


def texts_in(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a table of texts on their way to Python workers, in batches of a few megabytes.

    The default of 10,000 rows a batch makes a worker hold tens of megabytes of text several times over; a smaller
    number that the user has set stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_TEXTS:
        conf.set(name, str(BATCH_TEXTS))
    return docs.select(*columns)
