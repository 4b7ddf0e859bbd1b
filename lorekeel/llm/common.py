"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space (space, \t, \n, \v, \f, \r); every word rule of the subpackage uses it.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text, in order."""
    bare = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def n_words_of(text: Column) -> Column:
    """Number of words as long, without a list of them being kept."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is made
    once and set as the checkpoint folder; on a cluster that is an error, since the
    driver's own folders are not the executors'.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeel-"))
    return str(sc.getCheckpointDir()).rstrip("/")


class Tables:
    """Intermediate tables, written as Parquet in a folder of the shared one.

    A written table has no lineage: a lost executor costs the reading tasks only.
    ``drop`` deletes what a later table has replaced; what a returned frame still
    reads stays until its caller deletes ``folder``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def put(self, frame: DataFrame, narrow: bool = False) -> DataFrame:
        """Write a table and read it; ``narrow`` rows of a few numbers are first gathered into files of the advisory size.

        What an aggregation made needs no ``narrow``: Spark joins the small parts of its exchange
        itself, and another exchange costs the driver a task, with all its metrics, for each part.
        """
        path = f"{self.folder}/{len(self.paths)}"
        (frame.hint("rebalance") if narrow else frame).write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            delete(self.spark, self.paths[id(frame)][1])


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's file systems find it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(frame: DataFrame, narrow: bool = False) -> DataFrame:
    """Materialise a frame in the shared folder and cut its lineage there; ``narrow`` as in Tables.put."""
    shared_dir(frame.sparkSession)
    return (frame.hint("rebalance") if narrow else frame).checkpoint()


def keep_rows(docs: DataFrame, winners: DataFrame, digest: Column, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` named by ``winners`` (digest, id), each once, with their columns.

    Texts are exchanged once, by (digest, doc_id). Rows that tie on both are ordered
    by their text and other columns there, so a rerun picks the same one whatever way
    the input is split.
    """

    def key(mark: Column, number: Column) -> Column:
        return F.concat_ws(":", mark, F.coalesce(number.cast("string"), F.lit("none")))

    names = docs.columns
    best = cut(winners.select(key(F.col("digest"), F.col("id")).alias("winner")).distinct())
    boxed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("box"), key(digest, F.col(doc_id)).alias("winner"))
    others = F.struct(*[F.col(f"box.`{n}`") for n in names if n != text] or [F.lit(0).alias("none")])
    tied = Window.partitionBy("winner").orderBy(F.col(f"box.`{text}`"), F.to_json(others))
    stay = boxed.join(best, "winner", "left_semi").withColumn("place", F.row_number().over(tied))
    return stay.where("place = 1").select("box.*")
