"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text as a string column; a null counts as the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; empty for a text of separators only."""
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, which spark.checkpoint.dir names or the context already has.

    Where neither is set, a local session, which has one machine only, gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that lost executors cost one stage at most."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Shelf:
    """Written tables in a folder of their own under the shared checkpoint folder: they cut the lineage as checkpoints do,
    but are columnar, have known sizes, and go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Keeps a result in a folder of its own and removes all other tables."""
        result = Shelf(self.spark).keep(df)
        self.clear()
        return result

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")).cast("binary")) % n


def shingles(text: Column, size: int) -> Column:
    """Distinct word shingles of the A-Z-lower-cased text as 64-bit hashes.

    A text with fewer words has its whole sequence as one shingle; without words there is none. Within one text or
    pair of texts two shingles share a hash with a probability of about pairs / 2^64, which is taken as never.
    """
    words = words_of(ascii_lower(text))

    def hashed(w: Column) -> Column:
        n = F.size(w)
        each = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size))))
        return F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)
