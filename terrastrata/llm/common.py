"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: blank and the controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, local masters (tests) get one of our own; executors elsewhere couldn't see it, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='terrastrata-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: for small tables that loops read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _written_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read that: for large tables read twice.

    The tables stay, as results are lazy, until ``clear_written``.
    """
    spark, path = df.sparkSession, f"{_written_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> bool:
    """Delete all that ``written`` has written in this application: for when its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_written_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does the same for plain ASCII and is much faster there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def one_of(chars: str) -> str:
    """A pattern for one of ``chars``, each written out, which Java looks up in one table."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]"


def words_of(text: Column) -> Column:
    """The runs of characters other than white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as the lambda variable of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark ``df`` (a cut table of short rows) for broadcast if a count shows it small enough.

    Beyond that Spark joins it by shuffle.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def guarded(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with its columns of these names (any case), or that begin with ``__``, renamed; and what undoes it.

    So an operator can add columns of its own and leave the user's as they were: the second value selects
    the columns of ``df`` under their names, in their order, and what is added to them.
    """
    taken, columns = {n.lower() for n in names}, df.columns
    known = {c.lower() for c in columns}
    aside: dict[str, str] = {}
    for i, c in enumerate(columns):
        if c.lower() in taken or c.startswith("__"):
            new = f"own_{i}"
            while new in known:
                new += "_"
            aside[c] = new
    return df.withColumnsRenamed(aside), lambda out, *added: out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in columns), *added)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns (any case) that an operator is about to write itself."""
    taken = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))
