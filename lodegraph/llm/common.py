"""Plumbing shared by the training-data operators: shared scratch tables and column hygiene."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: str | None = None
_SCOPES: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a local-mode session gets a temporary folder (tests); a cluster
    session is refused, since a machine-local folder would be lost with its machine.
    """
    global _LOCAL_SCRATCH
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="lodegraph-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH, ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage and survives lost executors, and it computes ``df`` once. ``keep``: it outlives ``scratch_of``.
    """
    path = f"{shared_dir(df.sparkSession)}/lodegraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    for scope in () if keep else _SCOPES:
        scope.append(back)
    back._scratch_path = path  # for drop_scratch; not a public attribute of DataFrame
    return back


def brief(batches: Iterable, rows: int = 512):
    """Batches of at most ``rows`` rows, so that the texts of a few only are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def scratch_of(spark: SparkSession):
    """Deletes, at its end, the tables that ``materialize`` wrote within: for callers that have written what they wanted of them."""
    mine: list[DataFrame] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for table in mine:
            drop_scratch(table)


def drop_scratch(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    fs.delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as UTF-8 bytes (null stays null), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_mark() -> Column:
    """A number that tells apart texts under one repeated id; null and empty are alike."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decided`` (doc_id, mark, kept) keeps, by id and ``text_mark``, with the columns of ``docs``.

    Rows alike in id and text are one document: if it is kept, one row of it stays. Both tables are
    joined on the id; the side of decisions is the smaller, those that drop, and Spark checks its size
    before it broadcasts it.
    """
    votes = decided.groupBy("doc_id", "mark").agg(F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n"))
    votes = materialize(votes.where("n_kept < n OR n > 1"), "decided")
    marked = docs.withColumn("__mark", text_mark())
    key = F.col("doc_id").cast("long")

    def without(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"))
        return rows.join(some, key.eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")), how)

    out = without(marked, votes, "left_anti")
    once = votes.where("n_kept > 0")
    if once.limit(1).count():
        out = out.unionByName(without(marked, once, "left_semi").dropDuplicates(["doc_id", "__mark"]))
    return out.select(*docs.columns)
