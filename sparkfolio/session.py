"""Session helpers shared by all operators: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores where it would be fewer tasks than half of them: a small file of one row group cannot be split.

    For scans only; larger inputs have more splits than that and are left as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > want else df.repartition(want)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in `spark.checkpoint.dir`; only where neither that setting nor a folder set by the
    caller exists, and all runs on this machine (tests, a laptop), is a temporary one made, which goes when Python ends. RuntimeError on a
    cluster without a shared folder: its executors would each write to their own disk.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkfolio-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage (a reliable checkpoint).

    Several consumers of an expensive intermediate result then read it instead of computing it again, and it
    survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared checkpoint folder and read again.

    As cut(), for loops: what a plan knows of a checkpoint's columns still grows with every turn, of a table it knows nothing. The table stays until the
    folder goes, so this is for small intermediate results.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Number of partitions that hold at most about `per_part` rows each."""
    return max(least, math.ceil(rows / per_part))
