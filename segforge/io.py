"""Table access, checkpoints and joins that stand skew."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a file or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    ``spark.checkpoint.dir`` wins; a private folder is made only where neither the setting nor the context has
    one and the master is local, as in tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "segforge-checkpoints")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write once, read many times: a reliable checkpoint in the shared folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def skew_join(big: DataFrame, small: DataFrame, on: list[str], row_id: Column, salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join in which one key may hold a large share of ``big``; ``small`` must have unique keys. The result equals the plain join.

    With adaptive execution (the default) it is the plain join: hot partitions of ``big`` are split at run time, and a side is
    broadcast only if the planner finds it small. Sessions that switch this off get ``big`` spread by ``row_id`` over
    ``salts`` partitions a key, against so many copies of ``small``.
    """
    conf = big.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "skewJoin.enabled")):
        return big.join(small, on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session, so that no path has to be set on them."""
    sc = spark.sparkContext
    if getattr(sc, "_segforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="segforge-")
    archive = os.path.join(folder, "segforge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("segforge", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._segforge_shipped = True
