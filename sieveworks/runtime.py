"""Session services shared by all operators: checkpoints, size checks, code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session runs on this machine alone (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not have:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="sieveworks-ckpt-")
        spark.conf.set("spark.checkpoint.dir", have)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(have)
    return have


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package: on this machine by its path, wherever the session was started; on others as an archive."""
    sc, root = spark.sparkContext, str(Path(__file__).resolve().parent.parent)
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if not sc.master.startswith("local") and not getattr(sc, "_sieveworks_shipped", False):
        ship_code(spark)
        sc._sieveworks_shipped = True


def ship_code(spark: SparkSession) -> str:
    """The package as an archive in the shared folder, added to the session; its address."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/sieveworks_code_{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    return path.toString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
