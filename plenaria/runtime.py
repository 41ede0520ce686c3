"""Things that every operator needs of the cluster: lineage cuts, proven bounds, table reads."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class BoundExceeded(RuntimeError):
    """A table that must be small for an operator is not; nothing is ever cut to fit."""


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each application, so that their Python finds it.

    The archive goes through the shared folder of the cluster; only in local mode, without one, a
    temporary file holds it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    here = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    name = f"plenaria-{sc.applicationId}.zip"
    if shared := _configured(spark):
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{name}")
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(archive.getvalue()))
        out.close()
        sc.addPyFile(at.toString())
    else:
        to = Path(tempfile.mkdtemp(prefix="plenaria-ship-")) / name
        to.write_bytes(archive.getvalue())
        sc.addPyFile(str(to))
        atexit.register(shutil.rmtree, to.parent, True)
    _shipped.add(sc.applicationId)
    return spark


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under ``root``: one Parquet file or a folder of them."""
    return ship(spark).read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is made only where none is configured (tests)."""
    sc = spark.sparkContext
    shared = _configured(spark)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"plenaria-checkpoints-{os.getpid()}")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def within(df: DataFrame, rows: int, size: int) -> list[Row] | None:
    """All rows of a reference table, if it has at most ``rows`` of them and ``size`` characters in all; else None.

    The size is added up on the cluster before a row is sent; the count stops after ``rows + 1``.
    """
    letters = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
    return df.collect() if n <= rows and total <= size else None


def bounded(df: DataFrame, rows: int, what: str) -> list[Row]:
    """All rows of a reference table, which must have at most ``rows``; else an error, never a cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise BoundExceeded(f"{what} has more than {rows} rows; raise the bound")
    return got


def broadcast_within(df: DataFrame, rows: int, size: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` characters as JSON, else as it is (shuffled join).

    The count stops after ``rows + 1`` rows, so it costs nothing on a large table.
    """
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
