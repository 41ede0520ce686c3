"""Files in and out: JSON, Parquet, CSV and SQLite."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_raw(spark: SparkSession, path: str, schema: StructType | None = None, lines: bool = False) -> DataFrame:
    """A raw entity: a JSON array of flat records, or one record on each of the ``lines``. A missing file raises; an empty one has no rows."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def write_raw(df: DataFrame, path: str) -> None:
    """Records as JSON, one file for each partition."""
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table; a missing one is empty, with ``schema`` or no columns."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema or StructType([]))


def save(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> str:
    """Written as Parquet or CSV with a header; anything else is a ValueError."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    if kind == "parquet":
        w.parquet(path)
    elif kind == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {kind}")
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def export_csv(df: DataFrame, path: str, rows: int | None = 10_000) -> str:
    """A CSV for a spreadsheet: at most ``rows`` rows in one file, or all of them in several."""
    if rows is not None:
        df = df.limit(rows).coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_tables(tables: dict[str, DataFrame], folder: str, names: list[str] | None = None, rows: int | None = 10_000) -> dict[str, str]:
    """``export_csv`` of every table (names beginning with _ excepted), or of those named; none of them there is a ValueError."""
    wanted = {n: d for n, d in tables.items() if not n.startswith("_") and (not names or n in names)}
    if names and not wanted:
        raise ValueError(f"no such tables: {', '.join(names)}")
    return {n: export_csv(d, f"{folder.rstrip('/')}/{n}.csv", rows) for n, d in wanted.items()}


def append_metrics(spark: SparkSession, path: str, row: dict) -> None:
    """One run appended to a metrics table."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").option("header", True).csv(path)


def export_sqlite(tables: dict[str, DataFrame], path: str, batch: int = 5_000) -> list[str]:
    """Every table (names beginning with _ excepted) replaced in a SQLite file, streamed partition by partition.

    SQLite has one writer, so the driver writes; it holds one partition at a time. Other stores: ``jdbc``.
    """
    done = []
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            if name.startswith("_"):
                continue
            names = ", ".join(f'"{c}"' for c in df.columns)
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({names})')
            put = f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})'
            rows: list[tuple] = []
            for r in df.toLocalIterator():
                rows.append(tuple(v if v is None or isinstance(v, (int, float, str, bytes)) else str(v) for v in r))
                if len(rows) >= batch:
                    db.executemany(put, rows)
                    rows = []
            db.executemany(put, rows)
            done.append(name)
    return done


def export_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    """To a database through JDBC, in parallel."""
    df.write.mode("overwrite").options(**options).jdbc(url, name)


def staged(spark: SparkSession, path: str, make) -> DataFrame:
    """The stage written at ``path``, made first if it isn't there: a run that broke off resumes here."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def size_mb(path: str, spark: SparkSession | None = None) -> float:
    """Megabytes of a file or folder on any file system that the session can reach; of a missing one 0."""
    spark = spark or SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return round(system.getContentSummary(p).getLength() / (1024 * 1024), 2) if system.exists(p) else 0.0


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def each(names: list[str], work: Callable) -> dict[str, object]:
    """``work`` for each name; a failure of one does not stop the others."""
    out: dict = {}
    for n in names:
        try:
            out[n] = work(n)
        except Exception as e:  # noqa: BLE001
            out[n] = e
    return out
