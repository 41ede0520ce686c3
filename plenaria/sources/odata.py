"""An OData service as a Spark data source: one partition for each entity, pages followed lazily."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class TooManyFailures(RuntimeError):
    pass


def get(url: str, retries: int = 4, wait: float = 2.0, timeout: float = 60.0, sleep=time.sleep, opener=urllib.request.urlopen) -> dict:
    """The JSON at ``url``. 429 waits longest, server and network errors less; other client errors raise at once."""
    last: Exception | None = None
    for n in range(retries):
        try:
            with opener(url, timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code == 429:
                pause = wait ** (n + 2)
            elif e.code >= 500:
                pause = wait ** (n + 1)
            else:
                raise
            last = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            pause, last = wait ** (n + 1), e
        sleep(pause)
    raise TooManyFailures(f"{url}: {last}")


def first_page(base: str, entity: str) -> str:
    return f"{base.rstrip('/')}/{entity}?" + urllib.parse.urlencode({"$filter": "Verwijderd eq false"}, quote_via=urllib.parse.quote)


def pages(base: str, entity: str, limit: int | None = None, pause: float = 0.25, fetch=get, sleep=time.sleep) -> Iterator[dict]:
    """Records of all pages of an entity, at most ``limit``."""
    url, seen = first_page(base, entity), 0
    while url:
        page = fetch(url)
        for r in page.get("value", []):
            if limit is not None and seen >= limit:
                return
            seen += 1
            yield r
        url = page.get("@odata.nextLink")
        if url:
            sleep(pause)


def count(base: str, entity: str, fetch=get) -> int | None:
    """Number of records the service reports, or None if it fails."""
    try:
        return int(fetch(f"{base.rstrip('/')}/{entity}?$top=0&$count=true")["@odata.count"])
    except Exception:  # noqa: BLE001
        return None


def download(base: str, entity: str, ids: list[str], folder: str, suffix: str = ".xml", skip_existing: bool = True, timeout: float = 60.0, opener=urllib.request.urlopen) -> dict[str, Path]:
    """The resource of each record as a file; ids without one (404) are left out, and what is there is not fetched again.

    Runs on the driver, before Spark reads the folder (``transcripts.read``).
    """
    out: dict[str, Path] = {}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for i in ids:
        to = Path(folder, f"{i}{suffix}")
        if not (skip_existing and to.exists() and to.stat().st_size):
            try:
                with opener(f"{base.rstrip('/')}/{entity}({i})/resource", timeout=timeout) as r:
                    body = r.read()
            except urllib.error.HTTPError as e:
                if e.code != 404:
                    raise
                continue
            if not body:
                continue
            to.write_bytes(body)
        out[i] = to
    return out


def fetched(ids: DataFrame, base: str, entity: str, suffix: str = ".xml", timeout: float = 60.0, opener=urllib.request.urlopen) -> DataFrame:
    """(path, content, reason) of the resource of each ``Id``, fetched in the tasks that hold the ids.

    Content is null and the reason says why where there is none or fetching failed; a failure stops nothing. Written as a
    table on any file system it is what ``transcripts.parse`` reads, and a run that broke off goes on with
    the ids that are not in it.
    """
    root = base.rstrip("/")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for i in d["Id"]:
                try:
                    with opener(f"{root}/{entity}({i})/resource", timeout=timeout) as r:
                        body = r.read()
                    rows.append((f"{i}{suffix}", body or None, None if body else "empty"))
                except Exception as e:  # noqa: BLE001
                    rows.append((f"{i}{suffix}", None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "reason"], dtype=object)

    return ids.select("Id").where("Id is not null").distinct().mapInPandas(of, "path string, content binary, reason string")


class _Entity(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [_Entity(n.strip()) for n in self.options["entity"].split(",") if n.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limit = self.options.get("limit")
        for r in pages(self.options["url"], partition.name, int(limit) if limit else None, float(self.options.get("pause", "0.25"))):
            yield tuple(None if (v := r.get(f.name)) is None else v if isinstance(v, str) else json.dumps(v) for f in self.schema.fields)


class ODataSource(DataSource):
    """``spark.read.format("odata").schema("Id string, ...").option("url", ...).option("entity", "A,B").load()``

    All columns are text, as cleaning types them.
    """

    @classmethod
    def name(cls) -> str:
        return "odata"

    def schema(self) -> str:
        return "Id string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))
