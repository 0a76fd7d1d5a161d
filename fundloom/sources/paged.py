"""Paged web services as tables: a Python data source, and a reader for scopes that are themselves a table.

A scope is what one request asks for (an organisation, a batch of keys, a year, an id), as a dict. Each
scope is a partition of its own and is paged until a page is short, empty or repeats the one before, the
offset passes the ceiling, or the cap is met. Pages come from the service, or, for tests and replays, from a
folder of recorded pages.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "scope string, position int, record string"


@dataclass(frozen=True)
class Service:
    """How to ask: address, verb, rows of a page, largest offset, most records of a scope (0: all), pause in seconds,
    path of the records in an answer, field by which a repeated page is known, folder of recorded pages."""

    url: str = ""
    method: str = "GET"
    limit: int = 500
    ceiling: int = 14_999
    cap: int = 0
    pause: float = 1.0
    records: str = "results"
    identity: str = "id"
    recorded: str = ""

    @staticmethod
    def of(options: dict[str, str]) -> Service:
        low = {k.lower(): v for k, v in options.items()}
        return Service(**{k: type(v)(low[k]) for k, v in asdict(Service()).items() if k in low})


def page_name(scope: dict, offset: int) -> str:
    """File of a recorded page."""
    return f"{hashlib.sha256(json.dumps(scope, sort_keys=True).encode()).hexdigest()[:16]}-{offset}.json"


def _page(service: Service, scope: dict, offset: int) -> list[dict]:
    if service.recorded:
        p = Path(service.recorded, page_name(scope, offset))
        answer = json.loads(p.read_text()) if p.exists() else {}
    else:
        asked = {**scope, "offset": offset, "limit": service.limit}
        if service.method == "POST":
            request = urllib.request.Request(service.url, json.dumps(asked).encode(), {"content-type": "application/json"})
        else:
            request = urllib.request.Request(f"{service.url}?{urllib.parse.urlencode(asked)}")
        with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
            answer = json.load(r)
    for step in service.records.split("."):
        answer = (answer or {}).get(step) if isinstance(answer, dict) else None
    return answer or []


def records(service: Service, scope: dict) -> Iterator[dict]:
    """All records of a scope, page by page."""
    told, last, offset = 0, None, 0
    while offset <= service.ceiling:
        page = _page(service, scope, offset)
        first = page[0].get(service.identity) if page else None
        if not page or (first is not None and first == last):  # the offset doesn't move the result on
            return
        for r in page:
            if service.cap and told >= service.cap:
                return
            told += 1
            yield r
        if len(page) < service.limit:
            return
        last, offset = first, offset + service.limit
        if service.pause and not service.recorded:
            time.sleep(service.pause)


class _Scope(InputPartition):
    def __init__(self, scope: dict):
        super().__init__(json.dumps(scope, sort_keys=True))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service = Service.of(options)
        self.scopes = json.loads({k.lower(): v for k, v in options.items()}.get("scopes", "[{}]"))

    def partitions(self) -> list[InputPartition]:
        return [_Scope(s) for s in self.scopes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, r in enumerate(records(self.service, json.loads(partition.value))):
            yield (partition.value, i, json.dumps(r))


class PagedService(DataSource):
    """spark.read.format("paged_service") with the fields of Service as options and `scopes` as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_scopes(spark: SparkSession, scopes: list[dict], **options: object) -> DataFrame:
    """Records of a list of scopes (organisation, ids, years): scope, position, record as JSON."""
    spark.dataSource.register(PagedService)
    return spark.read.format("paged_service").options(scopes=json.dumps(scopes), **{k: str(v) for k, v in options.items()}).load()


def key_batches(keys: DataFrame, key: str, name: str, size: int = 50, suffix: str = "*") -> DataFrame:
    """Scopes that ask for up to about `size` keys each, as a column `scope` of JSON; keys stay distributed."""
    n = keys.select(key).distinct().count()
    batch = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size))))
    told = keys.where(F.col(key).isNotNull()).select(key).distinct().groupBy(batch.alias("b")).agg(F.array_sort(F.collect_list(F.concat(F.col(key), F.lit(suffix)))).alias("k"))
    return told.select(F.to_json(F.struct(F.col("k").alias(name))).alias("scope"))


def fetch_scopes(scopes: DataFrame, **options: object) -> DataFrame:
    """Records of the scopes of a table (column scope, JSON), fetched where the scopes lie."""
    service = Service.of({k: str(v) for k, v in options.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["scope"]:
                got = [json.dumps(r) for r in records(service, json.loads(s))]
                yield pd.DataFrame({"scope": [s] * len(got), "position": pd.Series(range(len(got)), dtype="int32"), "record": got})

    return scopes.select("scope").mapInPandas(run, SCHEMA)


def fetch_plan(bulk: DataFrame, wanted: DataFrame, bulk_key: Column, wanted_key: Column, name: str, size: int = 50, **options: object) -> DataFrame:
    """The bulk records, and those of wanted keys that the bulk lacks, asked for in batches."""
    missing = wanted.select(wanted_key.alias("k")).where("k IS NOT NULL").distinct().join(bulk.select(bulk_key.alias("k")), "k", "left_anti")
    return bulk.unionByName(fetch_scopes(key_batches(missing, "k", name, size), **options))
