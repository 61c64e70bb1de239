"""Remote folder listings as a Python data source, with a pluggable client.

A client has `page(folder, token) -> (entries, next_token)`; entries are dicts with id, name,
size and kind ("folder", "file" or "document"). Transient failures are tried again with
growing pauses; what can't succeed is raised at once. No client for a network service comes
with the engine."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "source_id string, name string, path string, size long"
# Fixed values of the retry policy.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 6, 1.0, 60.0
TRANSIENT = (408, 429, 500, 502, 503, 504)


class RemoteError(Exception):
    def __init__(self, status: int, reason: str = ""):
        super().__init__(f"{status} {reason}".strip())
        self.status, self.reason = status, reason


def transient(error: RemoteError) -> bool:
    """Whether trying again may help: rate limits come as 403 too, refusals don't change."""
    return error.status in TRANSIENT or error.status == 403 and "rate" in error.reason.lower()


def tried(call: Callable, *args, pause: Callable[[float], None] = time.sleep):
    wait = FIRST_PAUSE
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call(*args)
        except RemoteError as e:
            if not transient(e) or attempt == ATTEMPTS:
                raise
            pause(wait)
            wait = min(LONGEST_PAUSE, 2 * wait)


def walk(client, root: str, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """(source_id, name, path, size) of all files below a folder; a folder met twice is read once, online documents are skipped."""
    seen, open_ = {root}, [(root, "")]
    while open_:
        folder, at = open_.pop()
        token = None
        while True:
            entries, token = tried(client.page, folder, token, pause=pause)
            for e in sorted(entries, key=lambda e: e["name"]):
                path = f"{at}{e['name']}"
                if e["kind"] == "folder":
                    if e["id"] not in seen:
                        seen.add(e["id"])
                        open_.append((e["id"], path + "/"))
                elif e["kind"] == "file":
                    yield e["id"], e["name"], path, e.get("size")
            if not token:
                break


def source(name: str, build: Callable[[], object], roots: list[str]) -> type[DataSource]:
    """A data source class over listings; each root is read by a task of its own."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(r) for r in roots]

        def read(self, partition):
            yield from walk(build(), partition.value)

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ROWS

        def reader(self, schema):
            return Reader()

    return Remote


def listing(spark: SparkSession, build: Callable[[], object], roots: list[str], name: str = "remote_listing") -> DataFrame:
    spark.dataSource.register(source(name, build, roots))
    return spark.read.format(name).load()


def error_text(status: Column, reason: Column) -> Column:
    """What to tell people about a failed request."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when((status == 403) & low.contains("rate"), "too many requests; try again in a while")
        .when((status == 403) & low.contains("key"), "the access key was refused")
        .when(status == 403, "the folder is not shared")
        .when(status == 404, "the folder was not found")
        .when(status == 400, "the link or key is malformed")
        .when(status.isin(*TRANSIENT), "the service is unavailable just now")
        .otherwise(F.concat(F.lit("unexpected answer "), F.coalesce(status.cast("string"), F.lit("?"))))
    )
