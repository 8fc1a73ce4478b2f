"""Micro-batches with a ledger: what a batch writes counts only once the ledger names the batch, which happens after all of it is written. A batch that comes again, because a query
failed on the way, writes the same places anew; one that the ledger names changes nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, registry


class Ledger:
    """folder/{table}/batch={id} holds what a batch wrote, folder/ledger one line for each batch that is done, with what it told."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        """batch and told (JSON)."""
        path = f"{self.folder}/ledger"
        schema = "batch long, told string"
        return self.spark.read.schema(schema).json(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def done(self, batch: int) -> bool:
        return self.entries().where(F.col("batch") == batch).limit(1).count() > 0

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of all batches that are done, with batch."""
        path, columns = f"{self.folder}/{table}", f"{schema}, batch long"
        if not self._there(path):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(path).join(self.entries().select("batch"), "batch", "left_semi")

    def write(self, batch: int, tables: dict[str, DataFrame], told: dict) -> None:
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")
        self.enter(batch, told)

    def enter(self, batch: int, told: dict) -> None:
        line = self.spark.createDataFrame([(batch, json.dumps(told))], "batch long, told string").coalesce(1)
        line.write.mode("overwrite").json(f"{self.folder}/ledger/of={batch}")

    def last(self, name: str, default: int) -> int:
        """The greatest that any batch told under a name: a cursor."""
        return self.entries().agg(F.max(F.get_json_object("told", f"$.{name}").cast("long"))).first()[0] or default


LINKS = "link_key string, id long, nth long, link string, title string, first_date string, first_time string, sender string, gid string, seq long"


def link_sink(spark: SparkSession, folder: str, magnets: bool = False, ledger: type[Ledger] = Ledger):
    """For foreachBatch of messages (id, scope, peer_id, sender_nick, ts, text), new ones and such as have changed: links that the registry lacks are appended, and the cursor
    moves to the greatest id, both or neither."""
    book = ledger(spark, folder)

    def sink(messages: DataFrame, batch: int) -> None:
        if book.done(batch):
            return
        rows = registry.appended(book.read("links", LINKS).select("link", "seq"), registry.link_rows(messages, magnets))
        top = messages.agg(F.max("id")).first()[0]
        book.write(batch, {"links": rows.select(*[c.split()[0] for c in LINKS.split(", ")])}, {"cursor": max(top or 0, book.last("cursor", 0))})

    return sink


def event_sink(spark: SparkSession, folder: str, ledger: type[Ledger] = Ledger):
    """For foreachBatch of lines (value, JSON): events and answers to calls (those with an echo) go to tables of their own; what is no JSON goes to neither, and is counted."""
    book = ledger(spark, folder)

    def sink(lines: DataFrame, batch: int) -> None:
        if book.done(batch):
            return
        told = events.event_stream(lines)
        echo = F.col("echo").isNotNull()
        book.write(batch, {"events": told.where(~echo).select("payload"), "answers": told.where(echo)}, {"lines": lines.count(), "read": told.count()})

    return sink
