"""Sinks for foreachBatch: a table upserted by buckets, and an at-least-once forwarder.

Both are safe to replay: a batch that runs again, because the stream stopped between its effect and its checkpoint, leaves what it
left the first time. Their folders lie in storage that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelake.operators.store import last_write_wins

Sink = Callable[[DataFrame, int], None]


class Folder:
    """Small JSON records in a folder of any file system that Spark can reach; a record appears as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm.org.apache.hadoop.fs.Path, path
        self.fs = self.jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        folder = self.jvm(self.path)
        listed = self.fs.listStatus(folder) if self.fs.exists(folder) else []
        return sorted(x.getPath().getName() for x in listed if not x.getPath().getName().startswith("_"))

    def read(self, name: str):
        at = self.jvm(f"{self.path}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, record) -> None:
        before, at = self.jvm(f"{self.path}/_{name}"), self.jvm(f"{self.path}/{name}")
        stream = self.fs.create(before, True)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        self.fs.delete(at, False)
        self.fs.rename(before, at)

    def delete(self, name: str) -> None:
        self.fs.delete(self.jvm(f"{self.path}/{name}"), True)


class Table:
    """A table that keeps the last row of each key by one or two whole numbers, in hash buckets.

    A batch reads and writes the buckets that its keys fall in and no others. Each bucket it touches is a new file under the batch's
    number; then a manifest says which batch's file is each bucket's. Readers see the last manifest, so they see a batch whole or
    not; the manifest before it and its files stay, as the batch may run again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets
        self.manifests = Folder(spark, f"{path}/manifests")

    def manifest(self, under: int | None = None) -> dict[str, int]:
        """Bucket to batch, of the last manifest (before a batch)."""
        numbers = [int(n.removesuffix(".json")) for n in self.manifests.names()]
        last = max((n for n in numbers if under is None or n < under), default=None)
        record = {"buckets": self.buckets, "files": {}} if last is None else self.manifests.read(f"{last:012d}.json")
        if record["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {record['buckets']} buckets, not {self.buckets}")
        return record["files"]

    def files(self, manifest: dict[str, int], buckets: list[str] | None = None) -> list[str]:
        return [f"{self.path}/batch-{n}/bucket={b}" for b, n in manifest.items() if buckets is None or b in buckets]

    def read(self) -> DataFrame:
        paths = self.files(self.manifest())
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, number: int) -> None:
        before = self.manifest(under=number)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = batch.select(*[x.split()[0] for x in self.schema.split(", ")]).withColumn("bucket", bucket).persist()
        try:
            touched = sorted(str(r[0]) for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
            old = self.files(before, touched)
            every = rows.unionByName(self.spark.read.schema(self.schema).parquet(*old).withColumn("bucket", bucket)) if old else rows
            kept = last_write_wins(every, self.key, self.order)
            if touched:
                kept.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch-{number}")
        finally:
            rows.unpersist()
        self.manifests.write(f"{number:012d}.json", {"buckets": self.buckets, "files": before | dict.fromkeys(touched, number)})
        self.clean(number)

    def clean(self, number: int) -> None:
        """Removes manifests before the last but one, and batches' files that neither of the two names."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self.manifests.names())
        kept = [n for n in numbers if n <= number][-2:]
        used = {b for n in kept for b in self.files(self.manifests.read(f"{n:012d}.json")["files"])}
        root = Folder(self.spark, self.path)
        for n in numbers:
            if n < kept[0]:
                self.manifests.delete(f"{n:012d}.json")
        for batch in (n for n in root.names() if n.startswith("batch-")):
            folder = Folder(self.spark, f"{self.path}/{batch}")
            for name in folder.names():
                if f"{self.path}/{batch}/{name}" not in used:
                    folder.delete(name)
            if not folder.names():
                root.delete(batch)


class Held(RuntimeError):
    """The receiver can't take rows now: nothing is saved, and the batch will come again."""


class Forwarder:
    """Posts the rows of streams to a receiver, at least once and in order within a partition of time.

    post(stream, rows) gives a status: under 400 the rows were taken; under 500 they were refused for good, which another try can't
    mend, so they pass and are counted; from 500 on, or with an exception, they are held. Tasks post pages of rows, so no batch
    passes through the driver. Each stream has a record of its own (last batch, time of its newest row, counts), so one
    that is held doesn't hold the others. Rows may be posted again after a failure: the receiver tells them by their ids.
    """

    def __init__(self, spark: SparkSession, folder: str, post: Callable[[str, list[dict]], int], page: int = 500) -> None:
        self.spark, self.post, self.page, self.records = spark, post, page, Folder(spark, folder)

    def cursor(self, stream: str) -> dict:
        return self.records.read(f"{stream}.json") or {"batch": -1, "ts_us": None, "taken": 0, "refused": 0}

    def send(self, stream: str, rows: DataFrame) -> tuple[int, int, int | None]:
        """(taken, refused, time of the newest row); Held if any page was."""
        post, page, columns = self.post, self.page, rows.columns

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for start in range(0, len(pdf), page):
                    part = pdf.iloc[start : start + page]
                    status = post(stream, part.astype(object).where(part.notna(), None).to_dict("records"))
                    if status >= 500:
                        raise Held(f"{stream}: status {status}")
                    yield pd.DataFrame({"taken": [len(part) if status < 400 else 0], "refused": [0 if status < 400 else len(part)], "ts_us": [part["ts_us"].max()]})

        ordered = rows.repartitionByRange("ts_us").sortWithinPartitions(*[c for c in ("ts_us", "seq") if c in columns])
        sent = ordered.mapInPandas(run, "taken long, refused long, ts_us long").agg(F.sum("taken"), F.sum("refused"), F.max("ts_us")).first()
        return sent[0] or 0, sent[1] or 0, sent[2]

    def sink(self, stream: str) -> Sink:
        def write(batch: DataFrame, number: int) -> None:
            done = self.cursor(stream)
            if number <= done["batch"]:
                return  # sent and recorded, but the stream's own checkpoint wasn't
            taken, refused, newest = self.send(stream, batch)
            last = max((t for t in (done["ts_us"], newest) if t is not None), default=None)
            self.records.write(f"{stream}.json", {"batch": number, "ts_us": last, "taken": done["taken"] + taken, "refused": done["refused"] + refused})

        return write

    def run(self, stream: str, rows: DataFrame, checkpoint: str) -> bool:
        """Forwards what is there; False if it was held, when the next run starts with the batch that was."""
        query = rows.writeStream.foreachBatch(self.sink(stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001 - Spark wraps what a task raised
            if "Held" in str(e):
                return False
            raise
        return True

    def tick(self, stream: str, rows: DataFrame, key: str, overlap_us: int = 2_000_000, limit: int = 500) -> bool:
        """One pass over a table without a stream: the next page from a little before the cursor, which moves once it was sent."""
        from zonelake.operators.store import tail

        done = self.cursor(stream)
        if done["ts_us"] is not None:
            rows = tail(rows, done["ts_us"], key, overlap_us, limit)
        else:
            rows = rows.orderBy("ts_us", "seq").limit(limit)
        try:
            taken, refused, newest = self.send(stream, rows)
        except Exception as e:  # noqa: BLE001
            if "Held" in str(e):
                return False
            raise
        last = max((t for t in (done["ts_us"], newest) if t is not None), default=None)
        self.records.write(f"{stream}.json", done | {"ts_us": last, "taken": done["taken"] + taken, "refused": done["refused"] + refused})
        return True
