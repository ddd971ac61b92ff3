"""spark.read.format("remote_documents"): documents of listed URLs as a data source, hosts kept apart."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from docweave.sources.policy import SourcePolicy
from docweave.sources.remote import DOCUMENT, KINDS, Fetcher, Resolver, answer, fetch, resolve

FORMAT = "remote_documents"


def host_of(url: str | None) -> str:
    """The host that a URL names, as it is spelt; empty without one."""
    try:
        return (urlsplit((url or "").strip()).hostname or "").rstrip(".").lower()
    except ValueError:
        return ""


class _Reader(DataSourceReader):
    """Partitions by host: all URLs of a host are read by one task, one after the other."""

    def __init__(self, options: dict[str, str], policy: SourcePolicy, resolver: Resolver, fetcher: Fetcher) -> None:
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError(f"{FORMAT} needs the path of a Parquet table of doc_id and url")
        self.path, self.columns = options["path"], (options.get("idcolumn", "doc_id"), options.get("urlcolumn", "url"))
        self.parts = int(options.get("partitions", "8"))
        self.interval = float(options.get("hostinterval", "0"))
        self.allow_pdf = options.get("allowpdf", "true").lower() == "true"
        self.policy, self.resolver, self.fetcher = policy, resolver, fetcher

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        asked: dict[str, float] = {}
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=list(self.columns)):
            for ident, url in zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True):
                host = host_of(url)
                if zlib.crc32(host.encode()) % self.parts != partition.value:
                    continue
                wait = asked.get(host, 0.0) + self.interval - time.monotonic() if self.interval and host else 0
                if wait > 0 and host in asked:
                    time.sleep(wait)
                asked[host] = time.monotonic()
                status, reason, found = answer(url, self.policy, self.resolver, self.fetcher, self.allow_pdf)
                values = [pa.array([ident], pa.int64()), pa.array([url], pa.string()), pa.array([status], pa.int32()), pa.array([reason], pa.string())]
                values += [pa.array([found.get(k)], t) for k, t in KINDS.items()]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "url", "status", "reason", *KINDS])


def register_remote_documents(spark: SparkSession, policy: SourcePolicy = SourcePolicy(), resolver: Resolver = resolve, fetcher: Fetcher = fetch) -> None:
    """Make spark.read.format("remote_documents").load(path) give what fetch_documents() gives for the URLs listed at path.

    path is a Parquet table with doc_id (a whole number) and url, on a store that all executors read; idColumn and urlColumn
    name other columns. Each of `partitions` tasks reads the list and fetches the hosts that fall to it, so no two
    tasks ask one host, and a host gets a request every hostInterval seconds at most. allowPdf false refuses PDFs. The
    list never passes through the driver, and a task holds one document at a time. A lost task fetches its hosts again.
    """

    class RemoteDocuments(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return f"doc_id long, {DOCUMENT}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(dict(self.options), policy, resolver, fetcher)

    spark.dataSource.register(RemoteDocuments)
