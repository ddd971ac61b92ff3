"""Remote documents as a data source: the rows of fetch_documents(), hosts apart and in their own time."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.sources import remote
from docweave.sources.policy import SourcePolicy
from docweave.sources.reader import host_of, register_remote_documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import test modules
POLICY = SourcePolicy(allowed_hosts=("*.example", "b.test"), connect_timeout=0.5)


def fake_resolver(host, port):
    if host.startswith("none"):
        raise remote.Refused(502, "unresolved")
    return {"private.example": ["10.0.0.1"], "mixed.example": ["93.184.216.34", "127.0.0.1"], "empty.example": []}.get(host, ["93.184.216.34"])


def fake_fetch(url, policy, resolver):
    """The real checks, and an answer without a connection."""
    _, host, port, target, normal = remote.check_url(url, policy)
    remote.public_addresses(host, port, resolver)
    content = b"%PDF-1.7" if target.endswith("pdf") else f"{time.monotonic()}".encode()
    return {"content": content, "file_type": "pdf" if target.endswith("pdf") else "png", "filename": "d.png", "size": len(content), "final_url": normal}


URLS = [
    "https://a.example/x.pdf", "https://A.example./y", "https://b.test/1", "https://b.test/2", "https://b.test/3", "http://a.example/", "https://other.test/", "https://private.example/",
    "https://mixed.example/", "https://empty.example/", "https://none.example/", "https://u:p@a.example/", "https://a.example/#x", "https://[::1", "", None, "nonsense", "https://a.example/x.pdf",
]


@pytest.fixture
def listed(spark, tmp_path):
    path = str(tmp_path / "urls")
    spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)], "doc_id long, url string, status string").repartition(3).write.parquet(path)
    register_remote_documents(spark, POLICY, fake_resolver, fake_fetch)
    return path


def rows(df):
    return sorted(tuple(r) for r in df.withColumn("content", F.when(F.col("file_type") == "pdf", F.col("content"))).withColumn("size", F.col("size") > 0).na.fill("-").collect())


def test_same_rows_as_fetched(spark, listed):
    got = spark.read.format("remote_documents").option("partitions", "3").load(listed)
    want = remote.fetch_documents(spark.read.parquet(listed), POLICY, resolver=fake_resolver, fetcher=fake_fetch)
    assert got.columns == want.columns and rows(got.drop("filename")) == rows(want.drop("filename"))
    found = {r.doc_id: (r.status, r.reason) for r in got.collect()}
    assert len(found) == len(URLS) and found[0] == (200, None) and found[7] == found[8] == (403, "prohibited_address") and found[10] == (502, "unresolved") and found[15] == (400, "invalid")
    images = spark.read.format("remote_documents").option("allowPdf", "false").load(f"file://{listed}").collect()
    assert {(r.status, r.reason) for r in images if r.doc_id in (0, 17)} == {(415, "images_only")}


def test_hosts_are_apart_and_in_their_own_time(spark, listed):
    got = spark.read.format("remote_documents").option("partitions", "4").option("hostInterval", "0.3").load(listed)
    seen = got.where("url like 'https://b.test/%'").select(F.col("content").cast("string").cast("double").alias("at"), F.spark_partition_id().alias("task")).collect()
    times = sorted(r.at for r in seen)
    assert len({r.task for r in seen}) == 1 and all(b - a >= 0.29 for a, b in zip(times, times[1:], strict=False))
    assert host_of("https://A.example./y") == "a.example" and host_of(None) == host_of("https://[::1") == ""


def test_a_path_is_needed(spark):
    register_remote_documents(spark)
    with pytest.raises(Exception, match="needs the path"):
        spark.read.format("remote_documents").load().collect()
