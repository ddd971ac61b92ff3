"""Ingest policy: file types by signature, upload checks, URL rules."""

from __future__ import annotations

import ipaddress
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# File signatures in order, and the extensions that go with them.
SIGNATURES = (
    ("pdf", "255044462D"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("tiff", "49492A00"), ("tiff", "4D4D002A"),
    ("bmp", "424D"),
)
EXTENSION_OF = {"pdf": "pdf", "jpeg": "jpg", "png": "png", "tiff": "tif", "bmp": "bmp", "webp": "webp"}
EXTENSIONS = {"pdf": "pdf", "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "webp": "webp"}


@dataclass(frozen=True)
class SourcePolicy:
    """Limits of the ingest; from_env() reads and clamps them."""

    max_upload_bytes: int = 20 << 20
    allow_http: bool = False
    allowed_ports: tuple[int, ...] = (443,)
    allowed_hosts: tuple[str, ...] = ()
    max_url_length: int = 2048
    url_enabled: bool = True
    connect_timeout: float = 3.0
    read_timeout: float = 8.0
    total_timeout: float = 20.0
    max_redirects: int = 3

    @staticmethod
    def from_env() -> SourcePolicy:
        http = boolean("DOCUMENT_URL_ALLOW_HTTP", False)
        return SourcePolicy(
            max_upload_bytes=bounded("DOCUMENT_MAX_UPLOAD_BYTES", 20 << 20, 1 << 10, 100 << 20),
            allow_http=http,
            allowed_ports=port_list("DOCUMENT_URL_ALLOWED_PORTS", (80, 443) if http else (443,)),
            allowed_hosts=host_list("DOCUMENT_URL_ALLOWED_HOSTS"),
            max_url_length=bounded("DOCUMENT_URL_MAX_LENGTH", 2048, 256, 8192),
            url_enabled=boolean("DOCUMENT_URL_ENABLED", True),
            connect_timeout=bounded("DOCUMENT_URL_CONNECT_TIMEOUT_SECONDS", 3.0, 0.5, 30.0),
            read_timeout=bounded("DOCUMENT_URL_READ_TIMEOUT_SECONDS", 8.0, 0.5, 60.0),
            total_timeout=bounded("DOCUMENT_URL_TOTAL_TIMEOUT_SECONDS", 20.0, 1.0, 120.0),
            max_redirects=bounded("DOCUMENT_URL_MAX_REDIRECTS", 3, 0, 10),
        )


def bounded[N: (int, float)](name: str, default: N, least: N, most: N) -> N:
    """An environment setting of the default's type, the default if it is no number, clamped."""
    try:
        value = type(default)(os.environ.get(name, default))
    except ValueError:
        value = default
    return min(max(value, least), most)


def boolean(name: str, default: bool) -> bool:
    """An environment switch: 1, true, yes and on are true, any other text is false."""
    raw = os.environ.get(name)
    return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on")


def port_list(name: str, default: tuple[int, ...]) -> tuple[int, ...]:
    """Distinct ports in order; any bad one gives the whole default."""
    parts = [p.strip() for p in os.environ.get(name, "").split(",") if p.strip()]
    if not parts or not all(p.isdigit() and 0 < int(p) < 65536 for p in parts):
        return default
    return tuple(dict.fromkeys(map(int, parts)))


def host_list(name: str) -> tuple[str, ...]:
    hosts = (h.strip().lower().rstrip(".") for h in os.environ.get(name, "").split(","))
    return tuple(dict.fromkeys(h for h in hosts if re.fullmatch(r"(\*\.)?[a-z0-9.-]+", h)))


def file_type(content: Column) -> Column:
    """pdf, jpeg, png, tiff, bmp or webp by the first bytes; null for others."""
    out = F.when(F.startswith(content, F.unhex(F.lit(SIGNATURES[0][1]))), SIGNATURES[0][0])
    for kind, signature in SIGNATURES[1:]:
        out = out.when(F.startswith(content, F.unhex(F.lit(signature))), kind)
    riff = F.startswith(content, F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    return out.when(riff, "webp")


def canonical_filename(name: Column, kind: Column) -> Column:
    """A plain file name with the type's extension, at most 100 characters before it; document without a usable one.

    Characters other than letters, digits, dots, hyphens and underscores go, blanks and slashes become underscores.
    """
    plain = F.regexp_replace(F.trim(F.regexp_replace(name, r"[/\\\s]+", " ")), " ", "_")
    plain = F.btrim(F.regexp_replace(plain, "[^A-Za-z0-9_.-]", ""), F.lit("._"))
    stem = F.btrim(F.regexp_replace(plain, r"\.[A-Za-z0-9]{1,8}$", ""), F.lit("._-"))
    extensions = F.create_map(*(F.lit(x) for pair in EXTENSION_OF.items() for x in pair))
    return F.concat(F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), 1, 100), F.lit("."), F.try_element_at(extensions, kind))


def inspect_uploads(
    files: DataFrame, policy: SourcePolicy = SourcePolicy(), allow_pdf: bool = True, match_extension: bool = True
) -> DataFrame:
    """Add file_type, status (HTTP: 200, 400, 413, 415, 422), warning and canonical_name to (filename, content).

    A name is required; an empty file, one over the limit, an unknown signature and a PDF where only images go are
    refused in this order. With match_extension so is a PDF named as an image and an image named as a PDF; images
    under another image's name pass, and canonical_name says what they are. An unknown extension is a warning.
    """
    kind = file_type(F.col("content"))
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]{1,8})$", 1))
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    status = (
        F.when(F.coalesce(F.trim("filename"), F.lit("")) == "", 400)
        .when(size <= 0, 422)
        .when(size > policy.max_upload_bytes, 413)
        .when(kind.isNull(), 415)
        .when((kind == "pdf") & F.lit(not allow_pdf), 415)
        .when(F.lit(match_extension) & F.coalesce((F.try_element_at(known, ext) == "pdf") != (kind == "pdf"), F.lit(False)), 415)
        .otherwise(200)
    )
    odd = (ext != "") & F.try_element_at(known, ext).isNull()
    name = F.when(status == 200, canonical_filename(F.col("filename"), kind))
    return files.withColumns({"file_type": kind, "status": status, "warning": F.when(odd, "unknown_extension"), "canonical_name": name})


def check_urls(urls: DataFrame, policy: SourcePolicy = SourcePolicy(), url_col: str = "url") -> DataFrame:
    """Add status (HTTP: 200, 400, 403), reason and normalized_url; syntax and policy only, no lookup.

    Scheme, host and port are lower-cased and the default port is left out. Credentials and fragments, schemes and
    ports that are not allowed, and hosts outside the list (exact or *.suffix, the suffix itself not) are refused.
    """
    value = F.trim(F.coalesce(F.col(url_col), F.lit("")))
    part = lambda pattern, group=1: F.regexp_extract(value, pattern, group)
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme, netloc, path, query, fragment = F.lower(part(whole)), part(whole, 2), part(whole, 3), part(whole, 4), part(whole, 5)
    host = F.lower(F.regexp_replace(F.regexp_extract(netloc, r"^(\[[^\]]*\]|[^:]*)(:\d*)?$", 1), r"\.+$", ""))
    default = F.when(scheme == "https", 443).otherwise(80)
    port = F.coalesce(F.regexp_extract(netloc, r":(\d{1,5})$", 1).try_cast("int"), default)
    schemes = ["https", "http"] if policy.allow_http else ["https"]
    allowed = F.lit(not policy.allowed_hosts)
    for pattern in policy.allowed_hosts:
        match = F.endswith(host, F.lit(pattern[1:])) if pattern.startswith("*.") else host == pattern
        allowed = allowed | match
    odd = (value == "") | (F.length(value) > policy.max_url_length) | F.regexp_like(value, F.lit(r"[\x00-\x20\x7f]"))
    reason = (
        F.when(odd | ~F.regexp_like(value, F.lit(whole)), "invalid")
        .when(~scheme.isin(*schemes), "scheme")
        .when(F.contains(netloc, F.lit("@")) | (F.length(fragment) > 1), "credentials_or_fragment")
        .when((host == "") | F.contains(host, F.lit("%")), "hostname")
        .when(~port.isin(*policy.allowed_ports), "port")
        .when(~allowed, "host_not_allowed")
    )
    status = F.when(reason.isNull(), 200).when(reason.isin("invalid", "hostname"), 400).otherwise(403)
    shown = F.concat(host, F.when(port == default, "").otherwise(F.concat(F.lit(":"), port)))
    normal = F.concat(scheme, F.lit("://"), shown, F.when(path == "", "/").otherwise(path), F.when(F.length(query) > 1, query).otherwise(""))
    return urls.withColumns({"status": status, "reason": reason, "normalized_url": F.when(reason.isNull(), normal)})


def is_public_address(address: str | None) -> bool:
    """Whether an IP address, or the IPv4 one mapped in it, is global."""
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    mapped = getattr(ip, "ipv4_mapped", None)
    return (mapped or ip).is_global and not ip.is_multicast


@F.pandas_udf(BooleanType())
def all_public(addresses: pd.Series) -> pd.Series:
    """Whether every resolved address is global; false for none."""
    return addresses.map(lambda a: a is not None and len(a) > 0 and all(map(is_public_address, a)))


def read_binary_files(spark, path: str, policy: SourcePolicy = SourcePolicy()) -> DataFrame:
    """A folder of uploads through the binaryFile source, inspected."""
    files = spark.read.format("binaryFile").load(path)
    return inspect_uploads(files.withColumn("filename", F.element_at(F.split("path", "/"), -1)), policy)


class OcrBackend:
    """The boundary to an OCR or PDF engine: subclasses return boxes of a document's pages. This one has none."""

    def pages(self, content: bytes, kind: str) -> list[list[tuple[float, float, float, str]]]:
        return []


def ocr_boxes(files: DataFrame, backend: OcrBackend) -> DataFrame:
    """(doc_id, page_number, y, x, h, text) for the files that passed inspection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, n, *box)
                for doc, content, kind in zip(batch["doc_id"], batch["content"], batch["file_type"], strict=True)
                for n, page in enumerate(backend.pages(content, kind), 1)
                for box in page
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "y", "x", "h", "text"])

    accepted = files.where("status = 200").select("doc_id", "content", "file_type")
    return accepted.mapInPandas(run, "doc_id long, page_number int, y double, x double, h double, text string")
