"""Documents fetched from URLs: policy, public addresses only, pinned connections, bounded redirects, sizes and times."""

from __future__ import annotations

import http.client
import ipaddress
import re
import socket
import ssl
import time
import unicodedata
from collections.abc import Callable, Iterator
from email.message import Message
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.policy import EXTENSION_OF, SIGNATURES, SourcePolicy, is_public_address

REDIRECTS = (301, 302, 303, 307, 308)
CHUNK = 64 << 10
ACCEPT = "application/pdf,image/*;q=0.9,application/octet-stream;q=0.5"
DEFAULT_PORTS = {"https": 443, "http": 80}

Resolver = Callable[[str, int], list[str]]


class Refused(Exception):
    """A document that is not fetched: an HTTP status and a reason."""

    def __init__(self, status: int, reason: str) -> None:
        super().__init__(reason)
        self.status, self.reason = status, reason


def resolve(host: str, port: int) -> list[str]:
    """The addresses of a host, in the resolver's order, each once."""
    try:
        found = socket.getaddrinfo(host, port, socket.AF_UNSPEC, socket.SOCK_STREAM, socket.IPPROTO_TCP)
    except OSError as error:
        raise Refused(502, "unresolved") from error
    return list(dict.fromkeys(str(x[4][0]).split("%", 1)[0] for x in found))


def check_url(url: str | None, policy: SourcePolicy) -> tuple[str, str, int, str, str]:
    """(scheme, host, port, target, normalised URL) of a URL that the policy allows; the host in its ASCII form."""
    value = (url or "").strip()
    if not value or len(value) > policy.max_url_length or re.search(r"[\x00-\x20\x7f]", value):
        raise Refused(400, "invalid")
    try:
        parts = urlsplit(value)
        port = parts.port
    except ValueError as error:
        raise Refused(400, "invalid") from error
    scheme = parts.scheme.lower()
    if scheme not in (("https", "http") if policy.allow_http else ("https",)):
        raise Refused(403, "scheme")
    if parts.username is not None or parts.password is not None or parts.fragment:
        raise Refused(403, "credentials_or_fragment")
    try:
        host = (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
    except UnicodeError as error:
        raise Refused(400, "hostname") from error
    if not host or "%" in host:
        raise Refused(400, "hostname")
    port = port or DEFAULT_PORTS[scheme]
    if port not in policy.allowed_ports:
        raise Refused(403, "port")
    inside = (host.endswith(p[1:]) if p.startswith("*.") else host == p for p in policy.allowed_hosts)
    if policy.allowed_hosts and not any(inside):
        raise Refused(403, "host_not_allowed")
    shown = f"[{host}]" if ":" in host else host
    if port != DEFAULT_PORTS[scheme]:
        shown = f"{shown}:{port}"
    path = parts.path or "/"
    return scheme, host, port, urlunsplit(("", "", path, parts.query, "")), urlunsplit((scheme, shown, path, parts.query, ""))


def public_addresses(host: str, port: int, resolver: Resolver) -> list[str]:
    """All addresses of a host; one that is not public refuses the host, whatever the others are."""
    found = resolver(host, port)
    if not found:
        raise Refused(502, "unresolved")
    for address in found:
        try:
            ipaddress.ip_address(address)
        except ValueError as error:
            raise Refused(502, "invalid_address") from error
        if not is_public_address(address):
            raise Refused(403, "prohibited_address")
    return found


class _Pinned(http.client.HTTPConnection):
    """A connection to one address that was checked, whatever the name resolves to by now."""

    def __init__(self, scheme: str, host: str, address: str, port: int, connect: float, read: float) -> None:
        super().__init__(host, port, timeout=connect)
        self._scheme, self._address, self._read = scheme, address, read

    def connect(self) -> None:
        self.sock = socket.create_connection((self._address, self.port), self.timeout)
        if self._scheme == "https":
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)
        self.sock.settimeout(self._read)


def file_kind(header: bytes) -> str | None:
    """The file type by its first bytes."""
    for kind, signature in SIGNATURES:
        if header.startswith(bytes.fromhex(signature)):
            return kind
    return "webp" if header[:4] == b"RIFF" and header[8:12] == b"WEBP" else None


def canonical_filename(name: str | None, kind: str) -> str:
    """A plain file name of 100 characters at most with the type's extension; document without a usable one."""
    plain = unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode().replace("/", " ").replace("\\", " ")
    plain = re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(plain.split())).strip("._")
    stem = re.sub(r"\.[A-Za-z0-9]{1,8}$", "", plain).strip("._-") or "document"
    return f"{stem[:100]}.{EXTENSION_OF[kind]}"


def remote_name(url: str, disposition: str | None) -> str:
    """The name that the response gives, else the last part of the URL's path."""
    header = Message()
    header["Content-Disposition"] = disposition or "inline"
    return header.get_filename() or unquote(urlsplit(url).path).rsplit("/", 1)[-1]


def _open(scheme: str, host: str, port: int, target: str, shown: str, addresses: list[str], policy: SourcePolicy, left: float) -> tuple:
    """Connection and response of the first address that answers."""
    timed_out = False
    for address in addresses:
        pinned = _Pinned(scheme, host, address, port, min(policy.connect_timeout, left), min(policy.read_timeout, left))
        try:
            pinned.request("GET", target, headers={"Accept": ACCEPT, "Host": shown, "User-Agent": "docweave/1.0"})
            return pinned, pinned.getresponse()
        except (OSError, http.client.HTTPException) as error:
            timed_out = isinstance(error, TimeoutError)
            pinned.close()
    raise Refused(504, "timeout") if timed_out else Refused(502, "unreachable")


def _body(response: http.client.HTTPResponse, policy: SourcePolicy, deadline: float) -> bytes:
    if (response.headers.get("Content-Encoding") or "").strip().lower() not in ("", "identity"):
        raise Refused(502, "compressed")
    declared = response.headers.get("Content-Length") or ""
    if declared.isdigit() and int(declared) > policy.max_upload_bytes:
        raise Refused(413, "too_large")
    parts, size = [], 0
    try:
        while part := response.read(CHUNK):
            size += len(part)
            if size > policy.max_upload_bytes:
                raise Refused(413, "too_large")
            if time.monotonic() >= deadline:
                raise Refused(504, "timeout")
            parts.append(part)
    except TimeoutError as error:
        raise Refused(504, "timeout") from error
    except (OSError, http.client.HTTPException) as error:
        raise Refused(502, "unreadable") from error
    if not size:
        raise Refused(422, "empty")
    return b"".join(parts)


def fetch(url: str | None, policy: SourcePolicy = SourcePolicy(), resolver: Resolver = resolve) -> dict:
    """One document: content, file_type, filename, size, final_url. Raises Refused."""
    if not policy.url_enabled:
        raise Refused(403, "disabled")
    deadline, at, secure, seen = time.monotonic() + policy.total_timeout, url, False, set()
    for _ in range(policy.max_redirects + 1):
        scheme, host, port, target, normal = check_url(at, policy)
        addresses = public_addresses(host, port, resolver)
        if secure and scheme != "https":
            raise Refused(403, "downgrade")
        if normal in seen:
            raise Refused(502, "redirect_loop")
        seen.add(normal)
        left = deadline - time.monotonic()
        if left <= 0:
            raise Refused(504, "timeout")
        pinned, response = _open(scheme, host, port, target, urlsplit(normal).netloc, addresses, policy, left)
        try:
            if response.status in REDIRECTS:
                location = response.headers.get("Location")
                if not location:
                    raise Refused(502, "bad_redirect")
                at, secure = urljoin(normal, location), scheme == "https"
                continue
            if not 200 <= response.status < 300:
                raise Refused(502, "unsuccessful")
            content = _body(response, policy, deadline)
        finally:
            pinned.close()
        kind = file_kind(content[:16])
        if kind is None:
            raise Refused(415, "unsupported_type")
        name = canonical_filename(remote_name(normal, response.headers.get("Content-Disposition")), kind)
        return {"content": content, "file_type": kind, "filename": name, "size": len(content), "final_url": normal}
    raise Refused(502, "too_many_redirects")


Fetcher = Callable[[str | None, SourcePolicy, Resolver], dict]
#: What is known of a document beside its status and reason.
KINDS = {"content": pa.binary(), "file_type": pa.string(), "filename": pa.string(), "size": pa.int64(), "final_url": pa.string()}


def answer(url: str | None, policy: SourcePolicy, resolver: Resolver, fetcher: Fetcher, allow_pdf: bool) -> tuple[int, str | None, dict]:
    """(status, reason, document) of a URL; the document is empty unless the status is 200."""
    try:
        found = fetcher(url, policy, resolver)
        if found["file_type"] == "pdf" and not allow_pdf:
            raise Refused(415, "images_only")
        return 200, None, found
    except Refused as refused:
        return refused.status, refused.reason, {}


def fetch_documents(
    urls: DataFrame, policy: SourcePolicy = SourcePolicy(), id_col: str = "doc_id", url_col: str = "url", allow_pdf: bool = True,
    resolver: Resolver = resolve, fetcher: Fetcher = fetch,
) -> DataFrame:
    """One row per URL: doc_id, url, status (200, else the HTTP status of the refusal), reason, and the document.

    Only public addresses are asked, each connection goes to an address that was checked, and every redirect is
    checked again. A task holds one document at a time. Null and empty URLs are invalid (400). No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                status, reason, found = answer(batch.column(1)[i].as_py(), policy, resolver, fetcher, allow_pdf)
                row = [pa.array([status], pa.int32()), pa.array([reason], pa.string())]
                row += [pa.array([found.get(k)], t) for k, t in KINDS.items()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *row], ["doc_id", "url", "status", "reason", *KINDS]
                )

    narrow = urls.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("url"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, {DOCUMENT}")


#: The columns of a fetched document after its id.
DOCUMENT = "url string, status int, reason string, content binary, file_type string, filename string, size long, final_url string"
