"""Ranged reads over HTTP, and probes of how a server answers."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession

PROBE_BYTES = 16
PROBE_SCHEMA = "url string, status int, body_length int, encoding string, allow_origin string, expose string, preflight int, cache string, seconds double, error string"


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def split_target(url: str) -> tuple[str, str]:
    """(folder, name); a query string is dropped, and a name without a dot is a folder."""
    parts = urlsplit(url)
    folder, _, name = parts.path.rpartition("/")
    if "." not in name:
        folder, name = parts.path.rstrip("/"), ""
    return urlunsplit((parts.scheme, parts.netloc, folder, "", "")), name


def _ask(url: str, method: str = "GET", headers: dict[str, str] | None = None, timeout: float = 30.0):
    request = urllib.request.Request(url, method=method, headers=headers or {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers, e.read()


def read_range(url: str, start: int, length: int, timeout: float = 30.0, ask=_ask) -> bytes:
    """Exactly the asked bytes: only an answer of 206 counts."""
    status, _, body = ask(url, "GET", {"Range": f"bytes={start}-{start + length - 1}", "Accept-Encoding": "identity"}, timeout)
    if status != 206:
        raise OSError(f"{url}: {status} for a range")
    if len(body) != length:
        raise EOFError(f"{url}: {length} bytes asked, {len(body)} came")
    return body


def size_of(url: str, timeout: float = 30.0, ask=_ask) -> int:
    """The size that the answer to a one-byte range states."""
    status, headers, _ = ask(url, "GET", {"Range": "bytes=0-0", "Accept-Encoding": "identity"}, timeout)
    total = (headers.get("Content-Range") or "").rpartition("/")[2]
    if status == 404:
        raise FileNotFoundError(url)
    if status != 206 or not total.isdigit():
        raise OSError(f"{url}: no size ({status})")
    return int(total)


def exists(url: str, timeout: float = 30.0, ask=_ask) -> bool:
    return ask(url, "HEAD", {}, timeout)[0] == 200


def probe(spark: SparkSession, urls: list[str], origin: str = "https://example.com", timeout: float = 30.0, ask=_ask) -> DataFrame:
    """One row per url: how it answers a range from another origin, and a preflight; only an error if it cannot be reached."""
    rows = []
    for url in urls:
        start = time.monotonic()
        try:
            status, h, body = ask(url, "GET", {"Range": f"bytes=0-{PROBE_BYTES - 1}", "Origin": origin}, timeout)
        except OSError as e:
            rows.append((url, None, None, None, None, None, None, None, time.monotonic() - start, str(e)))
            continue
        took = time.monotonic() - start
        preflight, _, _ = ask(url, "OPTIONS", {"Origin": origin, "Access-Control-Request-Method": "GET", "Access-Control-Request-Headers": "range"}, timeout)
        rows.append((url, status, len(body), h.get("Content-Encoding"), h.get("Access-Control-Allow-Origin"), h.get("Access-Control-Expose-Headers"), preflight, h.get("Cache-Control"), took, None))
    return spark.createDataFrame(rows, PROBE_SCHEMA)
