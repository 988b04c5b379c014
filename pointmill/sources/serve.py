"""A static server for clouds: GET, HEAD and OPTIONS, single byte ranges, open CORS, no content encoding."""

from __future__ import annotations

import argparse
import os
import re
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from pointmill.functions.text import CONTENT_TYPES

_RANGE = re.compile(r"^bytes=(\d*)-(\d*)$")


def parse_range(header: str | None, size: int) -> tuple[int, int] | None:
    """First and last byte of a single range within the size; None for any other header."""
    m = _RANGE.match(header or "")
    if not m or m[0] == "bytes=-":
        return None
    if not m[1]:
        first, last = max(size - int(m[2]), 0), size - 1
    else:
        first, last = int(m[1]), min(int(m[2]), size - 1) if m[2] else size - 1
    return (first, last) if first <= last and first < size else None


def resolve(root: str, url: str) -> str | None:
    """The file or folder of a request inside the root, else None."""
    path = os.path.realpath(os.path.join(root, unquote(urlsplit(url).path).lstrip("/")))
    top = os.path.realpath(root)
    return path if path == top or path.startswith(top + os.sep) else None


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def __init__(self, *args, root: str, cors: str, cache: int, quiet: bool = True, **kwargs):
        self.root, self.cors, self.cache, self.quiet = root, cors, cache, quiet
        super().__init__(*args, **kwargs)

    def log_message(self, *args) -> None:
        if not self.quiet:
            super().log_message(*args)

    def _head(self, status: int, length: int, kind: str = "text/plain; charset=utf-8", more: dict[str, str] | None = None) -> None:
        self.send_response(status)
        headers = {"Content-Length": str(length), "Content-Type": kind, "Accept-Ranges": "bytes", "Cache-Control": f"max-age={self.cache}" if self.cache else "no-cache"}
        if self.cors:
            headers |= {"Access-Control-Allow-Origin": self.cors, "Access-Control-Expose-Headers": "Content-Range, Content-Length, Accept-Ranges"}
        for k, v in (headers | (more or {})).items():
            self.send_header(k, v)
        self.end_headers()

    def do_OPTIONS(self) -> None:
        self._head(204, 0, more={"Access-Control-Allow-Methods": "GET, HEAD, OPTIONS", "Access-Control-Allow-Headers": "Range, If-None-Match", "Access-Control-Max-Age": "86400"})

    def do_HEAD(self) -> None:
        self.do_GET(body=False)

    def do_GET(self, body: bool = True) -> None:
        path = resolve(self.root, self.path)
        if path is None or not os.path.exists(path):
            self._head(404, 0)
            return
        if os.path.isdir(path):
            names = sorted(n + "/" * os.path.isdir(os.path.join(path, n)) for n in os.listdir(path))
            data = "\n".join(names).encode()
            self._head(200, len(data))
            if body:
                self.wfile.write(data)
            return
        size = os.path.getsize(path)
        kind = CONTENT_TYPES.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")
        header = self.headers.get("Range")
        found = parse_range(header, size)
        if header and header.startswith("bytes=") and "," not in header and found is None:
            self._head(416, 0, more={"Content-Range": f"bytes */{size}"})
            return
        first, last = found or (0, size - 1)
        self._head(206 if found else 200, last - first + 1, kind, {"Content-Range": f"bytes {first}-{last}/{size}"} if found else None)
        if not body:
            return
        with open(path, "rb") as f:
            f.seek(first)
            left = last - first + 1
            while left > 0 and (part := f.read(min(left, 1 << 16))):
                self.wfile.write(part)
                left -= len(part)


def server(root: str = ".", host: str = "127.0.0.1", port: int = 8080, cors: str = "*", cache: int = 0) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), partial(Handler, root=root, cors=cors, cache=cache))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pointmill.sources.serve")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("-p", "--port", type=int, default=8080)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--cors", default="*")
    p.add_argument("--cache", type=int, default=0)
    a = p.parse_args(args)
    server(a.root, a.host, a.port, a.cors, a.cache).serve_forever()


if __name__ == "__main__":
    main()
