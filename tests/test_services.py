"""The static server, the command line and the incremental append."""

import threading
import urllib.error
import urllib.request

import pytest

from pointmill.sources import serve


@pytest.mark.parametrize(
    "header,want",
    [("bytes=0-99", (0, 99)), ("bytes=500-", (500, 999)), ("bytes=-100", (900, 999)), ("bytes=900-2000", (900, 999)), ("bytes=1000-", None), ("bytes=0-10,20-30", None), ("chunks=0-10", None), (None, None)],
)
def test_parse_range(header, want):
    assert serve.parse_range(header, 1000) == want


def test_server(tmp_path):
    (tmp_path / "a.json").write_bytes(b"0123456789")
    s = serve.server(str(tmp_path), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    try:
        ask = lambda path, **kw: urllib.request.urlopen(urllib.request.Request(base + path, **kw), timeout=10)
        with ask("/a.json", headers={"Range": "bytes=2-4"}) as r:
            assert (r.status, r.read(), r.headers["Content-Range"], r.headers["Content-Type"]) == (206, b"234", "bytes 2-4/10", "application/json")
        with ask("/a.json", method="HEAD") as r:
            assert r.headers["Content-Length"] == "10" and r.read() == b""
        with ask("/a.json", method="OPTIONS") as r:
            assert r.status == 204 and r.headers["Access-Control-Allow-Origin"] == "*"
        with ask("/") as r:
            assert r.read() == b"a.json"
        for path, headers, code in (("/../etc/passwd", {}, 404), ("/%2e%2e/%2e%2e/etc/passwd", {}, 404), ("/none", {}, 404), ("/a.json", {"Range": "bytes=10-"}, 416)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(path, headers=headers)
            assert e.value.code == code
    finally:
        s.shutdown()


def test_arguments():
    from pointmill import cli

    a = cli.parser().parse_args(["--json", "convert", "a.las", "b.e57", "-o", "out", "-f", "ept"])
    assert (a.inputs, a.span, a.leaf, a.format) == (["a.las", "b.e57"], 128, 50_000, "ept")
    assert cli.parser().parse_args(["snapshot", "x", "-o", "y"]).azimuth == 225.0


def test_append(spark, tmp_path):
    from pointmill.streaming import append as stream

    def arrive(k):
        spark.createDataFrame([(float(i), float(i % 7), float(k)) for i in range(64)], "wx double, wy double, wz double").write.mode("append").parquet(f"{tmp_path}/in")

    def take():
        stream.append(spark, f"{tmp_path}/in", "wx double, wy double, wz double", f"{tmp_path}/out", f"{tmp_path}/ck", [0.01] * 3, [0.0] * 3, 64.0, 2).awaitTermination()
        return stream.changed_cells(spark, f"{tmp_path}/out").agg({"points": "sum"}).first()[0]

    arrive(0)
    assert take() == 64
    arrive(1)
    assert take() == 128 == take()


def test_http(spark, tmp_path):
    from pointmill.operators import diagnose
    from pointmill.sources import http

    (tmp_path / "octree.bin").write_bytes(bytes(range(256)))
    s = serve.server(str(tmp_path), port=0, cache=60)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}/octree.bin"
    try:
        assert http.read_range(url, 10, 3) == b"\x0a\x0b\x0c" and http.size_of(url) == 256
        with pytest.raises(OSError):
            http.read_range(url, 300, 3)
        found = diagnose.transport_findings(http.probe(spark, [url, url + "x"]), ["url"], "https://example.com")
        codes = {(r.url == url, r.level, r.code) for r in found.collect()}
        assert {(True, "pass", "range"), (True, "pass", "cors"), (False, "fail", "payload-missing")} <= codes
        assert not [c for c in codes if c[0] and c[1] != "pass"]
        assert sorted(r.exit_code for r in diagnose.exit_codes(found, ["url"]).collect()) == [0, 1]
    finally:
        s.shutdown()
    assert http.split_target("https://h/a/metadata.json?x=1") == ("https://h/a", "metadata.json")
    assert http.split_target("https://h/a/b/") == ("https://h/a/b", "")
