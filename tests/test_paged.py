"""Paged services that cap, shift, can't count, fail or grow: nothing may be lost or doubled without an error."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from terravane.sources import paged


class Fake:
    """A service on this machine; its path says how it behaves."""

    def __init__(self):
        self.rows, self.asked, self.failing, self.broken = 5000, [], None, 0
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                p = {k: v[0] for k, v in parse_qs(at.query).items()}
                fake.asked.append((at.path, p))
                code, said = fake.answer(at.path, p)
                body = json.dumps(said).encode()
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, kind):
        return f"http://127.0.0.1:{self.server.server_port}/{kind}"

    def answer(self, kind, p):
        if "returnCountOnly" in p:
            return 200, {} if "countless" in kind else {"count": self.rows}
        first, n = int(p["resultOffset"]), int(p["resultRecordCount"])
        if self.failing is not None and first >= self.failing:
            self.broken += 1
            return 500, {}
        if "shifting" in kind and first >= 2000:
            self.rows -= 1
        n = min(n, 1000) if "capped" in kind else n + 7 if "generous" in kind else n
        last = min(first + n, 4321 if "losing" in kind else self.rows)
        some = [{"attributes": {"code": f"c{k}", "n": k}} for k in range(first, last)]
        if p.get("f") == "geojson":
            some = [{"type": "Feature", "properties": x["attributes"], "geometry": {"type": "Point", "coordinates": [x["attributes"]["n"], 1]}} for x in some]
        return 200, {"error": {"message": "no such layer"}} if "error" in kind else {"objectIdFieldName": "n", "exceededTransferLimit": last < self.rows, "features": some}


@pytest.fixture(scope="module")
def fake():
    f = Fake()
    yield f
    f.server.shutdown()


@pytest.fixture(autouse=True)
def fresh(fake):
    fake.rows, fake.asked, fake.failing, fake.broken = 5000, [], None, 0


def read(spark, fake, kind, limit=2000, schema="code string, n string", **more):
    return paged.read(spark, schema, url=fake.url(kind), service="terravane.sources.paged:Rest", limit=limit, **more)


@pytest.mark.parametrize("kind", ["plain", "capped", "generous", "countless", "capped-countless", "generous-capped"])
@pytest.mark.parametrize("limit", [2000, 700, 6000])
def test_all_rows_once(spark, fake, kind, limit):
    df = read(spark, fake, kind, limit)
    assert df.rdd.getNumPartitions() == (1 if "countless" in kind else -(-5000 // limit))
    assert sorted(int(r.n) for r in df.collect()) == list(range(5000))


@pytest.mark.parametrize("kind, said", [("losing", "missing"), ("shifting", "missing|began"), ("error", "no such layer"), ("losing-capped", "missing")])
def test_missing_rows_are_an_error(spark, fake, kind, said):
    with pytest.raises(Exception, match=said):
        read(spark, fake, kind).collect()


def test_no_rows_and_pushed_filters(spark, fake):
    fake.rows = 0
    assert read(spark, fake, "plain").collect() == [] and read(spark, fake, "countless").collect() == []
    fake.rows = 50
    got = read(spark, fake, "plain", where="n > 3").filter(F.col("code").isin("c7", "c49")).collect()
    assert sorted(r.code for r in got) == ["c49", "c7"]
    assert fake.asked[-1][1]["where"] == "(n > 3) AND code IN ('c7','c49')"
    with pytest.raises(Exception, match="positive"):
        read(spark, fake, "plain", 0).collect()


def test_envelope_shapes_and_single_answers(spark, fake):
    said = paged.envelope(spark, url=fake.url("capped"), service="terravane.sources.paged:Rest").first()
    assert (said.source_url, said.feature_count, json.loads(said.envelope)) == (fake.url("capped"), 5000, {"objectIdFieldName": "n", "exceededTransferLimit": True})
    assert paged.envelope(spark, url=fake.url("countless"), service="terravane.sources.paged:Rest").first().feature_count is None
    shapes = read(spark, fake, "capped", schema="n string, geometry string").filter("n = '4999'").first()
    assert json.loads(shapes.geometry) == {"type": "Point", "coordinates": [4999, 1]}
    single = lambda kind: spark.read.format("single_answer").schema("n string").options(url=fake.url(kind), service="terravane.sources.paged:Rest", limit=2000).load()
    with pytest.raises(Exception, match="more rows"):
        single("plain").collect()
    fake.rows = 1999
    assert single("plain").count() == 1999


def test_saved_pages(spark, tmp_path):
    for offset, size in ((0, 3), (3, 2), (5, 3)):  # a capped service's pages
        (tmp_path / f"page-{offset}.json").write_text(json.dumps({"fields": ["n"], "features": [{"attributes": {"n": k}} for k in range(offset, offset + size)]}))
    for limit in (1, 3, 4, 100):
        assert sorted(int(r.n) for r in paged.read(spark, "n string", path=str(tmp_path), limit=limit).collect()) == list(range(8))
    assert json.loads(paged.envelope(spark, path=str(tmp_path)).first().envelope) == {"fields": ["n"]}
    (tmp_path / "page-3.json").unlink()
    with pytest.raises(Exception, match="missing"):
        paged.read(spark, "n string", path=str(tmp_path), limit=3).collect()


def test_stream_goes_on_where_it_was_killed(spark, fake, tmp_path):
    paged.register(spark)
    fake.rows = 900

    def run():
        stream = spark.readStream.format("paged_features").schema("n string").options(url=fake.url("capped"), service="terravane.sources.paged:Rest", limit=100, most=400).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    there = lambda: sorted(int(r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    fake.failing = 600  # dies within the second batch
    with pytest.raises(Exception):
        run()
    assert there() == list(range(400)) and fake.broken
    fake.failing = None
    run()
    assert there() == list(range(900))
    fake.rows = 1250
    fake.asked.clear()
    run()
    assert there() == list(range(1250))
    assert min(int(p["resultOffset"]) for _, p in fake.asked if "resultOffset" in p) == 900  # nothing is read again
    fake.rows = 10
    with pytest.raises(Exception, match="had|missing"):
        run()
