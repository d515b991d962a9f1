import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from anemos.sources.remote import reanalysis_near, read_series

START = datetime(2020, 1, 1)


class Service(BaseHTTPRequestHandler):
    asked: list = []
    busy: dict = {}

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append((q["node"], q["date_from"], q["date_to"]))
        if Service.busy.get(q["node"], 0) > 0:
            Service.busy[q["node"]] -= 1
            self.send_response(503)
            self.end_headers()
            return
        if q["node"] == "none":
            self.send_response(404)
            self.end_headers()
            return
        a, b = (datetime.fromisoformat(q[k]) for k in ("date_from", "date_to"))
        hours = [a + timedelta(hours=i) for i in range(int((b - a) / timedelta(hours=1)) + 1)]  # one too many: the end is left to the reader
        if "json" in self.path:
            body = json.dumps([{"ts": t.isoformat(), "spd": t.hour + len(q["node"])} for t in hours])
        else:
            body = "ts,spd,dir\n" + "\n".join(f"{t},{t.hour + len(q['node'])},{'' if t.hour == 3 else 90}" for t in hours)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked, Service.busy = [], {}
    yield f"http://127.0.0.1:{server.server_port}/series?node={{node}}&date_from={{date_from}}&date_to={{date_to}}"
    server.shutdown()


def test_partitions_by_node_and_dates(spark, url):
    df = read_series(spark, url, ["a b", "cc", "none"], ["spd", "dir", "lacking"], START, START + timedelta(days=5), days=2)
    assert not Service.asked and df.columns == ["node", "ts", "spd", "dir", "lacking"]
    rows = df.collect()
    assert len(rows) == 2 * 120 and len({(r["node"], r["ts"]) for r in rows}) == 240
    assert sorted(n for n, *_ in Service.asked) == ["a b"] * 3 + ["cc"] * 3 + ["none"] * 3
    assert all(r["spd"] == r["ts"].hour + len(r["node"]) and r["lacking"] is None and (r["dir"] is None) == (r["ts"].hour == 3) for r in rows)


def test_filters_narrow_what_is_asked(spark, url):
    df = read_series(spark, url + "&json=1", ["a", "b", "c"], ["spd"], START, START + timedelta(days=300), days=10, format="json")
    got = df.where((F.col("ts") >= F.lit(datetime(2020, 3, 1)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(datetime(2020, 3, 3)).cast("timestamp_ntz")) & (F.col("node") == "b"))
    assert got.count() == 48
    assert set(Service.asked) == {("b", "2020-03-01T00:00:00", "2020-03-03T00:00:00")}


def test_a_busy_service_is_asked_again(spark, url):
    Service.busy = {"a": 3}
    df = read_series(spark, url, ["a"], ["spd"], START, START + timedelta(days=1), wait=0.01, retries=3)
    assert df.count() == 24 and len(Service.asked) == 4
    Service.busy = {"a": 100}
    with pytest.raises(Exception, match="503"):
        df.count()


def test_nearest_nodes(spark, url):
    nodes = spark.createDataFrame([("n1", 50.0, 0.0), ("far", 10.0, 0.0), ("n22", 50.5, 0.5)], "node string, latitude double, longitude double")
    got = reanalysis_near(spark, url, nodes, 50.1, 0.1, ["spd"], START, START + timedelta(days=1), nearest=2).groupBy("node").count()
    assert {r["node"]: r["count"] for r in got.collect()} == {"n1": 24, "n22": 24}
