import json
import threading
import urllib.error
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from cloudform.sources import rest


class Pages(BaseHTTPRequestHandler):
    seen: set = set()

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        at = 0 if q.get("cursor", "*") == "*" else int(q["cursor"])
        first = (q["year"], at) not in self.seen
        self.seen.add((q["year"], at))
        if first and at == 2:  # every second page is refused once
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        ids = list(range(int(q["n"])))[at : at + int(q["per-page"])]
        more = str(at + len(ids)) if at + len(ids) < int(q["n"]) else None
        body = json.dumps({"results": [{"id": i, "year": int(q["year"])} for i in ids], "meta": {"next_cursor": more, "count": int(q["n"])}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/works"
    s.shutdown()


def test_all_pages_of_all_partitions(spark, url):
    df = rest.read_pages(spark, url, [{"year": 2001, "n": 5}, {"year": 2002, "n": 0}, {"year": 2003, "n": 2}], size=2, rate=1000)
    r = df.select("part", F.from_json("record", "id int, year int").alias("r")).select("part", "r.*").collect()
    assert sorted((x.part, x.id, x.year) for x in r) == [(0, i, 2001) for i in range(5)] + [(2, i, 2003) for i in range(2)]


def test_count_and_limit(url):
    assert rest.count(url, {"year": 1, "n": 7}) == 7
    assert len(list(rest.pages(url, {"year": 2, "n": 9}, size=2, rate=1000, limit=5, sleep=lambda s: None))) == 5


def failing(code, after=None):
    def get(url, timeout):
        raise urllib.error.HTTPError(url, code, "", {"Retry-After": after} if after else {}, None)

    return get


def test_pauses_grow_keep_to_the_header_and_end():
    for get, want in ((failing(503), [1, 2, 4, 8, 16, 32, 60]), (failing(429, "900"), [60] * 7), (failing(429, "3"), [3] * 7)):
        slept = []
        with pytest.raises(RuntimeError, match="after 8 tries"):
            rest.fetch("http://x/?api_key=secret", get=get, sleep=slept.append)
        assert slept == want


def test_other_errors_end_at_once_and_hide_keys():
    with pytest.raises(RuntimeError) as e:
        rest.fetch("http://x/?api_key=secret", get=failing(403), sleep=lambda s: None)
    assert "secret" not in str(e.value) and "403" in str(e.value)
