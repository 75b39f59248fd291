"""Links fetched by tasks, from a server on this machine that answers as it is told."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from factloom.operators import grid
from factloom.sources import landing


@pytest.fixture
def server():
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            code = 404 if "missing" in self.path else 503 if "busy" in self.path and seen[self.path] < 3 or "never" in self.path else 200
            body = f"body of {self.path}".encode() if code == 200 else b""
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_each_link_has_its_own_fate(spark, tmp_path, server):
    base, seen = server
    urls = [f"{base}/f/{n}" for n in ("a.xlsx", "%E7%94%B2%20x.zip", "busy.ods", "never.csv", "missing", "g/a.xlsx?v=1", "g/a.xlsx?v=2", "")]
    urls += [f"{base}/many/{k}" for k in range(40)] + ["http://127.0.0.1:1/refused", "nonsense"]
    links = spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string")
    run = lambda: {r.url: r for r in landing.fetched(links, f"file://{tmp_path}/land", pause=0.01).collect()}
    rows = run()
    assert set(rows) == set(urls)
    good = [u for u in urls if rows[u].error is None]
    assert set(urls) - set(good) == {f"{base}/f/never.csv", f"{base}/f/missing", "http://127.0.0.1:1/refused", "nonsense"}
    for u in good:
        with open(rows[u].path, "rb") as f:
            data = f.read()
        assert data == f"body of {u.removeprefix(base)}".encode() and rows[u].n_bytes == len(data)
    assert len({rows[u].path for u in good}) == len(good) and rows[urls[1]].path.endswith("-甲_x.zip")
    assert (rows[f"{base}/f/busy.ods"].attempts, rows[f"{base}/f/never.csv"].attempts, rows[f"{base}/f/missing"].attempts) == (3, 3, 1)
    before = Counter(seen)
    again = run()
    assert all(again[u].attempts == 0 and again[u].path == rows[u].path for u in good)
    assert {p for p in seen if seen[p] > before[p]} == {"/f/never.csv", "/f/missing"}
    assert not [p for p in (tmp_path / "land").iterdir() if p.name.endswith(".part")]


def test_no_links(spark, tmp_path):
    assert landing.fetched(spark.createDataFrame([], "url string"), f"file://{tmp_path}/land").count() == 0


def test_links_of_pages(spark):
    html = '<a href="/a/b%20c.xlsx?x=1#y">1</a><a href="d/">2</a> <a href="100%.zip">3</a><a href="">4</a>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_url int, html string")
    found = [(r.page_url, r.pos, r.url, r.name) for r in grid.page_links(pages).orderBy("page_url", "pos").collect()]
    assert found == [(1, 0, "/a/b%20c.xlsx?x=1#y", "b c.xlsx"), (1, 1, "d/", ""), (1, 2, "100%.zip", None)]
