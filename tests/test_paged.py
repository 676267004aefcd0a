"""The paged source against a small web server, and chains of stored pages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from paperlake.corpus import chains, complete
from paperlake.sources import paged as P

ITEMS = [{"id": i, "t": f"ü{i}"} for i in range(25)]


class Handler(BaseHTTPRequestHandler):
    calls: dict[str, int] = {}

    def log_message(self, *args):
        pass

    def do_GET(self):
        at, q = urlsplit(self.path), {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        self.calls[self.path] = self.calls.get(self.path, 0) + 1
        o, size = int(q.get("offset", 0)), int(q.get("limit", 10))
        page = {"results": ITEMS[o : o + size], "count": len(ITEMS)}
        name = at.path.strip("/")
        if name == "flaky" and self.calls[self.path] % 3:
            return self.send_error(503)
        if name == "gone":
            return self.send_error(404)
        if name == "short":
            page["count"] = 27
        if name == "more":
            page = {"results": ITEMS[o : o + size], "count": 20}
        if name == "uncounted":
            page = {"results": ITEMS[o : o + size]}
        if name == "odd":
            page = {"results": None}
        if name == "cursor":
            o = 0 if q["cursor"] == "*" else int(q["cursor"][1:])
            page = {"data": ITEMS[o : o + size], "meta": {"count": len(ITEMS), "next_cursor": f"c{o + size}" if o + size < len(ITEMS) else None}}
        if name in ("next", "loop", "foreign", "broken"):
            k = int(q.get("k", 0))
            page = {"results": ITEMS[5 * k : 5 * k + 5], "count": len(ITEMS), "next": f"?k={k + 1}" if k < 4 else None}
            if name == "loop" and k == 3:
                page["next"] = "/loop?k=1"
            if name == "foreign" and k == 2:
                page["next"] = "http://other.example.org/?k=3"
            if name == "broken" and k == 3 and Handler.calls.get("mended", 0) == 0:
                return self.send_error(500)
        body = json.dumps(page).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ids(df):
    return sorted((r.page, r.ord, json.loads(r.item)["id"]) for r in df.collect())


def test_ranges_of_pages(spark, site):
    df = P.paged(spark, [f"{site}/all?x=1"], page_size=10, pages_by_task=2, pause=0.01)
    assert df.rdd.getNumPartitions() == 2
    assert ids(df) == [(i // 10, i % 10, i) for i in range(25)]
    assert {r.item for r in df.limit(1).collect()} == {'{"id": 0, "t": "ü0"}'}
    assert ids(P.paged(spark, [f"{site}/flaky"], page_size=5, pause=0.01)) == [(i // 5, i % 5, i) for i in range(25)]
    assert len(ids(P.paged(spark, [f"{site}/uncounted"], page_size=10))) == 25
    assert len(ids(P.paged(spark, [f"{site}/all", f"{site}/uncounted"], page_size=25))) == 50


def test_cursors_and_next_links(spark, site):
    cursor = {"mode": "cursor", "items": "data", "total": "meta.count", "next": "meta.next_cursor", "page_size": 10}
    assert ids(P.paged(spark, [f"{site}/cursor"], **cursor)) == [(i // 10, i % 10, i) for i in range(25)]
    assert [r[2] for r in ids(P.paged(spark, [f"{site}/next"], mode="next"))] == list(range(25))


@pytest.mark.parametrize("name, mode, message", [
    ("loop", "next", "loop of pages"), ("foreign", "next", "another host"), ("short", "offset", "items of 7 in pages"), ("more", "offset", "25 items of 20"),
    ("odd", "offset", "no list of items"), ("gone", "offset", "404"),
])
def test_what_is_not_a_whole_listing(spark, site, name, mode, message):
    with pytest.raises(Exception, match=message):
        P.paged(spark, [f"{site}/{name}"], mode=mode, page_size=10, pages_by_task=2 if name == "short" else 20, pause=0.01).collect()


def test_a_stream_goes_on_where_it_stopped(spark, site, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        source = P.paged_stream(spark, [f"{site}/broken"], mode="next", pages_by_batch=2, retries=1, pause=0.01)
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="HTTP|500|Server"):
        run()
    first = ids(spark.read.parquet(out))
    assert [r[2] for r in first] == list(range(10))
    seen = Handler.calls.get("/broken", 0)
    Handler.calls["mended"] = 1
    run()
    assert [r[2] for r in ids(spark.read.parquet(out))] == list(range(25))
    assert Handler.calls.get("/broken", 0) == seen  # the first page is not fetched again


def test_loops_are_found_however_long(monkeypatch):
    """Tails and loops of all small sizes, with one remembered address."""
    for tail in range(6):
        for loop in range(1, 6):
            client = P.Client({"url": "http://h/0", "mode": "next"})
            step = lambda k, tail=tail, loop=loop: k + 1 if k + 1 < tail + loop else tail
            monkeypatch.setattr(client, "fetch", lambda a, step=step: ([1], {"next": f"http://h/{step(int(a.rpartition('/')[2]))}"}))
            walk = P.Walk("http://h/0")
            with pytest.raises(P.IncompleteListing):
                for _ in range(4 * (tail + loop) + 4):
                    walk.step(client, "http://h/0")


def pages(spark, links, listing="a"):
    rows = [(listing, f"h/{u}", None if n is None else n if "/" in n else f"h/{n}", 2) for u, n in links]
    return spark.createDataFrame(rows, "listing string, url string, next string, items long")


def test_chains_of_stored_pages(spark):
    cases = {
        "whole": ([("a", "b"), ("b", "c"), ("c", None)], None), "one": ([("a", None)], None), "beside": ([("a", "b"), ("b", None), ("c", "d"), ("d", "c")], "beside the chain"),
        "loop": ([("a", "b"), ("b", "a")], "no first page"), "two": ([("a", "b"), ("c", "b"), ("b", None)], "no first page or several"), "self": ([("a", "b"), ("b", None), ("c", "c")], "beside"),
        "missing": ([("a", "b")], "not stored"), "foreign": ([("a", "x/b"), ("b", None)], "another host"), "long": ([(str(i), str(i + 1)) for i in range(70)] + [("70", None)], None),
        "twice": ([("a", "b"), ("a", "b"), ("b", None)], "stored twice"), "into": ([("a", "b"), ("b", "c"), ("c", "b")], "same next"),
    }
    frames = [pages(spark, links, name) for name, (links, _) in cases.items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    got = {r.listing: r for r in chains(every).collect()}
    for name, (links, problem) in cases.items():
        assert (got[name].problem is None) if problem is None else problem in got[name].problem, name
        if problem is None:
            assert got[name].reached == got[name].pages == len(links) and got[name].items == 2 * len(links)
    with pytest.raises(ValueError, match="beside the chain"):
        complete(pages(spark, cases["beside"][0]))
    assert complete(pages(spark, cases["whole"][0]), expected=6) == {"pages": 3, "items": 6}
    with pytest.raises(ValueError, match="6 items of 7"):
        complete(pages(spark, cases["whole"][0]), expected=7)
    assert complete(pages(spark, [])) == {"pages": 0, "items": 0}
