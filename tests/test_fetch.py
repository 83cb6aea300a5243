"""Fetching that goes on where it broke off, against a local server that breaks bodies."""

import hashlib
import threading
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from helixframe.sources import downloads

BODIES = {f"f{i}": hashlib.sha512(str(i).encode()).digest() * (400 * i + 1) for i in range(8)} | {"empty": b""}


class Server:
    """Breaks the bodies of some names after a part of what is asked for, twice each; counts what it has sent."""

    def __init__(self, ranges=True, breaks=2):
        self.sent, self.asked, self.broken = defaultdict(Counter), Counter(), Counter()
        self.now, self.most, self.lock = 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                name = self.path.strip("/")
                with outer.lock:
                    outer.asked[name] += 1
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                try:
                    self.answer(name)
                finally:
                    with outer.lock:
                        outer.now -= 1

            def answer(self, name):
                if name not in BODIES:
                    self.send_error(404)
                    return
                if name == "f7" and outer.asked[name] < 3:
                    self.send_error(503)
                    return
                body, at = BODIES[name], 0
                given = self.headers.get("Range")
                if given and ranges and self.headers.get("If-Range") == f'"{name}"':
                    at = int(given.removeprefix("bytes=").rstrip("-"))
                    self.send_response(206)
                    self.send_header("Content-Range", f"bytes {at}-{len(body) - 1}/{len(body)}")
                else:
                    self.send_response(200)
                self.send_header("ETag", f'"{name}"')
                self.send_header("Content-Length", str(len(body) - at))
                self.end_headers()
                rest = body[at:]
                if outer.broken[name] < breaks and len(body) > 1000:
                    outer.broken[name] += 1
                    rest = rest[: len(rest) // 3]
                for i in range(at, at + len(rest)):
                    outer.sent[name][i] += 1
                self.wfile.write(rest)
                self.wfile.flush()
                self.close_connection = True

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def plan(self, spark, names):
        return spark.createDataFrame([(n, f"http://127.0.0.1:{self.http.server_port}/{n}") for n in names], "name string, url string")


@pytest.fixture
def server():
    made = []

    def make(**how):
        made.append(Server(**how))
        return made[-1]

    yield make
    for s in made:
        s.http.shutdown()


def whole(tmp_path, names):
    return all((tmp_path / n).read_bytes() == BODIES[n] for n in names) and not [p for p in tmp_path.glob(".*.pieces")]


def test_broken_bodies_are_fetched_once(spark, tmp_path, server, monkeypatch):
    s = server()
    done = downloads.fetch(s.plan(spark, [*BODIES, "absent"]), str(tmp_path), 20, 3, attempts=6, wait_s=0.01).collect()
    assert {r["name"]: (r["ok"], r["length"]) for r in done} == {n: (True, len(b)) for n, b in BODIES.items()} | {"absent": (False, 0)}
    assert whole(tmp_path, BODIES) and s.asked["absent"] == 1 and s.most <= 3
    for name, times in s.sent.items():
        assert set(times.values()) <= {1} and len(times) == len(BODIES[name]), name


def test_later_runs_go_on(spark, tmp_path, server):
    s = server()
    names = ["f3", "f5"]
    first = downloads.fetch(s.plan(spark, names), str(tmp_path), 20, 2, attempts=1).collect()
    assert not any(r["ok"] for r in first) and all("of" in r["error"] for r in first) and not (tmp_path / "f3").exists()
    downloads.fetch(s.plan(spark, names), str(tmp_path), 20, 2, attempts=1).collect()
    last = downloads.fetch(s.plan(spark, names), str(tmp_path), 20, 2, attempts=1).collect()
    assert all(r["ok"] for r in last) and whole(tmp_path, names)
    assert all(set(t.values()) == {1} for t in s.sent.values())


def test_without_ranges_bodies_are_whole(spark, tmp_path, server):
    s = server(ranges=False)
    done = downloads.fetch(s.plan(spark, ["f2", "f6"]), str(tmp_path), 20, 2, wait_s=0.01).collect()
    assert all(r["ok"] for r in done) and whole(tmp_path, ["f2", "f6"])


def test_pieces_of_some_size(tmp_path, server, monkeypatch):
    monkeypatch.setattr(downloads, "_PIECE", 1000)
    s = server(breaks=0)
    url = f"http://127.0.0.1:{s.http.server_port}/f4"
    assert downloads._pieces(url, str(tmp_path / "p"), 20) == len(BODIES["f4"])
    assert len(list((tmp_path / "p").iterdir())) == 3
    assert downloads._join(str(tmp_path / "p"), str(tmp_path / "f4")) == len(BODIES["f4"]) and (tmp_path / "f4").read_bytes() == BODIES["f4"]
