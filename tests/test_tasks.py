"""Task logs with offsets and fetched files, against folders and a local server."""

import http.server
import json
import threading
from functools import partial

import pytest

from tessera.sources import tasks


class Handler(http.server.SimpleHTTPRequestHandler):
    def do_GET(self):
        if self.path.startswith("/no"):
            self.send_error(403)
        elif self.path.startswith("/bad"):
            self.send_error(500)
        elif self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/a.txt")
            self.end_headers()
        elif self.path == "/log":
            import os

            body = "".join(f"{n} {os.path.getsize(f'{self.directory}/log/{n}')}\n" for n in os.listdir(f"{self.directory}/log")).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)
        else:
            super().do_GET()

    def log_message(self, *a):
        pass


@pytest.fixture
def server(tmp_path):
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def line(i):
    return json.dumps({"file_md5": f"m{i}", "url": f"/x/{i}", "user_id": str(i % 3), "is_public": i % 2 == 0}) + "\n"


def test_fetch_tells_refusals_from_failures(spark, server, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    places = [f"{server}/a.txt", f"{server}/moved", f"{server}/no?signature=1", f"{server}/bad", f"{server}/absent", str(tmp_path / "a.txt"), f"file://{tmp_path}/a.txt", str(tmp_path / "none"), "http://127.0.0.1:1/x"]
    got = {r["url"]: r for r in tasks.fetch_files(spark.createDataFrame([(p,) for p in places], "url string")).collect()}
    assert [got[p]["status"] for p in places] == ["ok", "ok", "forbidden", "failed", "failed", "ok", "ok", "missing", "failed"]
    assert {bytes(r["content"]) for r in got.values() if r["status"] == "ok"} == {b"hello"}
    assert "signature" not in got[places[2]]["error"]


def test_log_restarts_without_loss_or_repeats(spark, server, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def write(p, lines, tail=""):
        with open(log / f"partition-{p}.log", "a") as f:
            f.write("".join(lines) + tail)

    def drain(place, name, **options):
        q = tasks.read_tasks(spark, place, stream=True, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(processingTime="0 seconds").start(f"{tmp_path}/out-{name}")
        q.processAllAvailable()
        q.stop()
        return sorted((r["partition"], r["offset"], r["file_md5"]) for r in spark.read.parquet(f"{tmp_path}/out-{name}").collect())

    write(0, map(line, range(40)))
    write(1, map(line, range(40, 60)), tail='{"file_md5": "half')
    first = drain(str(log), "a", maxBytesPerPartition=500, committed=tmp_path / "committed")
    assert [x[2] for x in first] == [f"m{i}" for i in range(60)]
    write(1, [" a line\n", line(61)])
    write(2, [line(62)])
    again = drain(str(log), "a", maxBytesPerPartition=500, committed=tmp_path / "committed")
    assert len(set(again)) == len(again) == 63 and set(first) <= set(again)
    assert {x[2] for x in again} - {x[2] for x in first} == {None, "m61", "m62"} or {x[2] for x in again} - {x[2] for x in first} == {"half a line", "m61", "m62"}
    committed = json.loads((tmp_path / "committed").read_text())  # told when the next micro-batch begins, so never too much
    assert set(committed) >= {"0", "1"} and all(0 < n <= (log / f"partition-{p}.log").stat().st_size for p, n in committed.items())
    assert drain(f"{server}/log", "b") == again
    assert sorted((r["partition"], r["offset"], r["file_md5"]) for r in tasks.read_tasks(spark, str(log)).collect()) == again
