"""The chat client and the API stage against a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidewell.operators import tagging
from tidewell.sources import datasets


@pytest.fixture
def server():
    """Answers with the prompt in capitals; the first request of each prompt fails by one of four ways, and those for `never` always do."""
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = asked["messages"][-1]["content"]
            with lock:
                seen[said, asked.get("seed")] += 1
                first = seen[said, asked.get("seed")] == 1
            answer = json.dumps({"choices": [{"message": {"role": "assistant", "content": said.upper()}}]}).encode()
            if said == "never" or first:
                way = len(said) % 4
                if way == 0:
                    return self.send_error(503)
                if way == 1:
                    answer = b"<html>not JSON</html>"
                if way == 2:  # the connection ends before an answer
                    return self.close_connection
            else:
                way = None
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer) + 10 * (way == 3)))  # cut off
            self.end_headers()
            self.wfile.write(answer)
            self.close_connection = True

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/v1/chat", seen
    made.shutdown()
    made.server_close()


def test_each_kind_of_failure_is_retried(server, monkeypatch):
    url, seen = server
    waited = []
    monkeypatch.setattr(datasets.with_retry, "__defaults__", (5, waited.append, (Exception,)))
    client = datasets.ChatClient(url, {}, timeout=5)
    for said in ("abcd", "abcde", "abcdef", "abcdefg"):
        assert client.complete([{"role": "user", "content": said}], {"seed": 0}) == said.upper()
        assert seen[said, 0] == 2
    assert waited == [1, 1, 1, 1]
    assert client.complete([{"role": "user", "content": "never"}], {"seed": 0}) is None
    assert seen["never", 0] == 5 and waited[4:] == [1, 2, 4, 8, 16]


def test_an_api_stage_over_http(spark, server):
    url, seen = server
    rows = [(i, "p" * (i + 1)) for i in range(8)] + [(8, None)]
    df = spark.createDataFrame(rows, "id long, said string").repartition(2)
    out = tagging.api_responses(df, lambda: datasets.ChatClient(url, {}, timeout=5), "said", {"temperature": 0}, 2).collect()
    assert {r.id: (r.responses, r.ok) for r in out} == {i: ([(s or "").upper()] * 2, True) for i, s in rows}
    assert all(seen[s or "", k] == 2 for _, s in rows for k in (0, 1))
