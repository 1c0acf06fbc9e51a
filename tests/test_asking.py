"""Requests to a service that is slow, busy or unwilling, and runs that start side by side."""

import json
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexweave.operators import asking, extract
from lexweave.operators.runs import Registry


@pytest.fixture
def service():
    """Answers with the user's last word; every third word first gets a 429, every fifth comes late, `no` gets a 400."""
    seen, state, lock = Counter(), {"now": 0, "most": 0}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            word = body["messages"][1]["content"].split()[-1]
            with lock:
                seen[word] += 1
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            n = int(word[1:]) if word[1:].isdigit() else 1
            time.sleep(0.3 if n % 5 == 0 else 0.02)
            with lock:
                state["now"] -= 1
            code = 400 if word == "no" else 429 if n % 3 == 0 and seen[word] == 1 else 200
            reply = json.dumps({"choices": [{"message": {"content": f"reply {word}"}}]}).encode()
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0.1")
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen, state
    server.shutdown()


def test_busy_and_late(spark, service):
    """Order and counts are right though replies come late and out of turn; a bad request is not made again."""
    url, seen, state = service
    words = [f"w{i}" for i in range(1, 41)] + ["no"]
    df = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "entry_id string, entry_text string").coalesce(1)
    got = extract.ask_model(df, extract.chat_client(url, "m"), "S", "Word: {{ entry_text }}", parallel=6, attempts=4).collect()
    assert [r["entry_text"] for r in got] == words
    assert [r["raw_reply"] for r in got[:-1]] == [f"reply {w}" for w in words[:-1]] and all(r["ask_error"] is None for r in got[:-1])
    assert got[-1]["raw_reply"] is None and "400" in got[-1]["ask_error"]
    assert seen == Counter({w: 2 if w != "no" and int(w[1:]) % 3 == 0 else 1 for w in words})
    assert 1 < state["most"] <= 6


def test_without_another_attempt(spark, service):
    url, seen, _ = service
    df = spark.createDataFrame([("1", "w3"), ("2", "w4")], "entry_id string, entry_text string").coalesce(1)
    got = extract.ask_model(df, extract.chat_client(url, "m"), "S", "{{ entry_text }}").collect()
    assert "429" in got[0]["ask_error"] and got[1]["raw_reply"] == "reply w4" and sum(seen.values()) == 2


def test_rate_is_shared_by_threads():
    budget, times = asking.RateBudget(50), []

    def ask(system, user):
        times.append(time.monotonic())
        return user

    with ThreadPoolExecutor(8) as pool:
        assert list(asking.in_order(pool, lambda p: asking.retrying(ask, 1, budget)("", p), range(25), 16)) == list(range(25))
    assert max(times) - min(times) >= 24 / 50 * 0.95


def test_waits():
    class Busy(Exception):
        code, headers = 503, {"Retry-After": "7"}

    assert asking.wait_before(Busy(), 1) == 7.0 and asking.wait_before(ValueError("x"), 1) is None
    assert 1.0 <= asking.wait_before(TimeoutError(), 3) <= 2.0 and asking.wait_before(TimeoutError(), 30) == asking.LONGEST_WAIT
    Busy.headers = {"Retry-After": "Wed, 21 Oct 2015 07:28:00 GMT"}
    assert asking.wait_before(Busy(), 1) <= 0.5
    with pytest.raises(ValueError):
        asking.retrying(lambda s, u: u, 0, asking.RateBudget(None))("", "x")


def test_runs_started_side_by_side(spark, tmp_path):
    """Eight threads get eight ids, and updates of different fields at the same time all count."""
    registry = lambda: Registry(spark, str(tmp_path / "registry"))
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda i: registry().start("p", str(i)), range(8)))
    assert sorted(ids) == list(range(1, 9))
    fields = {"n_records": 5, "notes": "done", "n_raw_paragraphs": 7, "parsed_file": "x"}
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda kv: registry().update(3, **dict([kv])), fields.items()))
    rows = {r["run_id"]: r for r in registry().frame().collect()}
    assert len(rows) == 8 and [rows[i]["previous_run_id"] for i in range(1, 9)] == [None, *range(1, 8)]
    assert {k: rows[3][k] for k in fields} == fields and rows[3]["version"] == 4 and rows[3]["timestamp_utc"] is not None
    with pytest.raises(ValueError):
        registry().update(99, notes="x")
    with pytest.raises(ValueError):
        registry().update(3, colour="x")
