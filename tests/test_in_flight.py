"""Several calls of a provider at once: their bound, their order, and failures that spoil no other."""

import json
import threading
import time
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from plinth.operators.models import HttpProvider, embedded, generated, in_flight

SLOW = 0.03


@contextmanager
def slow_server():
    """Replies after SLOW seconds; texts that begin with `bad` get an error, `flaky` ones at their first call. `most` is the most calls at once."""
    seen = {"now": 0, "most": 0, "calls": 0, "flaky": set()}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body.get("query") or body.get("prompt")
            with lock:
                seen["now"] += 1
                seen["calls"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                again = text.startswith("flaky") and text not in seen["flaky"]
                seen["flaky"].add(text)
            time.sleep(SLOW)
            with lock:
                seen["now"] -= 1
            status = 400 if text.startswith("bad") else 503 if again else 200
            reply = json.dumps({"response": [float(len(text)), 1.0] if "embeddings_model" in body else text.upper()}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_address[1]}", seen
    finally:
        server.shutdown()


def no_sleep(_):
    pass


@pytest.mark.parametrize("workers", [1, 2, 5])
def test_bound_order_and_failures(workers):
    now, most, lock = [0], [0], threading.Lock()

    def call(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (n % 4))
        with lock:
            now[0] -= 1
        if n % 7 == 3:
            raise ValueError(n)
        return n * n

    got = list(in_flight(call, range(40), workers))
    assert [g if isinstance(g, int) else None for g in got] == [None if n % 7 == 3 else n * n for n in range(40)]
    assert all(isinstance(g, ValueError) for g in got[3::7]) and most[0] == workers


def test_items_are_taken_as_results_are():
    taken = []
    results = in_flight(lambda n: n, (taken.append(n) or n for n in range(1000)), 3)
    assert next(results) == 0 and len(taken) <= 4
    with pytest.raises(ValueError):
        list(in_flight(str, [1], 0))


def test_provider_over_a_slow_server():
    with slow_server() as (url, seen):
        texts = [f"text {'x' * n}" for n in range(12)] + ["bad one", "flaky one"]
        provider = HttpProvider(url, "key", "m", 2, no_sleep, workers=4)
        start = time.time()
        got = provider.embed(texts)
        assert got == [[float(len(t)), 1.0] for t in texts[:12]] + [None, [9.0, 1.0]]
        assert seen["most"] == 4 and seen["calls"] == 15 and time.time() - start < 15 * SLOW


def test_column_over_a_slow_server(spark):
    with slow_server() as (url, seen):
        rows = [(n, "bad" if n == 5 else f"{'y' * n}") for n in range(1, 31)]
        df = spark.createDataFrame(rows, "n int, text string").coalesce(1)
        embed = HttpProvider(url, "key", "m", 2, no_sleep, workers=3).embed
        got = {r["n"]: list(r["e"]) for r in df.select("n", embedded(F.col("text"), embed, 2).alias("e")).collect()}
        assert got == {n: [0.0, 0.0] if n == 5 else [float(n), 1.0] for n, _ in rows}
        assert 2 <= seen["most"] <= 3
        seen["most"] = 0
        told = HttpProvider(url, "key", "m", 2, no_sleep).generate
        replies = {r["n"]: r["r"] for r in df.select("n", generated(F.col("text"), told, workers=5).alias("r")).collect()}
        assert replies[5]["reply"] is None and "400" in replies[5]["error"] and replies[7]["reply"] == "Y" * 7
        assert 3 <= seen["most"] <= 5


def test_batch_that_fails_is_tried_text_by_text(spark):
    def embed(texts):
        if len(texts) > 1 or texts[0] == "no":
            raise RuntimeError("too many")
        return [[float(len(texts[0]))]]

    df = spark.createDataFrame([("a",), ("no",), ("ccc",), (None,)], "t string").coalesce(1)
    assert [list(r[0]) for r in df.select(embedded(F.col("t"), embed, 1, workers=3)).collect()] == [[1.0], [0.0], [3.0], [0.0]]
