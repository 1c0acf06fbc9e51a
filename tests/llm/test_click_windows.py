"""Windows of repeated clicks against a walk over all rows."""

import datetime
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from lexweave.llm import click_windows
from lexweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
START = datetime.datetime(1970, 1, 1)


def micros(t):
    return (t - START) // datetime.timedelta(microseconds=1)


def walked(rows, batches=8, span=24, lateness=96):
    """rows: click_id, ts, arrived_at, client_id, kind, value, props."""
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            number = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
            parts = [client, kind, number, None if ts is None else micros(ts), props, c % 3]
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()))
    low, high = min(c[0] for c in copies), max(c[0] for c in copies)
    dealt = [[c[1:] for c in copies if (c[0] - low) * batches // (high - low + 1) == b] for b in range(batches)]
    top, opened, out = None, {}, []
    close = lambda click, batch: out.append((click, opened[click][0], batch, *opened[click][2:], opened.pop(click)[1]))
    for b, own in enumerate(dealt):
        for click, hour, code in sorted(r for r in own if top is None or r[1] >= top - lateness):
            if click in opened and hour <= opened[click][0] + span:
                w = opened[click]
                w[2] += 1
                if code != w[1]:
                    w[3], w[4] = w[3] + 1, w[4] + zlib.crc32(code.encode())
                continue
            if click in opened:
                close(click, b)
            opened[click] = [hour, code, 0, 0, 0]
        top = max([r[1] for r in own] + [top] * (top is not None))
        for click in [k for k, w in opened.items() if b == batches - 1 or w[0] + span < top - lateness]:
            close(click, b)
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash").collect())


def test_query_against_walk(spark):
    rows = spark.read.parquet(f"{SF}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()
    assert shown(QUERIES["op11_click_windows"](spark, SF)) == walked([tuple(r) for r in rows])


def test_odd_rows(spark):
    """Nulls, repeats, ties, a hot click, clashing extra columns; a session zone with summer time changes nothing."""
    at = lambda h, m=0: START + datetime.timedelta(hours=474_000 + h, minutes=m)
    rows = [(5, None, at(0), None, None, None, None), (5, at(1), at(0), 1, "a|b", 2.005, ""), (5, at(1), at(0), 1, "a|b", 2.005, ""), (None, at(1), at(2), 1, "a", 1.0, "{}"), (6, at(1), None, 1, "a", 1.0, "{}")]
    rows += [(8, at(2), at(30), 1, "é", float("nan"), "{}"), (8, at(2), at(30), 1, "é", float("inf"), "{}"), (2, at(3), at(700), 2, None, -0.5, "x" * 5000), (0, at(3), at(-3, 59), 2, "z", 1e300 / 1e290, None)]
    rows += [(11, at(i), at(7 * i % 500, i % 60), i % 4, "k", float(i % 3), "{}") for i in range(400)]
    kinds = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, batch int, hash int, tick int"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = shown(click_windows.deduplicate_clicks(spark.createDataFrame([(*r, "h", 3, 4, None) for r in rows], kinds), batches=3))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == walked(rows, 3)
    assert {r[0] for r in got} == {0, 2, 5, 8, 11}


def test_empty_table_has_no_windows(spark):
    none = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    out = click_windows.deduplicate_clicks(none)
    assert out.count() == 0 and out.columns == ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]


def test_no_state_store_stays_open(spark):
    """Stores hold memory outside the heap; those of 8 starts in all shuffle partitions must not pile up on an executor."""
    at = START + datetime.timedelta(days=20_000)
    rows = [(i, at, at + datetime.timedelta(hours=i), 1, "k", 1.0, "{}") for i in range(20)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    local = Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    stores = lambda: set(local.rglob("StateStoreId*"))  # noqa: E731  # each open store has a folder of its own
    before = stores()
    assert shown(click_windows.deduplicate_clicks(clicks, batches=2)) == walked(rows, 2)
    assert stores() <= before


def test_state_lies_in_the_checkpoint_alone(spark):
    """Closed RocksDB stores leave native memory behind, so every start would make executors larger; settings come back."""
    at = START + datetime.timedelta(days=20_000)
    rows = [(i, at, at + datetime.timedelta(hours=i), 1, "k", 1.0, "{}") for i in range(20)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    keys = ["spark.sql.streaming." + k for k in ("stateStore.providerClass", "maxBatchesToRetainInMemory", "stateStore.unloadOnCommit", "unsupportedOperationCheck")]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    settings, before = [spark.conf.get(k, None) for k in keys], set(shared.iterdir())
    assert shown(click_windows.deduplicate_clicks(clicks, batches=3)) == walked(rows, 3)
    assert [spark.conf.get(k, None) for k in keys] == settings
    (home,) = set(shared.iterdir()) - before
    kept = [p for p in (home / "checkpoint/state").rglob("*") if p.is_file() and not p.name.startswith(".")]
    batches = {(p.parent.parent.name, p.name) for p in kept if p.suffix == ".delta"}
    assert batches == {(op, f"{b}.delta") for op in "01" for b in (1, 2, 3)}
    assert not [p for p in kept if p.suffix in (".changelog", ".zip")]


@pytest.mark.parametrize("seed", range(20))
def test_batches_of_one_bucket(seed):
    """The walk of many clicks at once, with windows kept from before, against one row at a time."""
    rng = np.random.default_rng(seed)
    kept, opened = np.zeros(0, click_windows._OPEN), {}
    for batch in range(4):
        n = int(rng.integers(0, 120))
        click, hour, word = rng.integers(0, 9, n), rng.integers(0, 150, n), rng.integers(0, 3, n)
        h = np.zeros((n, 4), "<u8")
        h[:, 3] = word
        rows = click_windows._summed({"click_id": click, "hour": hour, "h": h, "rows": np.ones(n, np.int64)}, ["click_id", "hour"], "rows")
        limit = int(rng.integers(0, 120))
        kept, events = click_windows._tag_batch(kept, rows, batch, limit, 24)
        want, ended = [], set()
        for c, t, w in sorted(zip(click.tolist(), hour.tolist(), word.tolist(), strict=True)):
            opens = c not in opened or t > opened[c] + 24
            if opens:
                ended |= {(c, opened[c])} if c in opened else set()
                opened[c] = t
            want.append((c, opened[c], w, opens))
        for c in [c for c, t in opened.items() if t + 24 < limit]:
            ended.add((c, opened.pop(c)))
        live = events["rows"] > 0
        got = [(c, s, int(x[3]), bool(o)) for c, s, x, o, n in zip(events["click_id"], events["start_hour"], events["h"], events["opens"], events["rows"], strict=True) for _ in range(n)]
        assert sorted({g[:3] for g in got}) == sorted({w[:3] for w in want}) and len(got) == len(want) and live.sum() <= len(want)
        assert {(g[0], g[1]) for g in got if g[3]} == {(w[0], w[1]) for w in want if w[3]}
        told = events["closed_batch"] >= 0
        closed = list(zip(events["click_id"][told].tolist(), events["start_hour"][told].tolist(), strict=True))
        assert sorted(closed) == sorted(ended)
        assert dict(zip(kept["click"].tolist(), kept["start"].tolist(), strict=True)) == opened
