"""Extraction by a language model: asked in Arrow batches, read and checked by expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import int_from_id, user_prompt
from .asking import RateBudget, in_order, retrying
from .numbering import slice_rows

#: make() runs once a task and returns ask(system, user) -> reply, so clients need not be pickled.
MakeClient = Callable[[], Callable[[str, str], str]]


def ask_model(df: DataFrame, make: MakeClient, system_prompt: str, template: str, parallel: int = 1, attempts: int = 1, per_second: float | None = None) -> DataFrame:
    """entry_id, entry_text, raw_reply, ask_error for each entry; a failed call is the row's own error.

    A task keeps up to `parallel` requests under way and gives the replies in the order of its rows. A request that may
    succeed later is made up to `attempts` times. `per_second` bounds the requests of the whole job, an even share of which
    falls to each task that can run at a time. Every request is made once per task attempt; write the result before reading
    it twice.
    """
    rows = df.select(F.col("entry_id").cast("string").alias("entry_id"), "entry_text", user_prompt(template, F.coalesce("entry_text", F.lit(""))).alias("prompt"))
    share = None if per_second is None else per_second / df.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = retrying(make(), attempts, RateBudget(share))

        def answer(prompt: str) -> tuple[str | None, str | None]:
            try:
                return ask(system_prompt, prompt), None
            except Exception as error:  # noqa: BLE001  any failure belongs to its row
                return None, str(error) or type(error).__name__

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                replies = list(in_order(pool, answer, batch.column("prompt").to_pylist(), 2 * parallel))
                columns = [batch.column("entry_id"), batch.column("entry_text"), *(pa.array([r[i] for r in replies], pa.string()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["entry_id", "entry_text", "raw_reply", "ask_error"])

    return rows.mapInArrow(run, "entry_id string, entry_text string, raw_reply string, ask_error string")


def chat_client(base_url: str, model: str, temperature: float = 0.1, max_tokens: int = 1200, api_key: str = "", timeout: float = 120.0) -> MakeClient:
    """A client for an endpoint of the chat-completions form."""

    def make() -> Callable[[str, str], str]:
        import json
        import urllib.request

        def ask(system: str, user: str) -> str:
            body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": max_tokens}
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return ask

    return make


def read_replies(replies: DataFrame) -> DataFrame:
    """entry_id, source_text, data, flags, needs_review, error, raw_entry, raw_reply; data is null where error is not."""
    got = replies.withColumn("parsed", A.safe_parse_json("raw_reply"))
    got = got.withColumn("error", F.coalesce("ask_error", "parsed.error")).withColumn("data", F.when(F.col("error").isNull(), A.normalize_parsed_object("parsed.value")))
    checked = A.validate_parsed_object("data")
    flags = F.struct(*[checked[f].alias(f) for f in ("missing_headword", "missing_definition", "bad_examples")])
    ok = F.col("error").isNull()
    return got.select("entry_id", F.col("entry_text").alias("source_text"), "data", F.when(ok, flags).alias("flags"), F.when(ok, checked["needs_review"]).alias("needs_review"), "error", F.col("entry_text").alias("raw_entry"), "raw_reply")


def good(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNull()).select("entry_id", "source_text", "data", "flags", "needs_review")


def bad(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNotNull()).select("entry_id", "error", "raw_entry", "raw_reply")


def not_done(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Entries whose id, as text, is not among those done."""
    ids = done.select(F.col("entry_id").cast("string").alias("_id")).distinct()
    return entries.join(ids, F.col("entry_id").cast("string") == F.col("_id"), "left_anti")


#: Up to so many rows a sorted head is taken from every partition; beyond, rows are numbered where they lie.
HEAD = 10_000


def next_batch(entries: DataFrame, done: DataFrame, skip: int = 0, most: int | None = 10, order: str | None = None) -> DataFrame:
    """The entries of a resumed run: not done, after the first `skip`, `most` of them.

    They come in order of the column `order`, such as the place that read_entries gives; without one by the number at the
    end of the id, then by the id. A short head is taken from every partition, longer slices are cut by the rows' numbers.
    """
    by = [order] if order else [int_from_id("entry_id").asc_nulls_last(), "entry_id"]
    rest = not_done(entries, done)
    if most is not None and skip + most <= HEAD:
        return rest.orderBy(*by).offset(skip).limit(most)
    return (slice_rows(rest, *by, skip=skip, most=most) if skip or most is not None else rest).orderBy(*by)
