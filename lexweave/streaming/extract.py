"""The resumable extraction loop as a stream (an extension): new entries in, good and bad records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import MakeClient, ask_model, bad, good, read_replies
from ..schemas import ENTRY
from ..sources.append_log import extraction_log


def extract_stream(spark: SparkSession, source: str, good_path: str, bad_path: str, checkpoint: str, make: MakeClient, system_prompt: str, template: str) -> StreamingQuery:
    """Ask the model for every entry in files not yet seen, each batch exactly once.

    The checkpoint remembers what is done; a batch that was cut off comes again under its number, and the log of the outputs
    knows whether it counts already. Then it isn't asked again.
    """
    entries = spark.readStream.schema(ENTRY).json(source)

    def each(batch: DataFrame, number: int) -> None:
        log, writer = extraction_log(batch.sparkSession, good_path, bad_path), f"stream {checkpoint}"
        log.recover()
        if number <= log.last_batch(writer):
            return
        replies = ask_model(batch, make, system_prompt, template).persist()
        try:
            records = read_replies(replies)
            log.append({"good": good(records), "bad": bad(records)}, writer, number)
        finally:
            replies.unpersist()

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
