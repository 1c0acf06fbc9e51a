"""Command lines: python -m lexweave.plans.cli rules|model|evaluate --config FILE."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from ..config import Config, load_config
from ..operators import audit, cascade, compare, extract, normalize
from ..schemas import MODEL_RECORD, RULE_RECORD
from ..sources import readers, sinks
from ..sources.append_log import Conflict, extraction_log


def run_rules(spark: SparkSession, c: Config) -> None:
    """Paragraphs to records; an audit where `audit_output` is set."""
    path = c.input_path
    rows = readers.docx_paragraphs(spark, path) if path.endswith(".docx") else readers.text_paragraphs(spark, path)
    if c.get("audit_output"):
        sinks.write_csv(audit.audit(rows), c.audit_output)
    records = cascade.parse(rows, c.get("profile", "src"), renumber=c.get("renumber", False))
    sinks.write_jsonl(records, c.output_jsonl)
    if c.get("output_csv"):
        sinks.write_csv(records, c.output_csv)


def run_model(spark: SparkSession, c: Config, make: extract.MakeClient | None = None) -> None:
    """Ask the model for entries not yet done, in the order of the input, until `max_new_rows` have a good reply.

    Every `commit_rows` entries (all by default) are added to both outputs at once, so a crash loses no more than what was
    asked since; runs side by side don't add an entry twice. Failed entries are passed over in this run and come again in
    the next. `parallel`, `attempts` and `per_second` are those of ask_model(). The key for the endpoint is `api_key`, or the environment variable that `api_key_env` names.
    """
    entries, skip, left = readers.read_entries(spark, c.input_path, with_place=True), c.get("skip_unfinished_rows", 0), c.get("max_new_rows")
    key = c.get("api_key") or os.environ.get(c.get("api_key_env", ""), "")
    make = make or extract.chat_client(c.base_url, c.model_name, c.get("temperature", 0.1), c.get("max_tokens", 1200), key)
    log, step = extraction_log(spark, c.output_jsonl, c.error_jsonl), c.get("commit_rows")
    while left is None or left > 0:
        version = log.recover()
        most = min((x for x in (left, step) if x is not None), default=None)
        batch = extract.next_batch(entries, readers.done_ids(spark, c.output_jsonl), skip, most, "place")
        replies = extract.ask_model(batch, make, readers.load_prompt(c.system_prompt), readers.load_prompt(c.parser_prompt), c.get("parallel", 1), c.get("attempts", 1), c.get("per_second")).persist()
        records = extract.read_replies(replies)
        asked, good = replies.count(), extract.good(records).count()
        try:
            if asked:
                log.append({"good": extract.good(records), "bad": extract.bad(records)}, "model", based_on=version)
        except Conflict:  # another run has added entries: what is left is seen anew
            replies.unpersist()
            continue
        replies.unpersist()
        if most is None or asked < most:
            break
        left, skip = left if left is None else left - good, skip + asked - good


def run_evaluation(spark: SparkSession, c: Config) -> None:
    """Both outputs normalised, joined and reported; the join is made once for all reports."""
    rule = normalize.normalize_rule(readers.read_jsonl(spark, c.rule_output, RULE_RECORD))
    model = normalize.normalize_model(normalize.flatten_model(readers.read_jsonl(spark, c.genai_output, MODEL_RECORD)), c.get("genai_id_offset", 0))
    maps = readers.load_map(c.get("pos_map")), readers.load_map(c.get("region_map"))
    rule, model = normalize.apply_maps(rule, *maps), normalize.apply_maps(model, *maps)
    merged = compare.merge_outputs(rule, model).persist()
    sinks.write_jsonl(merged, c.merged_jsonl)
    sinks.write_presence_summary(merged, c.presence_csv)
    sinks.write_exact_match_summary(merged, c.exact_match_csv)
    if c.get("workbook"):
        sinks.write_workbook({"merged": merged, "rule_norm": rule, "genai_norm": model}, c.workbook)
    if c.get("report_dir"):
        sinks.write_sheets({"merged": compare.with_presence(merged), "presence": compare.presence_summary(merged), "exact_match": compare.exact_match_summary(merged), "alignment": compare.alignment_summary(merged)}, c.report_dir)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["rules", "model", "evaluate"])
    parser.add_argument("--config", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    {"rules": run_rules, "model": run_model, "evaluate": run_evaluation}[args.command](spark, load_config(args.config))


if __name__ == "__main__":
    main()
