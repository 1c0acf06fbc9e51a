"""Queries that write the given tables through the library's sinks and read them back through its sources."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, cascade, extract, runs
from ..operators.snapshots import Snapshots
from ..operators.spreading import spread
from ..sources import docx, readers, sinks
from ..sources.append_log import extraction_log
from ..sources.json_split import split_json
from ..sources.scratch import shared_folder
from .queries import _PAIRS, ORACLES, _merged, _order_runs, _s_presence, _stub, _table, query, s_collapse


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("q_jsonl_round", "select doc_id, text, lang from documents")
def jsonl_round(spark, sf):
    """JSON lines written with null fields and read by their schema."""
    path = _folder(spark, "jsonl")
    sinks.write_jsonl(_table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("q_nan_round", "select click_id, case when kind = 'click' then null else value end as value from clicks")
def nan_round(spark, sf):
    """Values that are not numbers come back as null."""
    path = _folder(spark, "nan")
    sinks.write_jsonl(_table(spark, sf, "clicks").select("click_id", F.expr("case when kind = 'click' then double('NaN') else value end").alias("value")), path)
    return readers.read_jsonl(spark, path, "click_id long, value double")


@query("q_csv_round", "select conv_id, turn, role, text, '[\"' || role || '\",\"x,y\"]' as tags from conversations")
def csv_round(spark, sf):
    """CSV with a header, quotes, line breaks and an array as JSON."""
    path = _folder(spark, "csv")
    rows = _table(spark, sf, "conversations")
    sinks.write_csv(rows.select("conv_id", "turn", "role", "text", F.array("role", F.lit("x,y")).alias("tags")), path)
    return spark.read.schema("conv_id long, turn long, role string, text string, tags string").csv(path, header=True, escape='"', multiLine=True)


def _json_files(df: DataFrame, path: str, form: str) -> None:
    """Each partition as one JSON list or object of a single line; partitions, and so files, grow in number with the rows' bytes."""
    item = F.to_json(F.struct("entry_id", "entry_text")) if form == "[" else F.concat(F.to_json(F.array("entry_id")).substr(F.lit(2), F.length(F.to_json(F.array("entry_id"))) - 2), F.lit(":"), F.to_json(F.array("entry_text")).substr(F.lit(2), F.length(F.to_json(F.array("entry_text"))) - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            items = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{form if first and i == 0 else ','}{x}" for i, x in enumerate(items)], pa.string())], names=["value"])
            first = first and not items
        yield pa.RecordBatch.from_arrays([pa.array([form + "]}"["[{".index(form)] if first else "]}"["[{".index(form)]], pa.string())], names=["value"])

    df.select(item.alias("value")).hint("rebalance").mapInArrow(run, "value string").write.option("lineSep", " ").text(path)


@query("q_entries_list", "select doc_id || '' as entry_id, text as entry_text from documents")
def entries_list(spark, sf):
    """Entries of JSON lists of one long line, cut by blocks."""
    path = _folder(spark, "list")
    _json_files(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.col("text").alias("entry_text")), path, "[")
    return split_json(spark, path).select(F.from_json("text", "struct<entry_id: string, entry_text: string>", {"mode": "FAILFAST"}).alias("e")).select("e.*")


@query("q_entries_object", "select conv_id || '/' || turn as entry_id, text as entry_text from conversations")
def entries_object(spark, sf):
    """Entries of JSON objects from id to text."""
    path = _folder(spark, "object")
    _json_files(_table(spark, sf, "conversations").select(F.format_string("%d/%d", "conv_id", "turn").alias("entry_id"), F.col("text").alias("entry_text")), path, "{")
    named = F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>", {"mode": "FAILFAST"}))
    return split_json(spark, path).where("kind = '{'").select(named.alias("entry_id", "entry_text"))


@query("q_entries_lines", "select doc_id || '' as entry_id, text as entry_text from documents where doc_id not in (select doc_id from labels)")
def entries_lines(spark, sf):
    """Entries under other names, renamed on load, but for those done in earlier output with broken lines."""
    path, done = _folder(spark, "lines"), _folder(spark, "done")
    sinks.write_jsonl(_table(spark, sf, "documents").select(F.col("doc_id").alias("paragraph_id"), "text"), path)
    labels = _table(spark, sf, "labels").select(F.explode(F.array(F.format_string('{"entry_id": "%d"}', "doc_id"), F.lit('{"entry_id": '), F.format_string('{"entry_id": %d}', "doc_id"))).alias("value"))
    labels.write.text(done)
    rows = readers.rename_on_load(readers.read_jsonl(spark, path, "paragraph_id string, text string"))
    return extract.not_done(rows, readers.done_ids(spark, done)).select("entry_id", "entry_text")


def _docx(texts: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("q_docx_paragraphs", f"select cast(turn + 1 as integer) as para_id, {s_collapse('text')} as text, conv_id || '' as path from conversations where {s_collapse('text')} <> ''")
def docx_paragraphs(spark, sf):
    """Each conversation as a DOCX file, a turn a paragraph, read back; blank ones are counted and left out."""
    turns = _table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_docx([x["text"].replace("\n", " ") if x["text"] else "" for x in t]) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    files = turns.mapInArrow(run, "path string, content binary")
    rows = readers.clean_paragraphs(docx.docx_rows(files))
    return rows.select("para_id", F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ").alias("text"), "path")


@query("q_append_log", "select c_name as entry_id, case when c_custkey % 10 % 4 = 0 then 'a ' || c_name else '' end as definition, 'good' as output from customer where c_custkey % 10 % 4 < 2 union all select c_name, case c_custkey % 10 % 4 when 2 then 'JSON parse failure' else 'no reply' end, 'bad' from customer where c_custkey % 10 % 4 > 1")
def append_log(spark, sf):
    """Replies of a model added to two outputs in three batches, one of which comes twice and once more under its number."""
    good, bad = _folder(spark, "good"), _folder(spark, "bad")
    rows = _table(spark, sf, "customer").select(F.col("c_name").alias("entry_id"), F.col("c_name").alias("entry_text"), F.pmod("c_custkey", F.lit(3)).alias("part"))
    log = extraction_log(spark, good, bad)
    for number in (0, 1, 1, 2, 0):
        replies = extract.ask_model(spread(rows.where(F.col("part") == number)), lambda: _stub(), "system", "Word: {{ entry_text }}", parallel=4).persist()
        records = extract.read_replies(replies)
        log.append({"good": extract.good(records), "bad": extract.bad(records)}, "query", number)
        replies.unpersist()
    found = spark.read.schema("entry_id string, data struct<definition: string>").json(good).select("entry_id", F.col("data.definition").alias("definition"), F.lit("good").alias("output"))
    return found.unionByName(spark.read.schema("entry_id string, error string").json(bad).select("entry_id", F.col("error").alias("definition"), F.lit("bad").alias("output")))


@query("q_presence_report", " union all ".join(_s_presence(k, *_PAIRS[k]) for k in ("headword", "definition", "pronunciations")))
def presence_report(spark, sf):
    """The presence report as it is written."""
    path = _folder(spark, "presence")
    sinks.write_presence_summary(_merged(spark, sf), path)
    read = spark.read.schema("field string, both_present long, rule_only long, genai_only long, both_missing long").csv(path, header=True)
    return read.where(F.col("field").isin("headword", "definition", "pronunciations"))


@query("q_exact_report", ORACLES["q_exact_match"])
def exact_report(spark, sf):
    """The report of exact matches as it is written."""
    path = _folder(spark, "exact")
    sinks.write_exact_match_summary(_merged(spark, sf), path)
    read = spark.read.schema("field string, exact_match_rate double").csv(path, header=True)
    return read.where(F.col("field").isin("headword", "definition", "pronunciations"))


@query("q_skip_filter", "select event_id, nullif(event_type, 'view') as entry_type from events where event_type <> 'click'")
def skip_filter(spark, sf):
    """Records of the type `skip` go, those without a type stay."""
    rows = _table(spark, sf, "events").select("event_id", F.expr("case event_type when 'click' then 'skip' when 'view' then null else event_type end").alias("entry_type"))
    return audit.without_skipped(rows)


@query("q_run_snapshots", ORACLES["q_run_diff"])
def run_snapshots(spark, sf):
    """Two runs stored in buckets by their keys, and compared without moving either."""
    store = Snapshots(spark, _folder(spark, "snapshots"), buckets=8)
    old, new = _order_runs(spark, sf)
    fields = ["entry_type", "headword"]
    store.save(1, runs.build_parsed(old, fields))
    store.save(2, runs.build_parsed(new, fields))
    got = store.compare(1, 2, fields)
    return got.select("para_id", "change_status", F.array_join("changed_columns", "|").alias("changed_columns"), "num_changed_columns", F.coalesce("source_changed", F.lit(False)).alias("source_changed"))


def _varied(name: str, entry: str, branch: str, values: dict[str, str]):
    """An entry that takes a less trodden path; columns that aren't given are null."""
    base = {"headword_raw": "null", "headword": "null", "pronunciation": "null", "pronunciation_2": "null", "pronunciation_4": "null", "part_of_speech": "null", "definition": "null", "etymology": "null", "variant_forms": "''", "cross_references": "''"} | values
    sql = f"select cast(p_partkey as integer) as para_id, '{branch}' as rule_branch, {', '.join(f'cast({v} as varchar) as {k}' for k, v in base.items())} from part"

    @query(name, sql)
    def run(spark, sf):
        rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("para_id"), F.expr(entry).alias("text"))
        return cascade.parse(rows).select("para_id", "rule_branch", *[F.array_join(c, "|").alias(c) if c in ("variant_forms", "cross_references") else c for c in base])


_varied("q_parse_guard_c03", "concat(p_name, ' n. ', p_size, ', see ', upper(p_type))", "C9", {"headword_raw": "p_name || ' n. ' || p_size", "headword": "lower(p_name) || ' n. ' || p_size", "definition": "'see ' || upper(p_type)"})
_varied("q_parse_guard_c09", "concat(p_name, ', n. a ', lower(p_type), '.')", "C12", {"headword_raw": "p_name || ','", "headword": "lower(p_name) || ','", "part_of_speech": "'n.'", "definition": "'a ' || lower(p_type)"})
_varied(
    "q_parse_many_prons",
    "concat(p_name, ' /', p_brand, '/ , /b', p_size, '/, /c/, /d', p_size, '/, /e/ 2. n. (old) ', lower(p_type), '; < Latin root. See ALSO THIS; ALSO THAT.')",
    "C11",
    {"headword_raw": "p_name", "headword": "lower(p_name)", "pronunciation": "p_brand", "pronunciation_2": "'b' || p_size", "pronunciation_4": "'d' || p_size", "part_of_speech": "'n.'", "definition": "'2. ' || lower(p_type) || '. See ALSO THIS; ALSO THAT'", "etymology": "'Latin root'", "cross_references": "'ALSO THIS'"},
)
_varied("q_parse_variants", "concat(p_name, ' also ', lower(p_brand), 'x /', p_brand, '/ n, ', lower(p_type))", "C11", {"headword_raw": "p_name || ' also ' || lower(p_brand) || 'x'", "headword": "lower(p_name)", "variant_forms": "lower(p_brand) || 'x'", "pronunciation": "p_brand", "definition": "'n., ' || lower(p_type)"})
