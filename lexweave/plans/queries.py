"""Queries over the tables, each with SQL that gives the same rows by another way where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import audit, cascade, compare, extract, metrics, normalize, numbering, runs
from ..operators.spreading import spread
from ..sources.readers import split_paragraphs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(c):
    return F.array_join(c, "|")


# SQL forms of the text functions.
def s_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x1c-\x1f\x0b\x{{85}}\x{{a0}}]+', ' ', 'g'))"


def s_match(x: str) -> str:
    return s_collapse(f"translate(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ς’‘“”–—', 'σ''''\"\"--')")


def s_words(x: str) -> str:
    return rf"regexp_extract_all({s_match(x)}, '[\p{{L}}\p{{N}}_]+')"


def s_word_len(x: str) -> str:
    return rf"coalesce(len(regexp_extract_all({x}, '[^\s\x1c-\x1f\x0b\x{{85}}\p{{Z}}]+')), 0)"


@query("q_entry_text_norm", rf"select doc_id, regexp_replace(regexp_replace({s_collapse('text')}, '/ *, */', '/, /', 'g'), ' +([,.;:])', '\1', 'g') as norm from documents")
def entry_text_norm(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.normalize_entry_text("text").alias("norm"))


@query("q_clean_text", f"select doc_id, nullif({s_collapse('text')}, '') as clean from documents")
def clean_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@query("q_match_text", f"select doc_id, {s_match('text')} as match_text from documents")
def match_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.match_text("text").alias("match_text"))


@query("q_hash", "select doc_id, sha256(coalesce(text, '')) as text_hash from documents")
def hashes(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.hash_text("text").alias("text_hash"))


@query("q_id_int", r"select c_custkey, cast(regexp_extract(c_name, '(\d+)$', 1) as integer) as id, printf('hde_%05d', c_custkey) as formatted from customer")
def id_int(spark, sf):
    return _table(spark, sf, "customer").select("c_custkey", T.int_from_id("c_name").alias("id"), T.id_format("c_custkey").alias("formatted"))


S_PARAGRAPHS = "(select doc_id, cast(pos as integer) as para_id, trim(line) as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where trim(line) <> '')"


def _paragraphs(spark, sf):
    return split_paragraphs(_table(spark, sf, "documents"), keep=("doc_id",))


@query("q_paragraphs", f"select doc_id, para_id, text, sha256(text) as text_hash from {S_PARAGRAPHS}")
def paragraphs(spark, sf):
    return _paragraphs(spark, sf)


S_AUDIT = rf"""
    select doc_id, para_id, text, cast(length(text) as integer) as char_count, cast(len(regexp_extract_all(text, '\S+')) as integer) as word_count,
           left(text, 20) as starts_with, right(text, 20) as ends_with, regexp_matches(text, '\d') as has_digit, regexp_matches(text, '[\[\]()]') as has_brackets,
           contains(text, '/') as has_slash, contains(text, ';') as has_semicolon, contains(text, ':') as has_colon, regexp_matches(text, '["''“”‘’]') as has_quote,
           regexp_matches(text, '[^\x00-\x7F]') as non_ascii, length(text) < 25 as flag_short, length(text) > 1200 as flag_long,
           len(regexp_extract_all(text, '\S+')) <= 3 as flag_low_word_count, len(regexp_extract_all(text, '\S+')) <= 6 and not regexp_matches(text, '[.;:!?]') as flag_possible_heading,
           regexp_full_match(text, '[A-Z]') as flag_single_letter_header, regexp_full_match(text, '[A-Z&\- ]{{1,8}}') and len(regexp_extract_all(text, '\S+')) <= 2 as flag_all_caps_short
    from {S_PARAGRAPHS}"""
S_REVIEW = "(flag_short or flag_long or flag_low_word_count or flag_possible_heading or flag_single_letter_header or flag_all_caps_short)"


@query("q_audit", f"select *, {S_REVIEW} as needs_review from ({S_AUDIT})")
def audited(spark, sf):
    return audit.audit(_paragraphs(spark, sf)).drop("text_hash", "line_count_est")


@query("q_header_filter", f"select doc_id, para_id from ({S_AUDIT}) where not flag_single_letter_header")
def header_filter(spark, sf):
    return audit.without_headers(audit.audit(_paragraphs(spark, sf))).select("doc_id", "para_id")


@query("q_needs_review", f"select doc_id, para_id, text from ({S_AUDIT}) where {S_REVIEW}")
def needs_review(spark, sf):
    return audit.to_review(audit.audit(_paragraphs(spark, sf))).select("doc_id", "para_id", "text")


S_DUPLICATES = "select doc_id, min(doc_id) over (partition by text) as duplicate_group, count(*) over (partition by text) > 1 as is_duplicate from documents"


@query("q_duplicates", S_DUPLICATES)
def duplicates(spark, sf):
    return audit.mark_duplicates(_table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "duplicate_group", "is_duplicate")


@query("q_duplicates_window", S_DUPLICATES)
def duplicates_window(spark, sf):
    keyed = _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return audit.mark_duplicates_by_window(keyed, "key", "doc_id").select("doc_id", "duplicate_group", "is_duplicate")


@query("q_value_counts", "select event_type, count(*) as count from events group by 1")
def value_counts(spark, sf):
    return audit.value_counts(_table(spark, sf, "events"), "event_type")


@query("q_top_n", "select lang, source, count(*) as count from documents group by 1, 2 order by count desc, lang, source limit 10")
def top_n(spark, sf):
    return audit.value_counts(_table(spark, sf, "documents"), "lang", "source").limit(10)


@query("q_examples", "select s_suppkey, s_name || '|' || 'on ' || s_nationkey as examples from supplier")
def examples(spark, sf):
    entry = F.expr("concat('a “', s_name, '” or \" on ', s_nationkey, ' \" and “ ”.')")
    return _table(spark, sf, "supplier").select("s_suppkey", _joined(T.extract_examples(entry)).alias("examples"))


@query("q_regions", "select n_nationkey, 'KM:Kerry|' || 'Cork:' || 'Cape Clear' as regions from nation")
def regions(spark, sf):
    entry = F.expr("concat(n_name, ' (KM, Kerry), (x, Y) and (Cork,  Cape Clear)')")
    pairs = F.transform(T.extract_region_mentions(entry), lambda x: F.concat_ws(":", x["code"], x["place"]))
    return _table(spark, sf, "nation").select("n_nationkey", _joined(pairs).alias("regions"))


@query("q_xrefs", "select n_nationkey, n_name || '|B C' as targets, 'NATION' as inline from nation")
def xrefs(spark, sf):
    nation = _table(spark, sf, "nation")
    return nation.select("n_nationkey", _joined(T.split_cross_references(F.expr("concat(n_name, ' ; B C.; . ;')"))).alias("targets"), _joined(T.inline_cross_references(F.expr("concat('a thing. See ', n_name, '.')"))).alias("inline"))


@query("q_def_etym", "select n_nationkey, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then n_name else n_name || '. See X' end as definition, case when n_nationkey % 3 = 1 then null else 'Irish' end as etymology from nation")
def def_etym(spark, sf):
    tail = F.expr("case when n_nationkey % 3 = 0 then '< Irish.' when n_nationkey % 3 = 1 then concat(n_name, '. ') else concat(n_name, '; < Irish; See X.') end")
    return _table(spark, sf, "nation").select("n_nationkey", T.split_definition_etymology(tail).alias("x")).select("n_nationkey", "x.*")


# Entries made from the columns of `part`, by the rule that they reach; the second item has what the record must hold.
DASH = "‑"
_XREF = {"entry_type": "'cross_reference'", "parse_confidence": "1.0"}
PARSES: dict[str, tuple[str, dict[str, str]]] = {
    "c01": ("concat(p_name, ' /', p_brand, '/, see ', p_type, '; ', upper(p_name), '.')", {**_XREF, "pronunciation": "p_brand", "cross_references": "p_type || '|' || upper(p_name)", "parse_notes": f"'Parsed as cross{DASH}reference entry with pronunciation'"}),
    "c02": ("concat(p_name, ' n. see ', p_type)", {**_XREF, "part_of_speech": "'n.'", "cross_references": "p_type", "parse_notes": f"'Parsed as cross{DASH}reference entry with POS'"}),
    "c03": ("concat(p_name, ', see ', p_type, '.')", {**_XREF, "cross_references": "p_type", "parse_notes": f"'Parsed as cross{DASH}reference entry'"}),
    "c04": ("concat(p_name, ', see$')", {**_XREF, "parse_confidence": "0.6", "parse_notes": f"'Incomplete cross{DASH}reference target'"}),
    "c05": ("concat(p_name, ' /', p_brand, '/ n., in the phrase ', lower(p_type), ' ', p_size)", {"pronunciation": "p_brand", "part_of_speech": "'n.'", "grammatical_labels": "'in the phrase'", "definition": "lower(p_type) || ' ' || p_size", "parse_confidence": "0.96", "parse_notes": f"'Parsed as phrase/expression{DASH}labelled entry'"}),
    "c06": ("concat(p_name, ', in the expression ', lower(p_type))", {"grammatical_labels": "'in the expression'", "definition": "lower(p_type)", "parse_confidence": "0.9", "parse_notes": f"'Parsed as phrase/expression{DASH}labelled entry'"}),
    "c07": ("concat(p_name, ' are commonly used with ', lower(p_type), '.')", {"entry_type": "'grammatical_note'", "grammatical_labels": "'are commonly used'", "definition": "'with ' || lower(p_type)", "parse_confidence": "0.82", "parse_notes": f"'Parsed as grammatical{DASH}note entry'"}),
    "c08": ("concat('AB', p_size, ' abbreviation for ', p_name)", {"headword_raw": "'AB' || p_size", "grammatical_labels": "'abbreviation for'", "definition": "p_name", "parse_confidence": "0.95"}),
    "c09": ("concat(p_name, ' (', lower(p_type), '), ', p_brand, ' thing')", {"grammatical_labels": "lower(p_type)", "definition": "p_brand || ' thing'", "parse_confidence": "0.83", "parse_notes": f"'Parsed as comma{DASH}definition entry'"}),
    "c10": ("concat(p_name, ' /', p_brand, '? n. ', lower(p_type))", {"rule_branch": "'C11'", "pronunciation": "p_brand", "part_of_speech": "'n.'", "definition": "lower(p_type)", "parse_confidence": "0.9", "parse_notes": "'Recovered malformed pronunciation closer'"}),
    "c11": ("concat(p_name, ' /', p_brand, '/, /', lower(p_brand), '/ n. (old) ', lower(p_type), ' < Latin root. See ALSO THIS')", {"pronunciation": "p_brand", "pronunciation_2": "lower(p_brand)", "part_of_speech": "'n.'", "grammatical_labels": "'old'", "definition": "lower(p_type) || '. See ALSO THIS'", "etymology": "'Latin root'", "cross_references": "'ALSO THIS'", "parse_confidence": "0.9"}),
    "c12": ("concat(p_name, ' n. ', lower(p_type), ' thing')", {"part_of_speech": "'n.'", "definition": "lower(p_type) || ' thing'", "parse_confidence": "0.78"}),
    "c13": ("concat(p_name, ' also ', lower(p_type), ' thing')", {"variant_forms": "lower(p_type)", "definition": "'thing'", "parse_confidence": "0.74", "parse_notes": f"'Parsed as variant{DASH}without{DASH}pronunciation entry'"}),
    "c14": ("concat(p_name, ' ', p_brand, '/ a ', lower(p_type))", {"rule_branch": "'C11'", "pronunciation": "p_brand", "definition": "'a ' || lower(p_type)", "parse_confidence": "0.75", "parse_notes": "'POS not confidently parsed|Recovered malformed pronunciation delimiter'"}),
    "c15": ("p_type", {"headword_raw": "p_type", "entry_type": "'unparsed'", "definition": "p_type", "parse_confidence": "0.2", "parse_notes": "'Could not confidently parse entry structure'"}),
}
_STRINGS = ["headword_raw", "headword", "pronunciation", "pronunciation_2", "part_of_speech", "definition", "etymology", "entry_type", "rule_branch"]
_ARRAYS = ["variant_forms", "grammatical_labels", "cross_references", "parse_notes"]


#: Entries that the other profile reads otherwise.
PARSES_V12: dict[str, tuple[str, dict[str, str]]] = {
    "c04": ("concat(p_name, ', see.')", PARSES["c04"][1] | {"parse_notes": "'Incomplete cross-reference target'"}),
    "c11": ("concat(p_name, ' /', p_brand, '/ also fu, fo etc. n. ', lower(p_type))", {"pronunciation": "p_brand", "variant_forms": "'fu|fo'", "part_of_speech": "'n.'", "definition": "lower(p_type)", "parse_confidence": "0.9"}),
    "c12": PARSES["c12"],
}


def _parse_sql(name: str, parses: dict = PARSES) -> str:
    own = parses[name][1]
    base = {"headword_raw": "p_name", "entry_type": "'lexical'", "rule_branch": f"'{name.upper().replace('C0', 'C')}'"} | own
    base.setdefault("headword", f"lower({base['headword_raw']})")
    columns = [f"cast({base.get(c, 'null')} as varchar) as {c}" for c in _STRINGS] + [f"{base.get(c, repr(''))} as {c}" for c in _ARRAYS]
    return f"select cast(p_partkey as integer) as para_id, {', '.join(columns)}, cast({base['parse_confidence']} as double) as parse_confidence from part"


def _shown(records: DataFrame) -> DataFrame:
    return records.select("para_id", *_STRINGS, *[_joined(c).alias(c) for c in _ARRAYS], "parse_confidence")


def _parse_query(entry: str, profile: str = "src"):
    def run(spark, sf):
        rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("para_id"), F.expr(entry).alias("text"))
        return _shown(cascade.parse(rows, profile))

    return run


for _name, (_entry, _) in PARSES.items():
    query(f"q_parse_{_name}", _parse_sql(_name))(_parse_query(_entry))
for _name, (_entry, _) in PARSES_V12.items():
    query(f"q_parse_v12_{_name}", _parse_sql(_name, PARSES_V12))(_parse_query(_entry, "v12"))


@query("q_parse_mix", " union all ".join(f"(select * from ({_parse_sql(n)}) where para_id % {len(PARSES)} = {i})" for i, n in enumerate(PARSES)))
def parse_mix(spark, sf):
    """Every rule in one pass, by the row's number."""
    entry = F.expr(f"case p_partkey % {len(PARSES)} " + " ".join(f"when {i} then {e}" for i, (e, _) in enumerate(PARSES.values())) + " end")
    return _shown(cascade.parse(_table(spark, sf, "part").select(F.col("p_partkey").alias("para_id"), entry.alias("text"))))


_MIX = "case p_partkey % {n} {arms} end".format(n=len(PARSES), arms=" ".join(f"when {i} then {e}" for i, (e, _) in enumerate(PARSES.values())))


def _s_effort() -> str:
    """The rules in order up to the one that each entry is made for, and those among them whose marks the entry holds."""
    names = list(cascade.NEEDS)
    holds = lambda name: " and ".join(f"contains(e, '{m}')" for m in cascade.NEEDS[name]) or "true"
    counted = " + ".join(f"case when rank >= {i + 1} and {holds(name)} then 1 else 0 end" for i, name in enumerate(names))
    return f"select cast(p_partkey as integer) as para_id, 'C' || rank as rule, rank as in_order, cast({counted} as integer) as in_reach from (select p_partkey, lower({_MIX}) as e, cast(p_partkey % {len(PARSES)} + 1 as integer) as rank from part)"


@query("q_parse_effort", _s_effort())
def parse_effort(spark, sf):
    """How many patterns an entry meets, in order and within reach."""
    rows = _table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("para_id"), F.expr(_MIX).alias("text"))
    return cascade.pattern_evaluations(rows)


@query("q_list_clean", "select p_partkey, p_name || '|' || p_type as cleaned, p_brand || '|' || p_type as prons, lower(p_type) || '|n.' as pos, upper(p_name) || '|' || p_type as xrefs from part where p_name is not null")
def list_clean(spark, sf):
    arr = lambda *x: F.array(*[F.expr(e) for e in x])
    return spread(_table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")).select(
        "p_partkey",
        _joined(A.clean_list(arr("concat(' ', p_name, '  ')", "null", "p_name", "' '", "p_type"))).alias("cleaned"),
        _joined(A.clean_pronunciations(arr("concat('/', p_brand, '/')", "p_brand", "concat(p_type, '/')"))).alias("prons"),
        _joined(A.clean_pos(arr("p_type", "lower(p_type)", "'N.'"))).alias("pos"),
        _joined(A.clean_cross_refs(arr("p_name", "upper(p_name)", "p_type"))).alias("xrefs"),
    )


_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@query("q_list_nfkc", "select n_nationkey, 'fi' || n_name || '|' || n_name || '|x2' as cleaned, n_name || '|ff' as prons, lower(n_name) || '|ss' as pos, n_name || '|FI' as xrefs, 'x2' || lower(n_name) || '|θάι' as matched, true as inside from nation")
def list_nfkc(spark, sf):
    """Ligatures, full-width letters and other compatibility forms in lists."""
    wide = f"translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_WIDE}')"
    arr = lambda *x: F.array(*[F.expr(e) for e in x])
    matched = A.to_text_list(arr(f"concat('x²', {wide})", "'ϑᾴ'", "' '", "null"))
    return _table(spark, sf, "nation").select(
        "n_nationkey",
        _joined(A.clean_list(arr("concat('ﬁ', n_name)", wide, "n_name", "'x²'"))).alias("cleaned"),
        _joined(A.clean_pronunciations(arr(f"concat('/', {wide}, '／')", "n_name", "'/ﬀ/'"))).alias("prons"),
        _joined(A.clean_pos(arr(wide, "lower(n_name)", "'ẞ'", "'ß'"))).alias("pos"),
        _joined(A.clean_cross_refs(arr(wide, "n_name", "'ﬁ'"))).alias("xrefs"),
        _joined(matched).alias("matched"),
        T.phrase_containment(T.match_text(F.expr(f"concat('ﬁrst ', {wide}, ' ²')")), arr("concat('FI', 'RST')", wide, "'2'")).alias("inside"),
    )


_POS_MAP = {"ECONOMY": "noun|adjective", "PROMO": "verb"}


@query("q_pos_map", "select p_partkey, case p_type when 'ECONOMY' then 'noun|adjective' when 'PROMO' then 'verb' else p_type end || '/' || p_brand as mapped from part")
def pos_map(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", F.array_join(A.apply_mapping(F.array("p_type", "p_type", "p_brand"), _POS_MAP), "/").alias("mapped"))


@query("q_region_map", "select n_nationkey, 'A|' || n_name as by_value, '{''code'': ''A'', ''place'': ''' || n_name || '''}' as printed from nation")
def region_map(spark, sf):
    pairs = F.array(F.struct(F.lit("A").alias("code"), F.col("n_name").alias("place")))
    return _table(spark, sf, "nation").select("n_nationkey", _joined(A.clean_region_values(pairs)).alias("by_value"), _joined(A.clean_region_values(pairs, profile="src")).alias("printed"))


@query("q_json_flatten", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as \"data.k\" from events")
def json_flatten(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id"), F.from_json("props", "k long").alias("data"))
    return normalize.flatten_model(rows)


@query("q_json_safe", "select event_id, case event_id % 4 when 2 then null when 3 then null else cast(json_extract_string(props, '$.k') as bigint) end as k, case event_id % 4 when 2 then 'JSON parse failure' when 3 then 'reply is not an object' end as error from events")
def json_safe(spark, sf):
    reply = F.expr("case event_id % 4 when 0 then props when 1 then concat('Here: ', props, ' done') when 2 then 'no json' else '[1]' end")
    parsed = A.safe_parse_json(reply)
    return _table(spark, sf, "events").select("event_id", parsed.alias("p")).select("event_id", F.try_variant_get("p.value", "$.k", "long").alias("k"), F.col("p.error").alias("error"))


def _stub():
    """A model that answers in four ways, by the entry's last digit."""

    def ask(system: str, user: str) -> str:
        word = user.split()[-1]
        kind = int(word[-1]) % 4
        if kind == 3:
            raise TimeoutError("no reply")
        if kind == 2:
            return "I cannot say"
        body = f'{{"headword": " {word} ", "definition": {"null" if kind else f"{chr(34)}a {word}{chr(34)}"}, "pronunciations": "x", "examples": ["e", "f"], "part_of_speech": 3}}'
        return f"Sure: {body}" if kind else body

    return ask


_STUB_SQL = "select c_name as entry_id, c_custkey % 10 % 4 as kind from customer"


def _replies(spark, sf):
    rows = spread(_table(spark, sf, "customer").select(F.col("c_name").alias("entry_id"), F.col("c_name").alias("entry_text")))
    return extract.read_replies(extract.ask_model(rows, lambda: _stub(), "system", "Word: {{ entry_text }}"))


@query("q_llm_normalise", f"select entry_id, entry_id as headword, case kind when 0 then 'a ' || entry_id else '' end as definition, '3' as part_of_speech, 'x' as pronunciations, 'e|f' as examples, '' as cross_references from ({_STUB_SQL}) where kind < 2")
def llm_normalise(spark, sf):
    got = extract.good(_replies(spark, sf))
    return got.select("entry_id", "data.headword", "data.definition", "data.part_of_speech", *[_joined(f"data.{c}").alias(c) for c in ("pronunciations", "examples", "cross_references")])


@query("q_llm_validate", f"select entry_id, case when kind < 2 then false end as missing_headword, case when kind < 2 then kind = 1 end as missing_definition, case when kind < 2 then kind = 1 end as needs_review, case kind when 2 then 'JSON parse failure' when 3 then 'no reply' end as error from ({_STUB_SQL})")
def llm_validate(spark, sf):
    return _replies(spark, sf).select("entry_id", "flags.missing_headword", "flags.missing_definition", "needs_review", "error")


@query("q_resume", "select d.doc_id from documents d where d.doc_id not in (select doc_id from labels)")
def resume(spark, sf):
    entries = _table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("entry_id"))
    return extract.not_done(entries, _table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"))).select("doc_id")


@query("q_batch_window", "select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 25 offset 5")
def batch_window(spark, sf):
    entries = _table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("entry_id"))
    return extract.next_batch(entries, _table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id")), 5, 25, "doc_id").select("doc_id")


@query("q_number_paragraphs", f"select doc_id, para_id, row_number() over (order by doc_id, para_id) as number from {S_PARAGRAPHS}")
def number_paragraphs(spark, sf):
    """All paragraphs counted through, by document and place."""
    return numbering.number_rows(_paragraphs(spark, sf).select("doc_id", "para_id"), "doc_id", "para_id")


@query("q_slice_paragraphs", f"select doc_id, para_id from {S_PARAGRAPHS} order by text, doc_id, para_id limit 20000 offset 500")
def slice_paragraphs(spark, sf):
    """A long slice of the paragraphs in order of their texts."""
    rows = numbering.slice_rows(_paragraphs(spark, sf).select("doc_id", "para_id", "text"), "text", "doc_id", "para_id", skip=500, most=20_000)
    return rows.select("doc_id", "para_id")


@query("q_renumber", "select cast(row_number() over (order by l_orderkey, l_linenumber) as integer) as para_id, l_orderkey || '-' || l_linenumber as headword, 'n.' as part_of_speech from lineitem")
def renumber(spark, sf):
    """Entries of many documents numbered anew as they are parsed."""
    place = F.struct("l_orderkey", "l_linenumber")
    rows = _table(spark, sf, "lineitem").select(place.alias("para_id"), F.expr("concat(l_orderkey, '-', l_linenumber)").alias("id"))
    rows = rows.select("para_id", F.concat("id", F.lit(" n. a thing")).alias("text"))
    return cascade.parse(rows, renumber=True).select("para_id", "headword", "part_of_speech")


def _rule_records(spark, sf) -> DataFrame:
    return _table(spark, sf, "part").select(
        F.col("p_partkey").alias("entry_id"), F.expr("concat(' ', p_name, '  ', p_type)").alias("source_text"), F.col("p_name").alias("headword_raw"), F.lower("p_name").alias("headword"), F.lit(None).cast("string").alias("variant_forms_raw"),
        F.array().cast("array<string>").alias("variant_forms"), F.expr("concat('/', p_brand, '/')").alias("pronunciation"), F.expr("case when p_size % 2 = 0 then lower(p_brand) end").alias("pronunciation_2"),
        F.col("p_type").alias("part_of_speech"), F.expr("case when p_size % 5 <> 0 then concat(p_type, ' thing ', p_name) end").alias("definition"), F.array(F.lit("x"), F.lit(" x ")).alias("examples"), F.lit(" ").alias("etymology"),
        F.array(F.lower("p_type")).alias("cross_references"), F.array(F.struct(F.lit("KM").alias("code"), F.col("p_type").alias("place"))).alias("region_mentions"),
    )


def _model_records(spark, sf) -> DataFrame:
    data = F.struct(
        F.col("p_name").alias("headword_raw"), F.expr("case when p_size % 3 = 0 then upper(p_name) else concat(p_name, ' x') end").alias("headword"), F.array("p_brand").alias("pronunciations"), F.col("p_type").alias("part_of_speech"),
        F.expr("concat(p_type, ' thing')").alias("definition"), F.array(F.lit("x")).alias("examples"), F.array(F.upper("p_type")).alias("cross_references"), F.array(F.lit("KM"), F.col("p_type")).alias("region_mentions"),
    )
    rows = _table(spark, sf, "part").where("p_partkey % 3 <> 1")
    return rows.select(F.expr("concat('hde_', case when p_partkey % 7 = 0 then p_partkey + 1000000 else p_partkey end)").alias("entry_id"), F.expr("concat(p_name, ' ', case when p_partkey % 5 = 0 then 'other' else p_type end)").alias("source_text"), data.alias("data"), F.lit(None).cast("boolean").alias("needs_review"))


S_RULE = """(select cast(p_partkey as integer) as entry_id, p_name || ' ' || p_type as source_text, p_name as headword_raw, lower(p_name) as headword,
    p_brand || case when p_size % 2 = 0 then '|' || lower(p_brand) else '' end as pronunciations, lower(p_type) as part_of_speech,
    case when p_size % 5 <> 0 then p_type || ' thing ' || p_name end as definition, 'x' as examples, p_type as cross_references, 'KM|' || p_type as region_mentions, false as needs_review, p_size from part)"""
S_MODEL = """(select cast(case when p_partkey % 7 = 0 then p_partkey + 1000000 else p_partkey end as integer) as entry_id, p_name || ' ' || case when p_partkey % 5 = 0 then 'other' else p_type end as source_text,
    p_name as headword_raw, case when p_size % 3 = 0 then upper(p_name) else p_name || ' x' end as headword, p_brand as pronunciations, lower(p_type) as part_of_speech, p_type || ' thing' as definition, 'x' as examples,
    upper(p_type) as cross_references, 'KM|' || p_type as region_mentions, false as needs_review, p_size from part where p_partkey % 3 <> 1)"""
_SHOWN = ["pronunciations", "part_of_speech", "examples", "cross_references", "region_mentions"]
_S_CORE = "entry_id, source_text, headword_raw, headword, pronunciations, part_of_speech, definition, examples, cross_references, region_mentions, needs_review"


def _core(df: DataFrame) -> DataFrame:
    return df.select("entry_id", "source_text", "headword_raw", "headword", "definition", "needs_review", *[_joined(c).alias(c) for c in _SHOWN])


@query("q_normalise_rule", f"select {_S_CORE} from {S_RULE}")
def normalise_rule(spark, sf):
    return _core(normalize.normalize_rule(_rule_records(spark, sf)))


@query("q_normalise_genai", f"select {_S_CORE} from {S_MODEL}")
def normalise_genai(spark, sf):
    return _core(normalize.normalize_model(normalize.flatten_model(_model_records(spark, sf))))


def _merged(spark, sf) -> DataFrame:
    return compare.merge_outputs(normalize.normalize_rule(_rule_records(spark, sf)), normalize.normalize_model(normalize.flatten_model(_model_records(spark, sf))))


S_MERGED = f"(select coalesce(r.entry_id, g.entry_id) as entry_id, r.entry_id is not null as in_r, g.entry_id is not null as in_g, r.source_text as st_r, g.source_text as st_g, r.headword as hw_r, g.headword as hw_g, r.definition as d_r, g.definition as d_g, r.pronunciations as p_r, g.pronunciations as p_g, coalesce(r.p_size, g.p_size) as p_size from {S_RULE} r full outer join {S_MODEL} g on r.entry_id is not distinct from g.entry_id)"
_S_SIDE = "case when in_r and in_g then 'both' when in_r then 'left_only' else 'right_only' end"
_S_SAME = "lower(coalesce(st_r, '')) = lower(coalesce(st_g, ''))"


@query("q_merge", f"select entry_id, st_r as source_text_rule, st_g as source_text_genai, hw_r as headword_rule, hw_g as headword_genai, {_S_SIDE} as _merge, {_S_SAME} as source_text_exact_match from {S_MERGED}")
def merge(spark, sf):
    return _merged(spark, sf).select("entry_id", "source_text_rule", "source_text_genai", "headword_rule", "headword_genai", "_merge", "source_text_exact_match")


def _s_presence(name: str, a: str, b: str) -> str:
    return f"select '{name}' as field, count(*) filter ({a} is not null and {b} is not null) as both_present, count(*) filter ({a} is not null and {b} is null) as rule_only, count(*) filter ({a} is null and {b} is not null) as genai_only, count(*) filter ({a} is null and {b} is null) as both_missing from {S_MERGED}"


_PAIRS = {"headword": ("hw_r", "hw_g"), "definition": ("d_r", "d_g"), "pronunciations": ("p_r", "p_g"), "etymology": ("cast(null as varchar)", "cast(null as varchar)")}


@query("q_presence", " union all ".join(_s_presence(k, *v) for k, v in _PAIRS.items()))
def presence(spark, sf):
    return compare.presence_summary(_merged(spark, sf), list(_PAIRS))


@query("q_exact_match", f"select 'headword' as field, avg(cast(lower(coalesce(hw_r, '')) = lower(coalesce(hw_g, '')) as double)) as exact_match_rate from {S_MERGED} union all select 'definition', avg(cast(lower(coalesce(d_r, '')) = lower(coalesce(d_g, '')) as double)) from {S_MERGED} union all select 'pronunciations', avg(cast(coalesce(p_r, '') = coalesce(p_g, '') as double)) from {S_MERGED}")
def exact_match(spark, sf):
    return compare.exact_match_summary(_merged(spark, sf), ["headword", "definition", "pronunciations"])


@query("q_alignment", f"select {_S_SIDE} as _merge, count(*) as rows, count(*) filter ({_S_SAME}) as matches, avg(cast({_S_SAME} as double)) as match_rate from {S_MERGED} group by 1")
def alignment(spark, sf):
    return compare.alignment_summary(_merged(spark, sf))


@query("q_misaligned", f"select entry_id from {S_MERGED} where in_r and in_g and not {_S_SAME}")
def misaligned(spark, sf):
    return compare.misaligned(_merged(spark, sf)).select("entry_id")


@query("q_qc_empty", f"select 'definition' as field, count(*) filter (d_r is null) as rule_empty, count(*) filter (d_g is null) as genai_empty from {S_MERGED} union all select 'headword', count(*) filter (hw_r is null), count(*) filter (hw_g is null) from {S_MERGED} union all select 'pronunciations', count(*) filter (p_r is null), count(*) filter (p_g is null) from {S_MERGED}")
def qc_empty(spark, sf):
    return compare.empty_counts(_merged(spark, sf), ["definition", "headword", "pronunciations"])


@query("q_tokens", f"select doc_id, len({s_words('text')}) as tokens, sha256(array_to_string({s_words('text')}, '|')) as tokens_sha256 from documents")
def tokens(spark, sf):
    words = _table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("tokens"), F.sha2(_joined("words"), 256).alias("tokens_sha256"))


@query("q_lines", "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines, regexp_matches(text, '[^\\x00-\\x7F]') as non_ascii from documents")
def lines(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.line_count("text").cast("long").alias("lines"), T.non_ascii("text").alias("non_ascii"))


def _turns(spark, sf) -> DataFrame:
    c = _table(spark, sf, "conversations")
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")), ["conv_id", "turn"]).withColumn("pair", F.format_string("%d/%d", "conv_id", "turn"))


S_TURNS = "(select u.conv_id || '/' || u.turn as pair, u.text as source, a.text as output from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"
S_BAGS = f"(select pair, token, sum(s) as s, sum(o) as o from (select pair, unnest({s_words('source')}) as token, 1 as s, 0 as o from {S_TURNS} union all select pair, unnest({s_words('output')}), 0, 1 from {S_TURNS}) group by 1, 2)"


@query("q_unordered", f"select pair, cast(n_source as bigint) as n_source, cast(n_output as bigint) as n_output, cast(matched as bigint) as matched, round(matched / nullif(n_output, 0), 6) as precision, round(matched / nullif(n_source, 0), 6) as recall, round(2.0 * matched / nullif(n_output + n_source, 0), 6) as f1 from (select pair, cast(sum(s) as double) as n_source, cast(sum(o) as double) as n_output, cast(sum(least(s, o)) as double) as matched from {S_BAGS} group by 1)")
def unordered(spark, sf):
    got = metrics.unordered_match_rows(_turns(spark, sf), "pair", "source", "output")
    f1 = F.when((F.col("n_output") > 0) & (F.col("n_source") > 0), F.coalesce("f1", F.lit(0.0))).otherwise(F.col("f1"))
    return got.withColumn("f1", f1).select("pair", "n_source", "n_output", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _turn_tokens(spark, sf) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", T.tokenize("source").alias("src"), T.tokenize("output").alias("out"))


def _s_walk(steps: str, through: str, lost: str) -> str:
    """Tokens of one side walked through the other's, one a step; `lost` is the place after a token that is not found."""
    return f"""with recursive t as (select conv_id, turn, {s_words('source')} as src, {s_words('output')} as out from (select u.conv_id, u.turn, u.text as source, a.text as output from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')),
    walk as (select conv_id, turn, src, out, 0 as i, 0 as pos, 0 as n from t union all
        select conv_id, turn, src, out, i + 1, case when p > 0 then pos + p else {lost} end, n + cast(p > 0 as integer) from (select *, cast(coalesce(list_position({through}[pos + 1:], {steps}[i + 1]), 0) as integer) as p from walk where i < len({steps})))
    select conv_id, turn, n as matched, round(n / nullif(len(out), 0), 6) as precision, round(n / nullif(len(src), 0), 6) as recall from walk where i = len({steps})"""


@query("q_ordered_out", _s_walk("out", "src", "pos"))
def ordered_out(spark, sf):
    return _turn_tokens(spark, sf).select("conv_id", "turn", metrics.ordered_match_output_driven(F.col("src"), F.col("out")).alias("m")).select("conv_id", "turn", "m.matched", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


@query("q_ordered_src", _s_walk("src", "out", "len(out)"))
def ordered_src(spark, sf):
    return _turn_tokens(spark, sf).select("conv_id", "turn", metrics.ordered_match_source_driven(F.col("src"), F.col("out")).alias("m")).select("conv_id", "turn", "m.matched", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


_FIELDS = {"headword": "string", "definition": "string", "pronunciations": "array"}


def _s_items(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda x: {s_match('x')}), lambda x: x <> '')"


_S_SYSTEM = " union all ".join(
    f"select entry_id, '{field}' as field, '{system}' as system, {s_words(f'st_{s}')} as src, {s_words(text.format(s))} as out, {s_match(f'st_{s}')} as source, {_s_items(items.format(s))} as items from merged"
    for field, text, items in (("headword", "hw_{0}", "case when hw_{0} is not null then [hw_{0}] end"), ("definition", "d_{0}", "case when d_{0} is not null then [d_{0}] end"), ("pronunciations", "replace(p_{0}, '|', ' ')", "string_split(p_{0}, '|')"))
    for system, s in (("rule", "r"), ("genai", "g"))
)
#: The six metrics of every entry, field and system, and whether the output's items stand in the source.
S_METRICS = f"""with recursive merged as materialized (select * from {S_MERGED}), f as materialized ({_S_SYSTEM}),
    walk as (select entry_id, field, system, src, out, 0 as i, 0 as pos, 0 as n from f union all
        select entry_id, field, system, src, out, i + 1, pos + p, n + cast(p > 0 as integer) from (select *, cast(coalesce(list_position(src[pos + 1:], out[i + 1]), 0) as integer) as p from walk where i < len(out))),
    counted as (select f.*, w.n, coalesce(list_sum(list_transform(list_distinct(f.out), lambda x: least(len(list_filter(f.src, lambda y: y = x)), len(list_filter(f.out, lambda y: y = x))))), 0) as u,
        len(list_filter(f.items, lambda x: contains(f.source, x))) as inside from f join walk w using (entry_id, field, system) where w.i = len(f.out)),
    m as (select entry_id, field, system, u / nullif(len(out), 0) as up, u / nullif(len(src), 0) as ur, n / nullif(len(out), 0) as op, n / nullif(len(src), 0) as r, inside = len(items) as whole, inside / nullif(len(items), 0) as coverage from counted)"""


@query(
    "q_token_summary",
    f"{S_METRICS} select field, system, round(avg(up), 6) as unordered_precision, round(avg(ur), 6) as unordered_recall, round(avg(2 * up * ur / nullif(up + ur, 0)), 6) as unordered_f1, round(avg(op), 6) as ordered_precision, round(avg(r), 6) as ordered_recall, round(avg(2 * op * r / nullif(op + r, 0)), 6) as ordered_f1 from m group by 1, 2",
)
def token_summary(spark, sf):
    got = metrics.token_summary(metrics.field_metrics(_merged(spark, sf), _FIELDS, paired=True))
    return got.select("field", "system", *[F.round(c, 6).alias(c) for c in got.columns[2:]])


@query("q_containment_report", f"select cast(entry_id as integer) as entry_id, coalesce(contains(lower(st_g), lower(hw_g)), true) as all_output_in_source from {S_MERGED}")
def containment_report(spark, sf):
    got = metrics.field_metrics(_merged(spark, sf), {"headword": "string"}).where("system = 'genai'")
    return got.select("entry_id", "all_output_in_source")


@query("q_phrase", f"select doc_id, contains({s_match('text')}, {s_match('lang')}) as one, contains({s_match('text')}, {s_match('lang')}) and contains({s_match('text')}, {s_match('source')}) as both_in from documents where lang is not null and source is not null union all select doc_id, true, true from documents where lang is null or source is null")
def phrase(spark, sf):
    """Whether a document's language, and its source too, are named in its whole text; null phrases ask for nothing."""
    matched, known = T.match_text("text"), F.col("lang").isNotNull() & F.col("source").isNotNull()
    asked = lambda *c: T.phrase_containment(matched, F.when(known, F.array(*c)))
    return _table(spark, sf, "documents").select("doc_id", asked("lang").alias("one"), asked("lang", "source").alias("both_in"))


@query("q_length_diag", f"select entry_id, cast(length(coalesce(st_r, st_g)) as integer) as source_char_len, cast(coalesce(length(hw_r), 0) + coalesce(length(d_r), 0) as integer) as extracted_char_len_rule, coalesce((coalesce(length(hw_r), 0) + coalesce(length(d_r), 0)) / length(coalesce(st_r, st_g)) > 1.2, false) as possible_overgeneration_rule from {S_MERGED}")
def length_diag(spark, sf):
    got = metrics.length_diagnostics(_merged(spark, sf), {"headword": "string", "definition": "string"})
    return got.select("entry_id", "source_char_len", "extracted_char_len_rule", "possible_overgeneration_rule")


def _s_flag_rate(flag: str, side: str) -> str:
    own, source = (f"hw_{side[0]}", f"d_{side[0]}"), "coalesce(st_r, st_g)"
    size = s_word_len if flag == "omission" else lambda x: f"coalesce(length({x}), 0)"
    ratio = f"({size(own[0])} + {size(own[1])}) / nullif({size(source)}, 0)"
    return f"select 'possible_{flag}_{side}' as metric, avg(cast(coalesce({ratio} {'< 0.8' if flag == 'omission' else '> 1.2'}, false) as double)) as rate from {S_MERGED}"


@query("q_length_summary", " union all ".join(_s_flag_rate(flag, side) for flag in ("overgeneration", "omission") for side in ("rule", "genai")))
def length_summary(spark, sf):
    return metrics.length_summary(metrics.length_diagnostics(_merged(spark, sf), {"headword": "string", "definition": "string"}))


@query(
    "q_failures",
    f"{S_METRICS} select entry_id, field, system, 'phrase' as kind, round(coalesce(coverage, 0), 6) as value from m where not whole union all select entry_id, field, system, 'unordered', round(up, 6) from m where up < 1 union all select entry_id, field, system, 'ordered', round(op, 6) from m where op < 1",
)
def failures(spark, sf):
    got = metrics.failures(metrics.field_metrics(_merged(spark, sf), _FIELDS, paired=True))
    return got.withColumn("value", F.round("value", 6))


def _order_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("para_id"), F.col("o_orderpriority").alias("source_text"), F.col("o_orderstatus").alias("entry_type"), F.col("o_custkey").cast("string").alias("headword"))
    new = o.where("para_id % 11 <> 3").withColumns({"para_id": F.expr("case when para_id % 13 = 5 then para_id + 10000000 else para_id end"), "entry_type": F.expr("case when para_id % 7 = 1 then 'X' else entry_type end"), "source_text": F.expr("case when para_id % 5 = 2 then 'new' else source_text end")})
    return o, new


@query("q_run_hash", "select o_orderkey as para_id, sha256('{\"entry_type\":\"' || o_orderstatus || '\",\"headword\":\"' || o_custkey || '\"}') as parse_hash from orders")
def run_hash(spark, sf):
    old, _ = _order_runs(spark, sf)
    return runs.build_parsed(old, ["entry_type", "headword"]).select("para_id", "parse_hash")


@query(
    "q_run_diff",
    """with o as (select o_orderkey as k, o_orderpriority as st, o_orderstatus as et from orders),
    n as (select case when k % 13 = 5 then k + 10000000 else k end as k, case when k % 5 = 2 then 'new' else st end as st, case when k % 7 = 1 then 'X' else et end as et from o where k % 11 <> 3)
    select coalesce(o.k, n.k) as para_id, case when n.k is null then 'removed' when o.k is null then 'added' when o.et = n.et then 'unchanged' else 'changed' end as change_status,
    case when o.et <> n.et then 'entry_type' else '' end as changed_columns, case when o.et <> n.et then 1 else 0 end as num_changed_columns, coalesce(o.st <> n.st, false) as source_changed from o full outer join n on o.k = n.k""",
)
def run_diff(spark, sf):
    old, new = _order_runs(spark, sf)
    got = runs.compare_runs(old, new, compare=["entry_type", "headword"])
    return got.select("para_id", "change_status", _joined("changed_columns").alias("changed_columns"), "num_changed_columns", F.coalesce("source_changed", F.lit(False)).alias("source_changed"))


@query("q_run_registry", "select cast(n_nationkey as integer) as run_id, case when n_nationkey % 2 = 0 then 'done' else n_name end as notes, cast(lag(n_nationkey) over (order by n_nationkey) as integer) as previous_run_id from nation")
def run_registry(spark, sf):
    n = _table(spark, sf, "nation")
    rows = n.select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("notes"), F.lit(0).alias("version"))
    rows = rows.unionByName(n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("run_id"), F.lit("done").alias("notes"), F.lit(1).alias("version")))
    return runs.with_previous(runs.latest(rows)).select("run_id", "notes", "previous_run_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems joined on the entry, and presence reported by field."""
    return compare.presence_summary(_merged(spark, sf_dir))
