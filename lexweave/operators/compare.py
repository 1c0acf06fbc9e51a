"""Joining two systems' records and reporting presence, agreement and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..schemas import COMPARED, CORE_FIELDS, LIST_FIELDS, TEXT_FIELDS

# Presence of a field on the two sides.
STATUSES = ["both_present", "rule_only", "genai_only", "both_missing"]


def merge_outputs(rule: DataFrame, genai: DataFrame, key: str = "entry_id", fields: list[str] | None = None) -> DataFrame:
    """Full outer join on the key, where null meets null.

    Columns are suffixed _rule and _genai; _merge tells the side, and source_text_exact_match whether
    both sides hold the same text. A repeated key gives every pair, as an outer join does.
    """
    fields = fields or [c for c in CORE_FIELDS if c != key]
    left = rule.select(F.col(key).alias("_k_rule"), F.lit(True).alias("_in_rule"), *[F.col(c).alias(f"{c}_rule") for c in fields])
    right = genai.select(F.col(key).alias("_k_genai"), F.lit(True).alias("_in_genai"), *[F.col(c).alias(f"{c}_genai") for c in fields])
    both = left.join(right, F.col("_k_rule").eqNullSafe(F.col("_k_genai")), "full")
    side = F.when(F.col("_in_rule") & F.col("_in_genai"), "both").when(F.col("_in_rule"), "left_only").otherwise("right_only")
    same = [T.exact_text_match("source_text_rule", "source_text_genai").alias("source_text_exact_match")] if "source_text" in fields else []
    values = [F.col(f"{c}_{s}") for c in fields for s in ("rule", "genai")]
    return both.select(F.coalesce("_k_rule", "_k_genai").alias(key), *values, side.alias("_merge"), *same)


def _kind(df: DataFrame, column: str) -> str:
    kind = dict(df.dtypes)[column]
    return "array" if kind.startswith("array") else "map" if kind.startswith("map") else kind if kind in ("string", "double") else "other"


def presence_status(a_missing: Column, b_missing: Column) -> Column:
    return F.when(~a_missing & ~b_missing, "both_present").when(~a_missing, "rule_only").when(~b_missing, "genai_only").otherwise("both_missing")


def with_presence(merged: DataFrame, fields: list[str] = COMPARED) -> DataFrame:
    missing = lambda c: T.is_nullish(c, _kind(merged, c))
    return merged.withColumns({f"{f}_status": presence_status(missing(f"{f}_rule"), missing(f"{f}_genai")) for f in fields})


def _long(row: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    """One row per field from columns `field|name` of a single row."""
    items = [F.struct(F.lit(f).alias("field"), *[F.col(f"`{f}|{n}`").alias(n) for n in names]) for f in fields]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def presence_summary(merged: DataFrame, fields: list[str] = COMPARED) -> DataFrame:
    """Counts of the four statuses a field, in one pass; always all four columns."""
    marked = with_presence(merged, fields)
    row = marked.agg(*[F.count_if(F.col(f"{f}_status") == s).alias(f"{f}|{s}") for f in fields for s in STATUSES])
    return _long(row, fields, STATUSES).orderBy("field")


def field_exact_match(merged: DataFrame, name: str, nfkc: bool = True) -> Column:
    a, b = f"{name}_rule", f"{name}_genai"
    if name in TEXT_FIELDS:
        return T.exact_text_match(a, b, nfkc)
    if name in LIST_FIELDS:
        return A.exact_list_match(a, b)
    return A.exact_list_match(A.ensure_list(a), A.ensure_list(b))


def exact_match_summary(merged: DataFrame, fields: list[str] = COMPARED) -> DataFrame:
    """Share of rows whose two values agree, nothing on both sides agreeing; over all rows of the join."""
    row = merged.agg(*[F.avg(field_exact_match(merged, f).cast("double")).alias(f"{f}|exact_match_rate") for f in fields])
    return _long(row, fields, ["exact_match_rate"]).orderBy(F.desc("exact_match_rate"), "field")


def alignment_summary(merged: DataFrame) -> DataFrame:
    same = F.col("source_text_exact_match").cast("int")
    return merged.groupBy("_merge").agg(F.count("*").alias("rows"), F.sum(same).cast("long").alias("matches"), F.avg(same).alias("match_rate"))


def misaligned(merged: DataFrame) -> DataFrame:
    return merged.where((F.col("_merge") == "both") & ~F.col("source_text_exact_match"))


def empty_counts(merged: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Empty values a field on either side."""
    fields = fields or [c for c in CORE_FIELDS if c != "entry_id"]
    count = lambda c: F.count_if(T.is_nullish(c, _kind(merged, c)))
    row = merged.agg(*[count(f"{f}_{s}").alias(f"{f}|{s}_empty") for f in fields for s in ("rule", "genai")])
    return _long(row, fields, ["rule_empty", "genai_empty"]).orderBy("field")
