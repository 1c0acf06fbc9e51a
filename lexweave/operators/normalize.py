"""Both kinds of records in one schema of fourteen fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..schemas import CORE_FIELDS
from .spreading import spread


def flatten_model(df: DataFrame) -> DataFrame:
    """Fields of `data` and `flags` as columns `data.x` and `flags.x`, without a join."""
    rest = [c for c in df.columns if c not in ("data", "flags")]
    nested = [F.col(f"{s}.`{f}`").alias(f"{s}.{f}") for s in ("data", "flags") if s in df.columns for f in df.schema[s].dataType.names]
    return df.select(*rest, *nested)


def _widened(df: DataFrame, name: str) -> Column:
    """A column that may be text, an array or a variant, as an array."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "variant":
        return F.coalesce(F.try_variant_get(c, "$", "array<string>"), A.ensure_list(F.try_variant_get(c, "$", "string")))
    return A.ensure_list(c, "array" if kind.startswith("array") else "string")


def _record(columns: dict[str, Column]) -> list[Column]:
    return [columns[c].alias(c) for c in CORE_FIELDS]


def normalize_rule(df: DataFrame, id_col: str = "entry_id", region_profile: str = "v12") -> DataFrame:
    """Rule records to the canonical schema; absent columns count as null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    prons = [c for c in ("pronunciation", "pronunciation_2", "pronunciation_3", "pronunciation_4") if c in df.columns]
    region = dict(df.dtypes).get("region_mentions", "array<string>")
    columns = {c: T.clean_text(has(c)) for c in ("source_text", "headword_raw", "headword", "variant_forms_raw", "definition", "etymology")}
    columns |= {
        "entry_id": T.int_from_id(id_col),
        "variant_forms": A.clean_list("variant_forms"),
        "pronunciations": A.rule_pronunciations(*prons),
        "part_of_speech": A.clean_pos(_widened(df, "part_of_speech")),
        "examples": A.clean_examples("examples"),
        "cross_references": A.clean_cross_refs("cross_references"),
        "region_mentions": A.clean_region_values("region_mentions", "struct" if "struct" in region else "string", region_profile),
        "needs_review": F.coalesce(has("needs_review").cast("boolean"), F.lit(False)),
    }
    return spread(df).select(*_record(columns))


def normalize_model(df: DataFrame, id_offset: int = 0) -> DataFrame:
    """Flattened model records (columns `data.x`) to the canonical schema."""
    at = lambda c: F.col(f"`data.{c}`") if f"data.{c}" in df.columns else F.lit(None).cast("string")
    lists = lambda c: _widened(df, f"data.{c}") if f"data.{c}" in df.columns else F.array().cast("array<string>")
    columns = {c: T.clean_text(at(c)) for c in ("headword_raw", "headword", "variant_forms_raw", "definition", "etymology")}
    columns |= {
        "entry_id": T.int_from_id("entry_id") + id_offset,
        "source_text": T.clean_text("source_text"),
        "variant_forms": A.clean_list(lists("variant_forms")),
        "pronunciations": A.clean_pronunciations(lists("pronunciations")),
        "part_of_speech": A.clean_pos(lists("part_of_speech")),
        "examples": A.clean_examples(lists("examples")),
        "cross_references": A.clean_cross_refs(lists("cross_references")),
        "region_mentions": A.clean_region_values(lists("region_mentions"), "string"),
        "needs_review": F.coalesce("needs_review", F.lit(False)) if "needs_review" in df.columns else F.lit(False),
    }
    return spread(df).select(*_record(columns))


def apply_maps(df: DataFrame, pos_map: dict[str, str] | None = None, region_map: dict[str, str] | None = None) -> DataFrame:
    """Labels and places by their maps; without a map they stay."""
    return df.withColumns({"part_of_speech": A.apply_mapping("part_of_speech", pos_map), "region_mentions": A.apply_mapping("region_mentions", region_map)})


def without_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not in a list of codes to drop."""
    return df.join(codes.select(F.col(codes.columns[0]).alias(column)).distinct(), column, "left_anti")
