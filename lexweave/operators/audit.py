"""Measures and flags of paragraphs, and duplicates among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Thresholds of the flags.
SHORT, LONG, FEW_WORDS, HEADING_WORDS = 25, 1200, 3, 6
FLAGS = ["flag_short", "flag_long", "flag_low_word_count", "flag_possible_heading", "flag_single_letter_header", "flag_all_caps_short"]


def audit(df: DataFrame, duplicates: bool = False) -> DataFrame:
    """Ten measures and six flags for each row of (.., text); null text counts as empty.

    needs_review is true where any flag is; with `duplicates` also where the text occurs twice.
    """
    t = F.coalesce("text", F.lit(""))
    out = df.withColumns({
        "char_count": F.length(t), "word_count": T.word_len(t), "line_count_est": T.line_count(t), "starts_with": F.left(t, F.lit(20)), "ends_with": F.right(t, F.lit(20)),
        "has_digit": t.rlike(r"\p{Nd}"), "has_brackets": t.rlike(r"[\[\]()]"), "has_slash": F.contains(t, F.lit("/")), "has_semicolon": F.contains(t, F.lit(";")),
        "has_colon": F.contains(t, F.lit(":")), "has_quote": t.rlike("[\"'“”‘’]"), "non_ascii": T.non_ascii(t),
    })
    out = out.withColumns({
        "flag_short": F.col("char_count") < SHORT,
        "flag_long": F.col("char_count") > LONG,
        "flag_low_word_count": F.col("word_count") <= FEW_WORDS,
        "flag_possible_heading": (F.col("word_count") <= HEADING_WORDS) & ~t.rlike("[.;:!?]"),
        "flag_single_letter_header": T.strip(t).rlike(r"^[A-Z]\z"),
        "flag_all_caps_short": t.rlike(r"^[A-Z&\- ]{1,8}\z") & (F.col("word_count") <= 2),
    })
    flags = list(FLAGS)
    if duplicates:
        out = mark_duplicates(out)
        flags.append("is_duplicate")
    return out.withColumn("needs_review", any_of(flags))


def any_of(flags: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])


def mark_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "para_id") -> DataFrame:
    """is_duplicate and duplicate_group (least id) of equal texts.

    Counts are summed before they are dealt and joined back by a hash of the text, so a text
    that makes up much of the table is neither sorted nor gathered.
    """
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = df.withColumn("_key", key).withColumn("_null", F.col(text_col).isNull())
    groups = keyed.groupBy("_key", "_null").agg(F.count("*").alias("_n"), F.min(id_col).alias("duplicate_group"))
    return keyed.join(groups, ["_key", "_null"]).withColumn("is_duplicate", F.col("_n") > 1).drop("_key", "_null", "_n")


def mark_duplicates_by_window(df: DataFrame, text_col: str = "text", id_col: str = "para_id") -> DataFrame:
    """The same as mark_duplicates, as windows over each text."""
    w = Window.partitionBy(text_col)
    return df.withColumn("duplicate_group", F.min(id_col).over(w)).withColumn("is_duplicate", F.count("*").over(w) > 1)


def without_headers(audited: DataFrame) -> DataFrame:
    return audited.where(~F.col("flag_single_letter_header"))


def to_review(df: DataFrame) -> DataFrame:
    return df.where("needs_review")


def without_skipped(records: DataFrame) -> DataFrame:
    return records.where(~F.col("entry_type").eqNullSafe("skip"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, nulls too, most first."""
    return df.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *columns)


def batch_window(df: DataFrame, skip: int, most: int, order: str = "entry_id") -> DataFrame:
    """Rows after the first `skip` in order, `most` of them."""
    return df.orderBy(order).offset(skip).limit(most)
