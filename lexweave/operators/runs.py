"""Run registry, record hashes and the difference of two runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import parse_hash
from ..functions.text import hash_text
from ..schemas import COMPARE_COLS
from ..sources.store import Store

REGISTRY = (
    "run_id int, run_name string, timestamp_utc string, parser_label string, parser_code_version string, notes string, previous_run_id int, docx_path string, "
    "audit_file string, parsed_file string, comparison_file string, n_raw_paragraphs long, n_clean_paragraphs long, n_records long, change_summary string, version int"
)


def build_parsed(records: DataFrame, compare: list[str] = COMPARE_COLS) -> DataFrame:
    """Records with source_hash and parse_hash in front; absent compared columns come as null, key columns must exist."""
    for c in ("para_id", "source_text"):
        if c not in records.columns:
            raise ValueError(f"records lack {c}")
    full = records.withColumns({c: F.lit(None).cast("string") for c in compare if c not in records.columns})
    full = full.withColumns({"source_hash": hash_text("source_text"), "parse_hash": parse_hash(compare)})
    head = ["para_id", "id", "source_text", "source_hash", "parse_hash", *compare]
    return full.select(*[c for c in head if c in full.columns], *[c for c in full.columns if c not in head])


def compare_runs(old: DataFrame, new: DataFrame, key: str = "para_id", compare: list[str] = COMPARE_COLS, null_keys: bool = True) -> DataFrame:
    """Full outer join of two runs with change_status, changed_columns, their number, source_changed and parse_changed.

    Null keys meet each other; values are compared by type, null equal to null. Runs whose keys are never null may say so
    by `null_keys=False`: the join is then one of plain equality, for which buckets and sorted tables serve.
    """
    keep = ["source_text", "source_hash", "parse_hash", *[c for c in compare if c in old.columns and c in new.columns]]
    compare = keep[3:]
    side = lambda df, s: df.select(F.col(key).alias(f"_k_{s}"), F.lit(True).alias(f"_in_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in keep])
    hashed = lambda df: df if "parse_hash" in df.columns else df.withColumns({"source_hash": hash_text("source_text"), "parse_hash": parse_hash(compare)})
    same = F.col("_k_old").eqNullSafe(F.col("_k_new")) if null_keys else F.col("_k_old") == F.col("_k_new")
    both = side(hashed(old), "old").join(side(hashed(new), "new"), same, "full")
    met = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    status = F.when(F.col("_in_new").isNull(), "removed").when(F.col("_in_old").isNull(), "added").when(F.col("parse_hash_old") == F.col("parse_hash_new"), "unchanged").otherwise("changed")
    changed = F.array_compact(F.array(*[F.when(met & ~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new")), c) for c in compare]))
    out = both.select(F.coalesce("_k_old", "_k_new").alias(key), *[F.col(f"{c}_{s}") for c in keep for s in ("old", "new")], status.alias("change_status"), changed.alias("changed_columns"), (met & (F.col("source_hash_old") != F.col("source_hash_new"))).alias("source_changed"))
    return out.withColumns({"num_changed_columns": F.size("changed_columns"), "parse_changed": F.col("change_status") == "changed"})


class Registry:
    """Append-only table of runs, safe for writers side by side.

    A run's id, and the number of each of its versions, is claimed by a file that only one writer can create. A version
    holds the fields that it sets; reading takes each field from the newest version that has it, so updates of different
    fields at the same time all count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)

    def frame(self) -> DataFrame:
        """Each run with its newest values and the id of the run before it."""
        try:
            rows = self.spark.read.schema(REGISTRY).parquet(self.path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            return self.spark.createDataFrame([], REGISTRY)
        return latest(rows)

    def _claim(self, name: str, first: int) -> int:
        """The lowest number from `first` on that nobody has."""
        taken = [int(n.rpartition("-")[2]) for n in self.store.names("_claims") if n.startswith(name)]
        number = max([first, *(t + 1 for t in taken)])
        while not self.store.claim(f"_claims/{name}{number:09d}", ""):
            number += 1
        return number

    def _add(self, values: dict) -> None:
        kinds = [f.split() for f in REGISTRY.split(", ")]
        row = self.spark.createDataFrame([tuple(values.get(name) for name, _ in kinds)], REGISTRY)
        if values["version"] == 0:
            row = row.withColumn("timestamp_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"))
        aside = f"_rows/{uuid.uuid4().hex}"  # Spark's own appends to one folder can't run side by side
        row.coalesce(1).write.parquet(self.store.full(aside))
        for part in (n for n in self.store.names(aside) if n.startswith("part-")):
            self.store.move(f"{aside}/{part}", part)
        self.store.delete(aside)

    def start(self, parser_label: str, parser_code_version: str, docx_path: str = "", notes: str = "") -> int:
        last = self.frame().agg(F.max("run_id")).first()[0] or 0
        run = self._claim("run-", last + 1)
        self._add({"run_id": run, "run_name": f"run_{run:03d}", "parser_label": parser_label, "parser_code_version": parser_code_version, "notes": notes, "previous_run_id": run - 1 or None, "docx_path": docx_path, "version": 0})
        return run

    def update(self, run_id: int, **values) -> None:
        """Set fields of a run; null sets nothing."""
        unknown = set(values) - {f.split()[0] for f in REGISTRY.split(", ")}
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        kinds = dict(f.split() for f in REGISTRY.split(", "))
        typed = {k: v if v is None or kinds[k] == "string" else int(v) for k, v in values.items()}
        now = self.frame().where(F.col("run_id") == run_id).select("version").first()
        if now is None:
            raise ValueError(f"no run {run_id}")
        self._add(typed | {"run_id": run_id, "version": self._claim(f"version-{run_id:09d}-", now["version"] + 1)})

    def previous(self, run_id: int) -> DataFrame:
        runs = self.frame()
        before = runs.where(F.col("run_id") == run_id).select(F.col("previous_run_id").alias("run_id"))
        return runs.join(before, "run_id", "left_semi")


def latest(rows: DataFrame) -> DataFrame:
    """Each run once, each field from the newest version that has it."""
    version = F.col("version")
    fields = [F.max(version).alias(c) if c == "version" else F.max_by(c, F.when(F.col(c).isNotNull(), version)).alias(c) for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(*fields).select(*rows.columns)


def with_previous(runs: DataFrame) -> DataFrame:
    """previous_run_id from the order of ids; a registry is small, so one window does."""
    return runs.withColumn("previous_run_id", F.lag("run_id").over(Window.orderBy("run_id")))


