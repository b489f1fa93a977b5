"""Sinks: named results, reports, line files, manifests, incremental rows, caches by length."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.operators.balance import check_mode, ratio_token


def digest_of(spec: dict) -> str:
    return hashlib.sha1(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10]


def result_name(names: Sequence[str], ratio: float, dedup: str, mode: str, multiplier: float) -> str:
    """File name of a combined result: sources, rules and a digest of them. The mode ``mixed`` is not part of either, the multiplier only where it is used."""
    mode = check_mode(mode, ratio, multiplier)
    ratio = 0.5 if mode != "mixed" else ratio
    spec = {"dataset_names": list(names), "duplicate_detection": dedup, "empty_email_filter": "subject_or_body", "spam_ham_ratio": ratio}
    tokens = [f"dedupe_{dedup}"]
    if mode != "mixed":
        spec["combination_mode"] = mode
        tokens.append(f"mode_{mode}")
    if mode == "source_aware_50_50":
        spec["source_aware_max_multiplier"] = multiplier
        tokens.append(f"max{float(multiplier):g}x".replace(".", "_"))
    return "__".join([*names, *tokens, ratio_token(ratio), digest_of(spec)]) + ".parquet"


def report_name(names: Sequence[str], ratio: float, dedup: str) -> str:
    spec = {"dataset_names": list(names), "duplicate_detection": dedup, "empty_email_filter": "subject_or_body", "report": "duplicates", "spam_ham_ratio": ratio}
    return "__".join([*names, f"dedupe_{dedup}", ratio_token(ratio), digest_of(spec), "duplicates"]) + ".csv"


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A new parquet folder; one that is there already is an error. by: partition columns, such as the length of a token cache."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], extras: bool = False, mode: str = "errorifexists", single: bool = True) -> None:
    """CSV with the given columns in order (null where missing); others are left out or, with extras, follow sorted. single: one file, for small reports."""
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    cols += [F.col(f"`{c}`") for c in sorted(set(df.columns) - set(columns))] if extras else []
    out = df.select(*cols)
    (out.coalesce(1) if single else out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows of one unit of work beside those already written; a unit written twice is the caller's key to drop."""
    df.write.mode("append").parquet(path)


def pending(units: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """The units without a completed row: what a resumed run still has to do. Failed ones are done again."""
    return units.join(done.where("status = 'completed'").select(*key).distinct(), list(key), "left_anti")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text file of the column's non-empty values."""
    df.where(F.col(column) != "").select(column).write.mode("errorifexists").text(path)


def write_json(path: str, value: dict) -> None:
    """A JSON document with sorted keys, put in place at once by a rename."""
    part = f"{path}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    os.replace(part, path)


def checked(path: str, sha256: str) -> str:
    """path, if the file has the checksum."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    if h.hexdigest() != sha256:
        raise ValueError(f"{path}: checksum {h.hexdigest()}, {sha256} expected")
    return path
