"""Readers of raw message collections, each into (subject, body, label, source); schemas are declared, never inferred."""

from __future__ import annotations

import email

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailforge.functions import text as X

MESSAGE = "subject string, body string, broken boolean"
#: What remains of a row that does not fit a declared schema.
CORRUPT = "_corrupt_record"


def parts_of(m: email.message.Message, charset: bool) -> list[str]:
    out = []
    for part in m.walk() if m.is_multipart() else [m]:
        if m.is_multipart() and part.get_content_type() != "text/plain":
            continue
        payload = part.get_payload(decode=True)
        if payload:
            name = (part.get_content_charset() or "utf-8") if charset else "utf-8"
            try:
                out.append(payload.decode(name, "replace"))
            except LookupError:
                out.append(payload.decode("utf-8", "replace"))
        elif isinstance(part.get_payload(), str) and (charset or not m.is_multipart()):
            out.append(part.get_payload())
    return out


def parse_mime(raw: str | None, charset: bool = True) -> tuple[str, str, bool]:
    """(subject, body, broken) of a raw message: its text/plain parts joined by line feeds.

    charset: decode parts as they say (else as UTF-8). A message that cannot be parsed is broken and its body is the raw text.
    """
    if not raw:
        return "", "", False
    try:
        m = email.message_from_string(raw)
        return str(m.get("Subject", "") or ""), "\n".join(parts_of(m, charset)).strip(), False
    except Exception:  # noqa: BLE001  malformed headers raise many kinds
        return "", raw, True


def mime_columns(df: DataFrame, column: str, charset: bool = True) -> DataFrame:
    """df with subject, body and broken parsed from a raw column, in Arrow batches."""

    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_mime(x, charset) for x in raw], columns=["subject", "body", "broken"])

    return df.withColumn("parsed", F.pandas_udf(parse, MESSAGE)(F.col(column))).select("*", "parsed.*").drop("parsed")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV header."""
    return spark.read.option("header", True).csv(path).columns


def shaped(df: DataFrame, label: Column, source: str) -> DataFrame:
    return df.select("subject", "body", label.cast("int").alias("label"), F.lit(source).alias("source"))


def or_raw(df: DataFrame, raw: str) -> DataFrame:
    """Stripped subject and body; a message without either has its raw text as body."""
    s, b = X.strip(F.col("subject")), X.strip(F.col("body"))
    return df.withColumns({"subject": s, "body": F.when((s == "") & (b == ""), X.strip(X.text(F.col(raw)))).otherwise(b)})


def labelled_raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV of (label, raw message), parts read as UTF-8."""
    return shaped(mime_columns(read_csv(spark, path, "label int, origin string"), "origin", False), F.col("label"), source)


def fields(spark: SparkSession, path: str, source: str, columns: str, body: str = "body") -> DataFrame:
    """CSV with subject, body and label in columns of the given names and order; ``body`` may be called ``message``."""
    there = columns_of(spark, path)
    body = body if body in there else "message"
    df = read_csv(spark, path, ", ".join(f"`{c}` string" for c in there))
    return shaped(df.select(X.text(F.col("subject")).alias("subject"), X.text(F.col(body)).alias("body"), "label"), F.col("label"), source)


def folder_dump(spark: SparkSession, path: str, source: str, label: int) -> DataFrame:
    """CSV of (file, raw message) with one label."""
    df = or_raw(mime_columns(read_csv(spark, path, "file string, message string"), "message"), "message")
    return shaped(df, F.lit(label), source)


def flat_raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV of (text, target); what parsing leaves empty is sought in the text as one whose lines were joined, each field on its own."""
    df = mime_columns(read_csv(spark, path, "text string, target int"), "text", False)
    s, b = X.flattened(X.text(F.col("text")))
    filled = df.withColumns({"subject": F.coalesce(F.nullif("subject", F.lit("")), s), "body": F.coalesce(F.nullif("body", F.lit("")), b)})
    return shaped(filled, F.col("target"), source)


def indexed_text(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV whose first column is an index and is dropped; (label, text, label_num): the first line of text is the subject."""
    df = read_csv(spark, path, "index string, label string, text string, label_num int").drop("index")
    s, b = X.first_line_subject(X.text(F.col("text")))
    return shaped(df.select(s.alias("subject"), b.alias("body"), "label"), F.when(F.col("label") == "spam", 1).otherwise(0), source)


def mbox(spark: SparkSession, path: str, source: str, label: int) -> DataFrame:
    """Mailbox files, cut at their From lines by the reader, so that a mailbox of any size is split over tasks."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path)
    raw = F.regexp_replace("value", r"^(From )?[^\n]*\n", "")
    df = mime_columns(lines.select(raw.alias("raw")).where("raw <> ''"), "raw")
    return shaped(df.withColumn("subject", X.strip(F.col("subject"))), F.lit(label), source)


def result_rows(spark: SparkSession, path: str, schema: str, status: str | None = "completed") -> DataFrame:
    """CSV of result rows in a state (all for None); numbers that cannot be read are null."""
    df = read_csv(spark, path, schema)
    return df if status is None else df.where(F.coalesce(F.col("status"), F.lit("completed")) == status)


def json_runs(spark: SparkSession, glob: str, schema: str, pattern: str = r"([^/]+)_run\d+\.json$") -> DataFrame:
    """JSON documents of completed repeats with the method their file name says; another method or state inside is an error, other names are skipped."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file_method", F.regexp_extract(F.input_file_name(), pattern, 1)).where("file_method <> ''")
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), F.col("file_method")))
    method = F.when(F.col("status").isNull() | (F.col("status") != "completed"), fail("a run did not complete")).when(F.col("method").isNull() | (F.col("method") != F.col("file_method")), fail("another method inside")).otherwise(F.col("method"))
    return df.withColumn("method", method).drop("file_method")


def run_summary(configs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each configured run: its metrics' state, ``missing`` without a document, ``metrics_json_invalid`` with a broken one.

    metrics: (run_dir, text) of the documents read whole.
    """
    doc = metrics.select("run_dir", F.col("text"), F.try_parse_json("text").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    out = configs.join(doc, "run_dir", "left")
    status = F.when(F.col("text").isNull(), "missing").when(F.col("v").isNull(), "metrics_json_invalid").otherwise(F.coalesce(get("$.status", "string"), F.lit("unknown")))
    named = [get(f"$.{a}_metrics.{m}", "double").alias(f"{a}_{m}") for a in ("validation", "test") for m in ("accuracy", "precision", "recall", "f1")]
    return out.select(*configs.columns, status.alias("status"), get("$.training_metrics.train_runtime", "double").alias("train_runtime"), get("$.trainer_state.global_step", "long").alias("global_step"), *named)


def largest_member(archive: str, suffix: str = ".csv") -> str | None:
    """The name of an archive's largest member with the suffix; ties go to the first."""
    import zipfile

    with zipfile.ZipFile(archive) as z:
        members = [i for i in z.infolist() if i.filename.lower().endswith(suffix)]
    return max(members, key=lambda i: i.file_size).filename if members else None


def adapters(root: str) -> list[str]:
    """Folders below root that hold an adapter's configuration, each resolved path once, sorted."""
    from pathlib import Path

    return sorted({str(p.parent.resolve()) for p in Path(root).rglob("adapter_config.json")})
