"""Readers, registry, sinks and the entry pipeline on small files of each raw form."""

import csv
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mailforge.plans import pipeline, runs
from mailforge.sources import readers as R
from mailforge.sources import registry, sinks


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


MULTI = "Subject: Multi\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=iso-8859-2\n\none\n--B\nContent-Type: text/html\n\n<p>x\n--B\nContent-Type: text/plain\n\ntwo\n--B--\n"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    seven = ["sender", "receiver", "date", "subject", "body", "label", "urls"]
    write_csv(d / "ceas_2008/CEAS_08.csv", seven, [["a", "b", "c", "S, one", 'line "one"\nline two', 1, 0], ["a", "b", "c", "", "plain text of a message", 0, 0]])
    write_csv(d / "nazario/Nazario.csv", seven, [["a", "b", "c", "N", "  spaced  ", 1, 0]])
    write_csv(d / "ling/Ling.csv", ["subject", "message", "label"], [["L", "from message", 0], ["", "", 0]])
    write_csv(d / "enron/emails.csv", ["file", "message"], [["f1", MULTI], ["f2", "Subject: E\n\nbody text here"], ["f3", ""]])
    write_csv(d / "trec_2006/email_origin.csv", ["label", "origin"], [[1, "Subject: T6\n\nbuy"], [0, "Subject: T6b\n\nmeet"]])
    write_csv(d / "trec_2007/email_origin.csv", ["label", "origin"], [[1, "Subject: T7\n\nBUY!"], [0, "Subject: T8\n\nline \"one\" line two"], [0, "no header at all"]])
    write_csv(d / "spam_assassin/spam_assassin.csv", ["text", "target"], [["From a@b Subject: Flat one Date: Mon Content-Type: text/plain Hello flat", 0], ["Subject: Ok\n\nfine", 1]])
    write_csv(d / "spam_ham/spam_ham_dataset.csv", ["", "label", "text", "label_num"], [[7, "spam", "Subject: first line\nrest of it\n", 1], [8, "ham", "just one line", 0]])
    (d / "fraudulent_email_corpus").mkdir()
    (d / "fraudulent_email_corpus/fradulent_emails.txt").write_text("From r Mon\nSubject: Money\n\nDear friend\n\nFrom r Tue\nSubject: More\n\nsend it\n")
    return d


def test_each_form(spark, raw):
    get = lambda n: sorted(tuple(r) for r in registry.LOADERS[n](spark, str(raw)).select("subject", "body", "label").collect())
    assert get("ceas_2008") == [("", "plain text of a message", 0), ("S, one", 'line "one"\nline two', 1)]
    assert get("ling") == [("", "", 0), ("L", "from message", 0)]
    assert get("enron") == [("", "", 0), ("E", "body text here", 0), ("Multi", "one\ntwo", 0)]
    assert get("trec_2007") == [("", "no header at all", 0), ("T7", "BUY!", 1), ("T8", 'line "one" line two', 0)]
    assert ("Ok", "fine", 1) in get("spam_assassin") and any(s == "Flat one" for s, _, _ in get("spam_assassin"))
    assert get("spam_ham") == [("first line", "rest of it", 1), ("just one line", "", 0)]
    assert get("fraudulent_email_corpus") == [("Money", "Dear friend", 1), ("More", "send it", 1)]


def test_registry():
    assert registry.resolve(["spam_detection", "enron", " enron "]) == ["enron", "spam_assassin", "spam_ham"]
    assert registry.resolve("training_all") == ["ceas_2008", "ling", "nazario", "spam_assassin", "trec_2007"]
    for bad in ("", [], "no such"):
        with pytest.raises(ValueError):
            registry.resolve(bad)


def test_pipeline(spark, raw, tmp_path):
    path = pipeline.combine(spark, str(raw), str(tmp_path), "all", report=True)
    df = spark.read.parquet(path)
    assert df.columns == ["subject", "body", "label", "source"] and df.count() == df.select("body").distinct().count()
    assert df.where("source = 'trec_2007' and body = 'BUY!'").count() == 0 and df.where("source = 'trec_2006' and body = 'buy'").count() == 1
    assert pipeline.combine(spark, str(raw), str(tmp_path), "all") == path
    report = [p for p in tmp_path.iterdir() if p.name.endswith("duplicates.csv")]
    rows = spark.read.option("header", True).csv(str(report[0])).collect()
    assert [r.duplicate_count for r in rows] == ["2", "2"] and rows[0].sources and rows[0].sample_1_subject
    half = spark.read.parquet(pipeline.combine(spark, str(raw), str(tmp_path), "all", mode="mixed_50_50"))
    assert half.where("label = 1").count() == half.where("label = 0").count()
    m = pipeline.manifest(spark, {"a": path})
    sinks.write_json(str(tmp_path / "m.json"), m)
    assert json.loads((tmp_path / "m.json").read_text())["splits"]["a"]["rows"] == df.count()
    with pytest.raises(ValueError):
        pipeline.manifest(spark, {"a": path, "b": path})


def test_names():
    a = sinks.result_name(["x"], -1, "high", "mixed", 8.0)
    assert a.startswith("x__dedupe_high__all_samples__") and "mode" not in a
    assert "__mode_source_aware_50_50__max2_5x__spam_0_5__" in sinks.result_name(["x"], -1, "high", "source_aware_50_50", 2.5)
    assert sinks.report_name(["x", "y"], 0.25, "basic").startswith("x__y__dedupe_basic__spam_0_25__")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "")], "n int, extra string, line string")
    sinks.write_csv(df, str(tmp_path / "c"), ["line", "n", "gone"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["line", "n", "gone"]
    sinks.write_csv(df, str(tmp_path / "d"), ["line"], extras=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).columns == ["line", "extra", "n"]
    sinks.write_lines(df, "line", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["x"]
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    sinks.write_parquet(df, str(tmp_path / "q"), ["n"])
    with pytest.raises(Exception):
        sinks.write_parquet(df, str(tmp_path / "q"))
    done = spark.createDataFrame([(1, "completed"), (2, "failed")], "n int, status string")
    assert [r.n for r in sinks.pending(df, done, ["n"]).collect()] == [2]


def test_json_runs_and_summary(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"nb_run{i}.json").write_text(json.dumps({"method": "nb", "status": "completed", "rows": 5, "inference_seconds": i}))
    (tmp_path / "other.json").write_text("{}")
    schema = "method string, status string, rows int, inference_seconds double"
    assert R.json_runs(spark, str(tmp_path / "*.json"), schema).count() == 2
    (tmp_path / "svm_run1.json").write_text(json.dumps({"method": "nb", "status": "completed"}))
    with pytest.raises(Exception, match="another method"):
        R.json_runs(spark, str(tmp_path / "*.json"), schema).collect()
    configs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_dir string")
    metrics = spark.createDataFrame([("a", '{"status": "completed", "test_metrics": {"f1": 0.5}}'), ("b", "{bad")], "run_dir string, text string")
    got = {r.run_dir: (r.status, r.test_f1) for r in R.run_summary(configs, metrics).collect()}
    assert got == {"a": ("completed", 0.5), "b": ("metrics_json_invalid", None), "c": ("missing", None)}


def test_small_tools(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "1")
        z.writestr("b.csv", "22")
        z.writestr("c.txt", "333")
    assert R.largest_member(str(tmp_path / "z.zip")) == "b.csv"
    (tmp_path / "k/x").mkdir(parents=True)
    (tmp_path / "k/x/adapter_config.json").write_text("{}")
    assert R.adapters(str(tmp_path)) == [str((tmp_path / "k/x").resolve())]
    assert runs.distinct_arguments(" a, b,a,,c ") == ["a", "b", "c"] and runs.config_indexes(["1,3", "2"]) == [1, 3, 2]
    with pytest.raises(ValueError):
        runs.config_indexes(["99"])
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.array(F.lit(2)).alias("c")).alias("a"))
    assert runs.flattened(df).columns == ["a.b", "a.c"] and runs.ordered_columns(runs.flattened(df), ["a.c"]).columns == ["a.c", "a.b"]
    (tmp_path / "r.csv").write_text("status,f1\ncompleted,0.5\nfailed,x\n,0.25\n")
    assert [r.f1 for r in R.result_rows(spark, str(tmp_path / "r.csv"), "status string, f1 double").collect()] == [0.5, 0.25]
    with pytest.raises(ValueError):
        runs.required(spark.range(3), "id", [1, 9])
