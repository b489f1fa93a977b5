"""Core operators on hand-made rows, and plans against a second engine."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mailforge.functions import text as X
from mailforge.functions.sources import canonical_source
from mailforge.operators import balance, sampling
from mailforge.plans import core
from mailforge.sources.readers import mbox, parse_mime

SF = "/root/testdata/sf0.001"


def test_high_key(spark):
    rows = [("A b",), ("a B!",), ("Hi &lt;b&gt;x&lt;/b&gt; http://e.com/a me@x.org",), ("ﬁne",), ("!!!",), (None,), ("",), ("http://a.com<br>hello",), ("x<b>y</b>z &amp;lt; Ａ１ ½",)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(X.high_key(F.col("t")).alias("k")).collect()]
    assert got == ["ab", "ab", "hix", "fine", "", "", "", "hello", "xyzlta112"]


def test_exact_text_and_fingerprint(spark):
    df = spark.createDataFrame([(" A\r\nb\u00a0 c ", "x\ty"), (None, None)], "s string, b string")
    assert [r[0] for r in df.select(X.exact_text(F.col("s"), F.col("b"))).collect()] == ["A b c\n\nx y", "\n\n"]
    k = spark.createDataFrame([("a" * 49,), ("a" * 50,)], "k string").select(X.fingerprint(F.col("k"), F.lit("E"))).collect()
    assert k[0][0] == "subject_body:E" and len(k[1][0]) == 64
    seeds = spark.range(1).select(X.stable_seed("m", "ham", "enron")).first()[0]
    import hashlib

    assert seeds == int(hashlib.sha1(b'[67,"m","ham","enron"]').hexdigest()[:8], 16)


def test_composition_and_reverse(spark):
    df = spark.createDataFrame([("Hi", "b\n\nc"), ("", "only"), (" s ", None), (None, "x\n\ny")], "s string, b string")
    t = X.email_text(F.col("s"), F.col("b"))
    rows = df.select(t.alias("t")).select("t", *[c.alias(n) for c, n in zip(X.split_email_text(F.col("t")), ("s", "b"))]).collect()
    assert [tuple(r) for r in rows] == [("Subject: Hi\n\nb\n\nc", "Hi", "b\n\nc"), ("only", "", "only"), ("Subject: s", "s", ""), ("x\n\ny", "", "x\n\ny")]
    flat = spark.createDataFrame([("Subject: a Subject: b\nrest\n",), ("one line",)], "t string")
    assert [tuple(r) for r in flat.select(*X.first_line_subject(F.col("t"))).collect()] == [("a Subject: b", "rest"), ("one line", "")]
    raw = spark.createDataFrame([("Subject: Big win Date: Mon MIME-Version: 1.0 Content-Type: text/plain Hello there",), ("nothing",)], "t string")
    assert [tuple(r) for r in raw.select(*X.flattened(F.col("t"))).collect()] == [("Big win", "Hello there"), ("", "nothing")]


def test_canonical_source(spark):
    rows = [(" Trec 2007 ",), ("fraudulent-email-corpus",), ("LING",), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(canonical_source(F.col("t")).alias("k")).collect()]
    assert got == ["trec_2007", "fraudulent_email_corpus", "ling", None]


def test_allotment():
    import numpy as np

    share = lambda cap, target: balance.shares_of(np.array(list(cap.values())), np.array(list(cap)), target).tolist()
    assert share({"a": 4, "b": 16}, 10) == [4, 6] and share({"a": 4, "b": 9}, 13) == [4, 9]
    assert share({"a": 5, "b": 5}, 1) == [0, 1] and share({"a": 5, "b": 5, "c": 5}, 3) == [1, 1, 1]
    with pytest.raises(ValueError):
        share({"a": 1}, 2)
    assert balance.spaced(10, 4) == [0, 3, 6, 9] and balance.spaced(5, 1) == [4] and balance.spaced(3, 0) == [0, 1, 2]


def test_samples(spark):
    rows = spark.range(1000).select(F.col("id").alias("message_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    for digits in (0, 1, 3):
        got = sampling.take(rows, ["label"], spark.createDataFrame([(0, 250), (1, 5000)], "label int, n long"), digits=digits)
        assert sorted((r.label, r["count"]) for r in got.groupBy("label").count().collect()) == [(0, 250), (1, 100)]
    nested = [{r.message_id for r in sampling.take(rows, [], spark.createDataFrame([(n,)], "n long")).collect()} for n in (0, 10, 20)]
    assert not nested[0] and nested[1] < nested[2]
    with pytest.raises(ValueError):
        sampling.take(rows, [], spark.createDataFrame([(-1,)], "n long"))
    assert [r.number for r in sampling.numbered(rows, [F.col("message_id").desc()]).orderBy(F.desc("message_id")).collect()] == list(range(1, 1001))


def test_balance_rules(spark):
    m = spark.createDataFrame([(i, int(i % 4 == 0), "a" if i % 3 else "b") for i in range(100)], "message_id long, label int, source string")
    count = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    assert count(balance.by_ratio(m, -1)) == {0: 75, 1: 25} and count(balance.by_ratio(m, 0.5)) == {0: 25, 1: 25} and count(balance.by_ratio(m, 0.1)) == {0: 75, 1: 8}
    for bad in (1.5, -2):
        with pytest.raises(ValueError):
            balance.by_ratio(m, bad)
    with pytest.raises(ValueError):
        balance.by_ratio(m.where("label = 0"), 0.5)
    with pytest.raises(ValueError, match="b"):
        balance.by_smallest_cell(m.where("not (source = 'b' and label = 1)"))
    with pytest.raises(ValueError):
        balance.check_mode("mixed_50_50", 0.3, 8)
    with pytest.raises(ValueError):
        balance.validation(m, 51)
    assert count(balance.balanced(m, " Source_Aware_50_50 ")) == {0: 25, 1: 25}


def test_mime_and_mbox(spark, tmp_path):
    raw = "Subject: Hi\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\none\n--B\nContent-Type: text/html\n\n<p>x\n--B\nContent-Type: text/plain\n\ntwo\n--B--\n"
    assert parse_mime(raw) == ("Hi", "one\ntwo", False) and parse_mime(None) == ("", "", False)
    (tmp_path / "box").write_text("From a@b Mon\nSubject: One\n\nfirst\n\nFrom c@d Tue\nSubject: Two\n\nsecond\n")
    rows = {(r.subject, r.body.strip(), r.label) for r in mbox(spark, str(tmp_path / "box"), "box", 1).collect()}
    assert rows == {("One", "first", 1), ("Two", "second", 1)}


PLANS = ["source_label_matrix", "dedup_high", "duplicate_groups", "ratio_trim", "source_aware_balance", "split_92_2_6", "cross_source_overlap", "overlap_details", "external_splits", "content_digest", "binary_metrics", "roc_auc", "threshold_sweep", "rolling_median", "compose_text", "naive_bayes",
         "duplicate_report_wide", "standard_split", "length_batches", "parse_permissive", "parse_structured", "parse_reasoning", "rule_counts", "trim_words", "split_text", "external_score", "best_per_method", "average_precision", "class_averages", "repeat_medians",
         "metric_contexts", "run_metadata", "progress_with_metadata", "limited_per_run", "merged_store", "vector_normalize", "tfidf_words", "character_grams", "term_log_odds"]


@pytest.mark.parametrize("name", PLANS)
def test_plan_against_sql(spark, name):
    con = duckdb.connect()
    for t in core.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(core.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    key = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    assert sorted([tuple(key(x[c]) for c in cols) for x in df.collect()]) == sorted([tuple(key(x[i]) for i in at) for x in r.fetchall()])


def test_metrics_bounds(spark):
    for r in core.run(spark, "binary_metrics", SF).collect():
        assert all(0 <= r[c] <= 1 for c in ("accuracy", "prec", "recall", "f1", "specificity", "balanced_accuracy"))


def test_small_tables_are_checked(spark):
    from mailforge.session import small

    assert small(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        small(spark.range(6), 5)


def test_fit_to_budget():
    from mailforge.plans.replies import fit_to_budget

    encode, decode = str.split, " ".join
    text = " ".join(map(str, range(100)))
    out, n, cut = fit_to_budget(text, 30, encode, decode, lambda t: f"a b {t} c")
    assert cut and n == 30 and out.startswith("0 1 ") and out.endswith(" 99") and "[...]" in out
    assert fit_to_budget("x y", 30, encode, decode) == ("x y", 2, False)
    halves = lambda t: [t[i : i + 2] for i in range(0, len(t), 2)]
    assert fit_to_budget(text, 20, halves, "".join)[1] <= 20
    with pytest.raises(ValueError):
        fit_to_budget(text, 2, encode, decode, lambda t: f"a b c {t}")


def test_empty_tables(spark, tmp_path):
    for t in ("combine", "split_rows"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("source_label_matrix", "duplicate_groups", "duplicate_stats", "roc_auc", "average_precision", "class_averages", "cross_source_overlap", "pairwise_overlap", "parse_permissive", "split_92_2_6"):
        rows = core.queries()[name](spark, str(tmp_path)).collect()
        assert all(v in (0, 0.0, None) for r in rows for v in r), name
