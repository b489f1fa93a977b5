"""Text models: TF-IDF of words and character grams as long tables, naive Bayes by counts, linear models on hashed features, pluggable scorers.

The long form (document, term, weight) needs no vocabulary in the driver; linear models use hashed features of a fixed width for the same reason. Rows
with message_id % 10 in TRAIN are for training, the others are scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailforge.plans.evaluation import best_threshold, confusion, rates
from mailforge.plans.rules import CLEAN
from mailforge.session import cut

QUERIES, SQL = {}, {}
#: Parameters: training digits, document frequency bounds, features at most, occurrences of a term that is reported, width of hashed features.
TRAIN, MIN_DF, MAX_DF, FEATURES, FLOOR, WIDTH = 8, 2, 0.95, 200_000, 20, 1 << 16


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def without_accents(c: Column) -> Column:
    """Latin letters without their accents, by a table from the canonical decompositions."""
    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(i))) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def words(c: Column) -> Column:
    """Maximal runs of letters and numbers in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Runs of two word characters or more, lower case, without accents."""
    return F.regexp_extract_all(without_accents(F.lower(c)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def runs_of(size: Column, k: int, at: Callable[[Column], Column]) -> Column:
    """at(i) for each i from 1 to size - k + 1; empty where there is none."""
    return F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: at(i))).otherwise(F.array().cast("array<string>"))


def word_grams(t: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of low to high tokens, joined by blanks."""
    of = lambda k: t if k == 1 else runs_of(F.size(t), k, lambda i: F.array_join(F.slice(t, i, k), " "))
    return F.concat(*[of(k) for k in range(low, high + 1)])


def char_grams(w: Column, low: int = 3, high: int = 5) -> Column:
    """Character grams inside words, each word between blanks; words too short for a gram have none of that length."""

    def of(word):
        p = F.concat(F.lit(" "), word, F.lit(" "))
        grams = lambda k: runs_of(F.length(p), k, lambda i: F.substr(p, i, F.lit(k)))
        return F.concat(*[grams(k) for k in range(low, high + 1)])

    return F.flatten(F.transform(w, of))


def tfidf(docs: DataFrame, key: str, grams: Column, sublinear: bool = False, min_df: int = MIN_DF, max_df: float = MAX_DF, features: int = FEATURES) -> DataFrame:
    """(key, term, weight): term counts (1 + ln with sublinear) times ln((1 + n) / (1 + df)) + 1, each document brought to length one.

    Terms in fewer than min_df or more than max_df of the documents are left out; of the others the features most frequent ones stay.
    """
    counts = docs.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    counts = cut(counts)
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    df = df.orderBy(F.desc("total"), "term").limit(features)
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    weighed = counts.join(df, "term").select(key, "term", (tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


_accents = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(0xC0, 0x250)]
_accents = [(a, d[0]) for a, d in _accents if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
TOKENS_SQL = f"""{CLEAN}, docs as (select message_id, label, regexp_extract_all(translate(lower(subject), '{"".join(a for a, _ in _accents)}', '{"".join(b for _, b in _accents)}'), '[\\pL\\pN_]{{2,}}') as t from clean where label in (0, 1))"""


def _tfidf_sql(sub: bool) -> str:
    tf = "(1 + ln(tf))" if sub else "tf"
    return f"""with {TOKENS_SQL}, g as (select message_id, unnest(t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) as term from docs), c as (select message_id, term, count(*) as tf from g group by 1, 2),
d as (select term, count(*) as df from c group by term having count(*) between {MIN_DF} and {MAX_DF} * (select count(*) from docs)), w as (select message_id, {tf} * (ln((1 + (select count(*) from docs)) / (1 + df)::double) + 1) as w from c join d using (term)),
n as (select message_id, sqrt(sum(w * w)) as norm, count(*) as terms, sum(w) as total, max(w) as top from w group by message_id) select message_id, terms, round(total / norm, 6) as total, round(top / norm, 6) as top from n"""


def subjects(spark, d) -> DataFrame:
    from mailforge.plans.curation import messages

    return messages(spark, d).where("label in (0, 1)").select("message_id", "label", "subject", "body")


def _tfidf_summary(spark, d, sub: bool) -> DataFrame:
    docs = subjects(spark, d).withColumn("t", tokens(F.col("subject")))
    w = tfidf(docs, "message_id", word_grams(F.col("t")), sub)
    return w.groupBy("message_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@query(_tfidf_sql(False))
def tfidf_words(spark, d):
    """Words and pairs of subjects: terms, total and greatest weight of each document."""
    return _tfidf_summary(spark, d, False)


@query(_tfidf_sql(True))
def tfidf_sublinear(spark, d):
    return _tfidf_summary(spark, d, True)


@query(f"""with {TOKENS_SQL}, p as (select message_id, ' ' || unnest(t) || ' ' as p from docs), g as (select message_id, p, k, unnest(case when length(p) >= k then [p[i:i + k - 1] for i in range(1, length(p) - k + 2)] else [] end) as g from p, range(3, 6) r(k))
select message_id, cast(count(*) as bigint) as grams, count(distinct g) as kinds from g group by message_id""")
def character_grams(spark, d):
    g = subjects(spark, d).select("message_id", F.explode(char_grams(tokens(F.col("subject")))).alias("g"))
    return g.groupBy("message_id").agg(F.count("*").alias("grams"), F.countDistinct("g").alias("kinds"))


WORDS_SQL = f"""{CLEAN}, docs as (select message_id, label, [w for w in regexp_split_to_array(lower(body), '[^\\pL\\pN]+') if w <> ''] as ws from clean where label in (0, 1))"""


@query(f"with {WORDS_SQL}, tf as (select w, sum(1 - label) as n0, sum(label) as n1 from (select label, unnest(ws) as w from docs) group by w), t as (select sum(n0) as t0, sum(n1) as t1, count(*) as v from tf) select w as term, n0, n1, round(ln((n1 + 1.0::double) / (t1 + v)) - ln((n0 + 1.0::double) / (t0 + v)), 6) as log_odds from tf, t where n0 + n1 >= {FLOOR}")
def term_log_odds(spark, d):
    """Smoothed log-odds (add one) of the terms with FLOOR occurrences or more."""
    return log_odds(counts(subjects(spark, d))).where(F.col("n0") + F.col("n1") >= FLOOR).select(F.col("w").alias("term"), "n0", "n1", F.round("x", 6).alias("log_odds"))


def counts(docs: DataFrame) -> DataFrame:
    return docs.select("label", F.explode(words(F.col("body"))).alias("w")).groupBy("w").agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1"))


def log_odds(tf: DataFrame) -> DataFrame:
    tf = cut(tf)
    t = tf.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("v"))
    x = F.log((F.col("n1") + 1.0) / (F.col("t1") + F.col("v"))) - F.log((F.col("n0") + 1.0) / (F.col("t0") + F.col("v")))
    return tf.crossJoin(F.broadcast(t)).select("w", "n0", "n1", x.alias("x"))  # one row


@query(f"""with {WORDS_SQL}, a as (select * from docs where message_id % 10 < {TRAIN}), b as (select * from docs where message_id % 10 >= {TRAIN}), tf as (select w, sum(1 - label) as n0, sum(label) as n1 from (select label, unnest(ws) as w from a) group by w), t as (select sum(n0) as t0, sum(n1) as t1, count(*) as v from tf),
g as (select w, ln((n1 + 1.0::double) / (t1 + v)) - ln((n0 + 1.0::double) / (t0 + v)) as x from tf, t), p as (select ln(sum(label) / sum(1 - label)::double) as x from a), k as (select message_id, label, unnest(ws) as w from b), s as (select message_id, sum(x) as x from k join g using (w) group by message_id)
select b.message_id, b.label, case when coalesce(s.x, 0) + p.x > 0 then 1 else 0 end as predicted, round(coalesce(s.x, 0) + p.x, 4) as margin from b left join s using (message_id), p""")
def naive_bayes(spark, d):
    """Multinomial model with add-one smoothing, trained on some rows and applied to the others; words not seen in training say nothing."""
    docs = subjects(spark, d)
    train, test = docs.where(F.col("message_id") % 10 < TRAIN), docs.where(F.col("message_id") % 10 >= TRAIN)
    weight = log_odds(counts(train)).select("w", "x")
    prior = train.agg(F.log(F.sum("label") / F.sum(1 - F.col("label"))).alias("prior"))
    held = test.select("message_id", F.explode(words(F.col("body"))).alias("w")).groupBy("message_id", "w").agg(F.count("*").alias("c"))
    score = held.join(weight, "w").groupBy("message_id").agg(F.sum(F.col("c") * F.col("x")).alias("s"))
    m = test.select("message_id", "label").join(score, "message_id", "left").crossJoin(F.broadcast(prior))  # one row
    margin = F.coalesce("s", F.lit(0.0)) + F.col("prior")
    return m.select("message_id", "label", (margin > 0).cast("int").alias("predicted"), F.round(margin, 4).alias("margin"))


@query(f"with {WORDS_SQL}, l as (select label, len(ws) as n from docs) select label, {', '.join(f'round(quantile_cont(n, {q}), 6) as q{int(q * 100)}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} from l group by label")
def word_count_boxes(spark, d):
    n = subjects(spark, d).select("label", F.size(words(F.col("body"))).alias("n"))
    return n.groupBy("label").agg(*[F.round(F.percentile("n", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


# linear models -----------------------------------------------------------------------------------------------------------------------------


def hashed(docs: DataFrame, grams: Column, width: int = WIDTH) -> DataFrame:
    """docs with ``features``: hashed counts, sublinear, weighed by ln((1 + n) / (1 + df)) + 1, of length one."""
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer
    from pyspark.ml.linalg import Vectors

    counted = HashingTF(inputCol="_g", outputCol="_tf", numFeatures=width).transform(docs.withColumn("_g", grams))
    train = counted.where(F.col("message_id") % 10 < TRAIN)
    idf = IDF(inputCol="_tf", outputCol="_w", minDocFreq=0).fit(train).idf.toArray() + 1  # width numbers
    scaled = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=Vectors.dense(idf)).transform(counted)
    return Normalizer(inputCol="_w", outputCol="features").transform(scaled).drop("_g", "_tf", "_w")


def classifiers() -> dict[str, Callable]:
    """Estimators by name: logistic regression at two strengths, a linear support vector machine."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    return {
        "logistic_c1": lambda: LogisticRegression(maxIter=30, regParam=1e-4),
        "logistic_c01": lambda: LogisticRegression(maxIter=30, regParam=1e-3),
        "linear_svm": lambda: LinearSVC(maxIter=30, regParam=1e-4),
    }


def held_out_metrics(scored: DataFrame, name: str) -> DataFrame:
    """(model, f1, accuracy, n) of scored rows (label, score) at score 0.5."""
    c = rates(confusion(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")), []))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(F.lit(name).alias("model"), F.round("f1", 4).alias("f1"), F.round((F.col("tp") + F.col("tn")) / n, 4).alias("accuracy"), n.alias("n"))


def linear_scores(docs: DataFrame, grams: Callable[[Column], Column], names: list[str]) -> DataFrame:
    """docs has ``t``, tokens as a column of its own: inside a lambda they would be made anew for each gram."""
    docs = cut(hashed(docs, grams(F.col("t"))).select("message_id", "label", "features"))
    out = None
    for name in names:
        model = classifiers()[name]().fit(docs.where(F.col("message_id") % 10 < TRAIN))
        raw = model.transform(docs.where(F.col("message_id") % 10 >= TRAIN))
        from pyspark.ml.functions import vector_to_array

        score = vector_to_array("probability")[1] if "probability" in raw.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        m = held_out_metrics(raw.select("label", score.alias("score")), name)
        out = m if out is None else out.unionByName(m)
    return out


@query()
def linear_models(spark, d):
    """F1 and accuracy of linear models of words and pairs on rows not trained on."""
    text = F.concat_ws(" ", "subject", "body")
    return linear_scores(subjects(spark, d).withColumn("t", tokens(text)), word_grams, list(classifiers()))


@query()
def subword_model(spark, d):
    """Words and their character grams in one hashed space under a linear model."""
    return linear_scores(subjects(spark, d).withColumn("t", tokens(F.col("subject"))), lambda t: F.concat(t, char_grams(t)), ["logistic_c1"])


Scorer = Callable[[DataFrame], DataFrame]


def evaluate(frames: dict[str, DataFrame], scorer: Scorer, threshold: float | None = None) -> DataFrame:
    """Metrics of each named frame (label, ...) under a scorer that adds ``score``; without a threshold the best one of the first frame is taken."""
    scored = {n: scorer(f) for n, f in frames.items()}
    if threshold is None:
        threshold = best_threshold(next(iter(scored.values()))).first()["t"]
    out = None
    for n, s in scored.items():
        m = rates(confusion(s.withColumn("p", (F.col("score") >= threshold).cast("int")), [])).select(F.lit(n).alias("dataset"), F.lit(threshold).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("f1", "recall", "precision", "specificity")])
        out = m if out is None else out.unionByName(m)
    return out


@query()
def scored_by_bayes(spark, d):
    """An external scorer at work: naive Bayes margins as probabilities, the threshold from one half, metrics on both."""
    m = naive_bayes(spark, d).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("margin"))))))
    m = cut(m)
    return evaluate({"validation": m.where("message_id % 2 = 0"), "test": m.where("message_id % 2 = 1")}, lambda f: f)


