"""Registry of collections: atomic sources with their loaders, aliases of several, and the union in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailforge.sources import readers as R

# fixed values: files and forms of the known collections, and those held out of training
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ceas_2008": lambda s, d: R.fields(s, f"{d}/ceas_2008/CEAS_08.csv", "ceas_2008", ""),
    "enron": lambda s, d: R.folder_dump(s, f"{d}/enron/emails.csv", "enron", 0),
    "fraudulent_email_corpus": lambda s, d: R.mbox(s, f"{d}/fraudulent_email_corpus/fradulent_emails.txt", "fraudulent_email_corpus", 1),
    "ling": lambda s, d: R.fields(s, f"{d}/ling/Ling.csv", "ling", ""),
    "nazario": lambda s, d: R.fields(s, f"{d}/nazario/Nazario.csv", "nazario", ""),
    "spam_assassin": lambda s, d: R.flat_raw(s, f"{d}/spam_assassin/spam_assassin.csv", "spam_assassin"),
    "spam_ham": lambda s, d: R.indexed_text(s, f"{d}/spam_ham/spam_ham_dataset.csv", "spam_ham"),
    "trec_2006": lambda s, d: R.labelled_raw(s, f"{d}/trec_2006/email_origin.csv", "trec_2006"),
    "trec_2007": lambda s, d: R.labelled_raw(s, f"{d}/trec_2007/email_origin.csv", "trec_2007"),
}
HELD_OUT = frozenset({"enron", "fraudulent_email_corpus", "spam_ham", "trec_2006"})
ALIASES = {
    "all": tuple(sorted(LOADERS)),
    "training_all": tuple(sorted(set(LOADERS) - HELD_OUT)),
    "spam_2007_2008": ("ceas_2008", "trec_2007"),
    "spam_detection": ("spam_assassin", "spam_ham"),
}


def register(name: str, loader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a source; loader(spark, folder) gives (subject, body, label, source)."""
    LOADERS[name] = loader


def resolve(names: str | Iterable[str]) -> list[str]:
    """The atomic sources that names and aliases stand for, each once, sorted; unknown or no names are an error."""
    todo = [n.strip() for n in ([names] if isinstance(names, str) else map(str, names)) if n.strip()]
    if not todo:
        raise ValueError("at least one source is needed")
    found: set[str] = set()
    while todo:
        n = todo.pop()
        if n in ALIASES:
            todo += ALIASES[n]
        elif n in LOADERS:
            found.add(n)
        else:
            raise ValueError(f"unknown source {n!r}; there are {', '.join(sorted(LOADERS | ALIASES))}")
    return sorted(found)


def load(spark: SparkSession, folder: str, names: str | Iterable[str]) -> DataFrame:
    """Union of the sources with source_rank (their order) and row_in_source (the order of the files)."""
    frames = []
    for rank, n in enumerate(resolve(names)):
        df = LOADERS[n](spark, folder).withColumn("source_rank", F.lit(rank)).withColumn("row_in_source", F.monotonically_increasing_id())
        frames.append(df)
    return reduce(partial(DataFrame.unionByName), frames)


def with_rows_numbered(df: DataFrame) -> DataFrame:
    """df with row_in_source as 0, 1, 2, ... within each source (one sort task per source: for exports of small collections)."""
    return df.withColumn("row_in_source", F.row_number().over(Window.partitionBy("source_rank").orderBy("row_in_source")) - 1)
