"""Lexical search: an inverted index with inverse document frequencies, top-k by question and a relative score floor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_terms, question_terms
from .cuts import cut

#: Terms of questions, repeats over questions included, up to which they are sent to every task.
MOST_ASKED = 100_000
#: Pairs of a question and a document that one task makes at most, about.
MOST_PAIRS = 1_000_000


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, term)."""
    # An outer explode: of an inner one Spark infers a filter on the array's size, which would cut texts into terms twice.
    return corpus.select(F.col(key), F.explode_outer(distinct_terms(F.col(text))).alias("term")).where("term is not null")


def inverse_frequencies(index: DataFrame, key: str, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln(n / df)."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def search(corpus: DataFrame, key: str, text: str, questions: DataFrame, k: int = 8) -> DataFrame:
    """(question_id, key, score, rank): the k best by the sum of idf of shared distinct terms; ties by key.

    Questions' terms are computed once (a job of its own).  Only they are kept of a document, and they are dealt by document once: both the counting of documents for each term and the
    scoring read that one exchange, so texts are cut into terms once.  A frequent term makes a pair of nearly each document and question; where questions have few terms (counted), they are at hand of
    each task, documents are dealt so that a task makes at most about ``MOST_PAIRS`` pairs, and pairs are summed and cut to the best where they are made.
    """
    asked = cut(postings(questions.select("question_id", "question"), "question_id", "question"))
    few = asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    near = F.broadcast if few else lambda df: df
    n = corpus.count()
    wanted = postings(corpus, key, text).join(near(asked.select("term").distinct()), "term", "left_semi")
    if few:
        pairs = n * asked.select("question_id").distinct().count()
        wanted = wanted.repartition(max(corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / MOST_PAIRS)), key)
    else:
        wanted = wanted.repartition(key)
    df = wanted.groupBy("term").agg(F.count(key).alias("df"))
    idf = df.select("term", F.round(F.log(F.lit(float(n)) / F.col("df")), 9).cast("decimal(20,9)").alias("idf"))
    scored = wanted.join(near(asked.join(idf, "term")), "term")
    total = scored.groupBy("question_id", key).agg(F.round(F.sum("idf").cast("double"), 6).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.col(key))
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def significant(hits: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Hits of at least ``ratio`` of their question's best score."""
    top = F.max("score").over(Window.partitionBy("question_id"))
    return hits.withColumn("_top", top).where(F.col("score") >= ratio * F.col("_top")).drop("_top")


def expanded(questions: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """(question_id, question) to search with: a question without its interrogatives, then the texts (question_id, text) that widen it.

    A question is written in names, and a corpus of rules has none of them: the texts of what it names share words with the rules.
    """
    topic = F.concat_ws(" ", question_terms(F.col("question")), "_more") if expansions is not None else question_terms(F.col("question"))
    if expansions is None:
        return questions.select("question_id", topic.alias("question"))
    # Words alone count, each once, so the order of the texts doesn't.
    more = expansions.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias("_more"))
    return questions.join(more, "question_id", "left").select("question_id", topic.alias("question"))


def search_evidence(corpus: DataFrame, key: str, text: str, questions: DataFrame, expansions: DataFrame | None = None, k: int = 8, ratio: float = 0.25, snippet: int = 160, distance: int = 1) -> DataFrame:
    """(question_id, rank, kind, key, text, path, distance): the significant hits of the expanded questions as evidence rows with snippets.

    Nothing that is found this way was named, so it stands at a distance and loses against what was.
    """
    hits = significant(search(corpus, key, text, expanded(questions, expansions), k), ratio)
    rows = hits.join(corpus.select(key, F.substring(text, 1, snippet).alias("_snippet")), key)
    path = F.format_string("words shared with the question, score %.1f", "score")
    return rows.select("question_id", "rank", F.lit("rule").alias("kind"), F.col(key).cast("string").alias("key"), F.col("_snippet").alias("text"), path.alias("path"), F.lit(distance).alias("distance"))
