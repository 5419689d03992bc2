"""The end-to-end flow: corpus, sentences, n-grams, repeated splits, polarity, evaluation.

Everything is one lazy plan but for what `materialise` does to the bags, which the counts, the models and the scoring all
read: callers that write several results pass a function that writes them to a table and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bayes, evaluate, keys, label, splits, vocabulary


@dataclass
class Settings:
    minimum: int = vocabulary.MIN_FREQUENCY
    low: int = 1
    high: int = 5
    iterations: int = bayes.ITERATIONS
    share: float = bayes.TEST_SHARE
    seed: int = bayes.SEED
    tokenizer: X.Tokenizer = X.whitespace_tokens
    skip_english: bool = True


def corpus(sources: list[DataFrame], rates: DataFrame, **options) -> DataFrame:
    """pk, date, title, content, label of the united sources (source, date, title, content, ingest_order), labelled ones only."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    both = both.filter(F.coalesce("content", F.lit("")) != "")
    keyed = keys.surrogate_key(both, "source", "date", ["ingest_order"])
    out = label.forward_label(keyed, rates, **options)
    return out.select("pk", "date", "title", "content", "label").filter("pk is not null and label is not null")


def sentence_rows(docs: DataFrame, text: str = "content", carry: tuple[str, ...] = ("pk", "date", "label")) -> DataFrame:
    return docs.select(*carry, F.posexplode(X.sentences(F.col(text))).alias("position", "sentence"))


def sentence_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("sentences"),
        F.countDistinct("pk").alias("documents"),
        F.count_if(F.col("label") == 1).alias("hawkish"),
        F.count_if(F.col("label") == 0).alias("dovish"),
        F.countDistinct("date").alias("dates"),
    )


def ngram_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """Adds ngrams, sentence_id and tested, the splits' test parts that the sentence is in; sentences without n-grams go.

    Both depend on the document and the place only, so they are the same in every run.
    """
    tokens = X.content_words(F.col("sentence"), settings.tokenizer, skip_english=settings.skip_english)
    out = rows.withColumn("ngrams", X.all_ngrams(tokens, settings.low, settings.high)).filter(F.size("ngrams") > 0)
    tested = splits.by_digest(F.concat_ws("#", "pk", "position"), settings.iterations, settings.share, settings.seed)
    return out.withColumns({"sentence_id": F.xxhash64("pk", "position"), "tested": tested})


@dataclass
class Result:
    vocabulary: DataFrame
    polarity: DataFrame
    by_iteration: DataFrame
    ensemble: DataFrame
    honest: DataFrame


def train(rows: DataFrame, settings: Settings, materialise: Callable[[DataFrame], DataFrame] = lambda df: df) -> Result:
    """rows: sentence_id, label, ngrams, tested.

    by_iteration has each split's metrics on its own test rows. `ensemble` votes on a split that the models were
    trained on (as published); `honest` votes on each row only with the models that didn't see it.
    """
    words = vocabulary.vocabulary(rows, minimum=settings.minimum)
    bags = materialise(vocabulary.restrict(vocabulary.bag(rows, "sentence_id", carry=["label", "tested"]), words))
    ids = bags.select("sentence_id", "label", "tested").distinct()
    n = settings.iterations
    models, prior = splits.models(splits.counts(bags, iterations=n), n), splits.priors(ids, iterations=n)
    scored = splits.predict(ids, bags, models, prior, "sentence_id", iterations=n)
    leaked = bayes.stratified_test(ids, "label", "sentence_id", settings.share, settings.seed + 100).filter("in_test").drop("in_test")
    every = leaked.withColumn("tested", F.lit((1 << n) - 1))
    seen = bags.drop("tested").join(every.select("sentence_id", "tested"), "sentence_id")
    voted = bayes.vote(splits.predict(every, seen, models, prior, "sentence_id", iterations=n), "sentence_id")
    return Result(words, splits.polarity(models, n), evaluate.metrics(scored, ["iter"]), evaluate.metrics(voted), evaluate.metrics(bayes.vote(scored, "sentence_id")))


def predict(rows: DataFrame, polarity: DataFrame, row_id: str = "pk") -> DataFrame:
    """row_id, score, matched, pred of rows with ngrams: the sum of the polarities of their n-grams, and its sign.

    A row without any known n-gram has a null prediction.
    """
    counts = rows.select(row_id, F.explode("ngrams").alias("ngram")).groupBy(row_id, "ngram").agg(F.count("*").alias("tf"))
    known = counts.join(polarity.select("ngram", "mean_score"), "ngram").groupBy(row_id)
    known = known.agg(F.sum(F.col("tf") * F.col("mean_score")).alias("score"), F.sum("tf").alias("matched"))
    out = rows.select(row_id).distinct().join(known, row_id, "left")
    return out.select(row_id, "score", F.coalesce("matched", F.lit(0)).alias("matched"), F.when(F.col("score") > 0, 1).when(F.col("score").isNotNull(), 0).alias("pred"))
