"""python -m tidemark.plans.cli STAGE --data FOLDER --out FOLDER: each stage reads tables, transforms and writes."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import evaluate as metrics
from ..session import build
from ..sources import readers, writers
from . import pipeline

STAGES = ("ingest", "corpus", "sentences", "ngrams", "train", "evaluate", "predict", "full")


def ingest(spark, data: str, out: str) -> None:
    """Cleansed sources as tables; rows of known keys are not added again."""
    news = readers.cleaned_news(readers.news_months(spark, f"{data}/news/*.json")).withColumn("date", D.lenient(F.col("date")))
    writers.insert_new(news, f"{out}/news", ["date", "title", "source"], ["file", "position"])
    notes = readers.cleaned(readers.minutes(spark, f"{data}/minutes.json"), "minutes", readers.MIN_MINUTES).withColumn("date", D.lenient(F.col("date")))
    writers.insert_new(notes, f"{out}/minutes", ["date", "title"], ["date", "title", "content"])
    reports = readers.cleaned(readers.bonds(spark, f"{data}/bonds.json"), "bond", readers.MIN_BOND).withColumn("date", D.lenient(F.col("date")))
    writers.insert_new(reports, f"{out}/bonds", ["date", "title"], ["date", "title", "content"])
    writers.insert_new(readers.call_rates(spark, f"{data}/call_rates.csv"), f"{out}/rates", ["date"], ["date"])


def corpus(spark, data: str, out: str) -> None:
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    order = lambda df, *c: df.withColumn("ingest_order", F.concat_ws("/", *c))
    sources = [
        order(read("news"), F.col("file"), F.format_string("%09d", "position")).select("source", "date", "title", "content", "ingest_order"),
        order(read("bonds"), F.col("date"), F.col("title")).select(F.lit("bond").alias("source"), "date", "title", "content", "ingest_order"),
        order(read("minutes"), F.col("date"), F.col("title")).select(F.lit("mpb").alias("source"), "date", "title", "content", "ingest_order"),
    ]
    rates = read("rates").select("date", F.col("call_rate").alias("rate"))
    pipeline.corpus(sources, rates).write.mode("overwrite").parquet(f"{out}/corpus")


def sentences(spark, data: str, out: str) -> None:
    pipeline.sentence_rows(spark.read.parquet(f"{out}/corpus")).write.mode("overwrite").parquet(f"{out}/sentences")


def ngrams(spark, data: str, out: str) -> None:
    pipeline.ngram_rows(spark.read.parquet(f"{out}/sentences"), pipeline.Settings()).write.mode("overwrite").parquet(f"{out}/ngrams")


def train(spark, data: str, out: str) -> None:
    def bags(df):
        df.write.mode("overwrite").parquet(f"{out}/bags")
        return spark.read.parquet(f"{out}/bags")

    result = pipeline.train(spark.read.parquet(f"{out}/ngrams"), pipeline.Settings(), bags)
    for name in ("vocabulary", "polarity", "by_iteration", "ensemble", "honest"):
        getattr(result, name).write.mode("overwrite").parquet(f"{out}/{name}")


def evaluate(spark, data: str, out: str) -> None:
    """Mean and deviation of the splits' F1 beside the honest ensemble's measures, as one JSON object."""
    summary = metrics.f1_summary(spark.read.parquet(f"{out}/by_iteration")).join(spark.read.parquet(f"{out}/honest"))  # one row each
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/evaluation")


def predict(spark, data: str, out: str) -> None:
    """The direction of every document, from the polarities of its n-grams."""
    pipeline.predict(spark.read.parquet(f"{out}/ngrams"), spark.read.parquet(f"{out}/polarity")).write.mode("overwrite").parquet(f"{out}/predictions")


def main(argv: list[str] | None = None) -> dict[str, str]:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = build()
    todo = [s for s in STAGES if s != "full"] if a.stage == "full" else [a.stage]
    done = {}
    for stage in todo:
        globals()[stage](spark, a.data, a.out)
        done[stage] = "done"
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
