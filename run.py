"""Command line: python run.py --items_path … --matches_path … --output_path …; the method is in MATCH_METHOD."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from cardweave.plans.pipeline import predict_pipeline


def main() -> None:
    ask = argparse.ArgumentParser(description=__doc__)
    for name in ("--items_path", "--matches_path", "--output_path"):
        ask.add_argument(name, required=True)
    ask.add_argument("--model_path", default=os.environ.get("PAIR_MODEL_PATH"))
    given = ask.parse_args()
    method = os.environ.get("MATCH_METHOD", "boosted" if given.model_path else "tfidf")
    spark = SparkSession.builder.appName("cardweave").getOrCreate()
    n = predict_pipeline(spark, given.items_path, given.matches_path, given.output_path, method, given.model_path)
    print(f"{n} pairs scored by {method}")


if __name__ == "__main__":
    main()
