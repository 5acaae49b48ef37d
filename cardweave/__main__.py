"""python -m cardweave train-linear | train-boosted | compare | hybrid | evaluate | accept; each has --help.

Items and pairs are Parquet; run.py scores with what the train commands write.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.features import NAMES
from .operators.metrics import extrapolated
from .plans import harness, training
from .sources import tables


def method_of(model_path: str | None) -> str:
    return os.environ.get("MATCH_METHOD", "boosted" if model_path else "tfidf")


def show(report: DataFrame) -> None:
    for row in report.collect():
        print("  ".join(f"{v:.6f}" if isinstance(v, float) else f"{v!s:<28}" for v in row))


def parser() -> argparse.ArgumentParser:
    ask = argparse.ArgumentParser(prog="cardweave", description=__doc__)
    commands = ask.add_subparsers(dest="command", required=True)

    def add(name: str, about: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        one.add_argument("--items", required=True)
        one.add_argument("--matches", required=True, help="labelled pairs")
        return one

    def add_training(name: str, about: str, mode: str) -> argparse.ArgumentParser:
        one = add(name, about)
        one.add_argument("--feature-cache")
        one.add_argument("--seed", type=int, default=2026)
        one.add_argument("--split", choices=sorted(training.SPLITS), default=mode)
        one.add_argument("--valid-size", type=float, default=0.2)
        return one

    def add_boosting(one: argparse.ArgumentParser) -> None:
        for option, kind, default in (("--max-iter", int, 250), ("--max-leaves", int, 31), ("--min-leaf", int, 40), ("--l2", float, 2.0)):
            one.add_argument(option, type=kind, default=default)

    linear = add_training("train-linear", "holdout report, then a linear model of all pairs", "random")
    linear.add_argument("--output")
    linear.add_argument("--c", type=float, default=1.0)
    linear.add_argument("--skip-refit", action="store_true", help="the report only")
    boosted = add("train-boosted", "a boosted model of all pairs")
    boosted.add_argument("--feature-cache")
    boosted.add_argument("--output", required=True)
    add_boosting(boosted)
    rival = add_training("compare", "boosting or extra trees, by category", "id-tail")
    rival.add_argument("--estimator", choices=("hist", "extra"), default="hist")
    add_boosting(rival)
    hybrid = add_training("hybrid", "human and soft labels together", "id-tail")
    hybrid.add_argument("--soft-items", required=True)
    hybrid.add_argument("--soft-matches", required=True)
    hybrid.add_argument("--soft-cache")
    hybrid.add_argument("--block-rows", type=int, default=1_000_000)
    hybrid.add_argument("--most", type=int, default=20_000, help="soft pairs of a block and category")
    check = add("evaluate", "average precision of a method, and its time")
    check.add_argument("--method")
    check.add_argument("--model_path")
    check.add_argument("--sample", type=int, default=0, help="about so many pairs; 0: all")
    check.add_argument("--cats", help="categories of the first card, with commas")
    check.add_argument("--seed", type=int, default=1234)
    stages = add("accept", "the staged acceptance; exit code 1 if a stage fails")
    stages.add_argument("--stage", choices=(*harness.STAGES, "all"), default="check")
    stages.add_argument("--folder", required=True, help="for prepared inputs and outputs")
    stages.add_argument("--model_path")
    stages.add_argument("--seed", type=int, default=1234)
    return ask


def boosting_options(given: argparse.Namespace) -> dict:
    return {"iterations": given.max_iter, "leaves": given.max_leaves, "least": given.min_leaf, "l2": given.l2}


def models_of(spark: SparkSession, method: str, path: str | None) -> dict:
    if method == "supervised":
        return {"models": tables.read_model(spark, path, NAMES)}
    if method == "boosted":
        return {"models": tables.read_model(spark, f"{path}/forest", NAMES), "baseline": tables.read_model(spark, f"{path}/baseline", NAMES)}
    return {}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    if given.command == "train-linear" and not (given.output or given.skip_refit):
        raise SystemExit("train-linear needs --output or --skip-refit")
    spark = spark or SparkSession.builder.appName("cardweave").getOrCreate()
    items, pairs = tables.load_items(spark, given.items), tables.load_pairs(spark, given.matches)

    if given.command == "accept":
        wanted = harness.STAGES if given.stage == "all" else {given.stage: harness.STAGES[given.stage]}
        done = harness.accept(spark, items, pairs, given.folder, wanted, seed=given.seed, method=method_of(given.model_path), model_path=given.model_path)
        for stage, took, errors in done:
            print(f"{stage}: {took:.1f} s, {'; '.join(errors) or 'passed'}")
        return int(len(done) < len(wanted) or any(errors for _, _, errors in done))
    if given.command == "evaluate":
        method = given.method or method_of(given.model_path)
        report, took, n = training.evaluate(items, pairs, method, given.sample, given.cats, given.seed, **models_of(spark, method, given.model_path))
        show(report)
        show(report.agg(F.lit("macro"), F.avg("ap")))
        for stage, (total, limit) in harness.STAGES.items():
            far, fits = extrapolated(took, n, total, limit)
            print(f"{stage}: {total} pairs in {far:.0f} s of {limit}, {'in time' if fits else 'too slow'}")
        return 0

    rows = training.labelled_features(pairs, items, given.feature_cache)
    if given.command == "train-boosted":
        training.write_boosted(rows, given.output, **boosting_options(given))
        return 0
    fit, valid = training.split(rows, given.split, given.valid_size, given.seed)
    if given.command == "train-linear":
        report = training.holdout_report(training.holdout_scores(fit, valid, given.c)).cache()
        show(training.macro(report))
        show(report.filter("scorer = 'supervised'").select("cat", "ap").orderBy("ap", "cat"))
        if not given.skip_refit:
            training.write_linear(rows, given.output, given.c)
    elif given.command == "compare":
        options = boosting_options(given) if given.estimator == "hist" else {"seed": given.seed}
        report = training.compare(fit, valid, given.estimator, **options).cache()
        show(report.orderBy("cat"))
        show(report.agg(F.lit("macro"), F.avg("ap")))
    else:
        soft_items, soft_pairs = tables.load_items(spark, given.soft_items), tables.load_pairs(spark, given.soft_matches)
        sampled = training.soft_sample(soft_pairs, soft_items, given.block_rows, given.most, given.seed)
        soft = training.labelled_features(sampled, soft_items, given.soft_cache)
        show(training.macro(training.hybrid_report(fit, valid, soft)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
