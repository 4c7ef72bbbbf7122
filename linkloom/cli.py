"""Command line: blocking, pruning, features, training, sweeps, evaluation, splits and validation."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocking, evaluation, features, model, scoring, splitting, validation
from .plans import presets
from .sources import readers, writers
from .streaming import resume


def _sources(spark: SparkSession, a) -> tuple[DataFrame, DataFrame]:
    s1 = readers.read_records(spark, a.s1, head=getattr(a, "sample_s1", None))
    return s1, readers.read_records(spark, a.s2).unionByName(readers.read_records(spark, a.s3))


def _truth(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Pairs of the ground truth; says which ids it has more than once."""
    if not path:
        return None
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    more = readers.duplicate_ids(rows, "source1_entity_id").agg(F.count("*"), F.min("id")).first()
    if more[0]:
        print(f"warning: {more[0]} ids of {path} have several rows, e.g. {more[1]}: the last counts", file=sys.stderr)
    return readers.pairs_of(readers.read_ground_truth(spark, path))


def _renamed(matrix: DataFrame, a) -> DataFrame:
    """A feature matrix with its id and label columns under the names used here."""
    names = {a.s1_id_col: "s1_id", a.cand_id_col: "candidate_id"} | ({a.label_col: "label"} if "label_col" in a else {})
    return matrix.withColumnsRenamed(names)


def block(spark: SparkSession, a) -> int:
    s1, cd = _sources(spark, a)
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    if a.top_k:
        pairs = presets.run_preset(s1, cd, presets.fused(), a.top_k)
        writers.write_candidates(scoring.nested(pairs, ids), a.output)
    else:
        pairs = blocking.candidate_pairs(s1, cd, presets.analysis().strategies)
        writers.write_candidates(writers.sorted_lists(pairs), a.output)
    if truth := _truth(spark, a.ground_truth):
        truth = truth.join(ids, "s1_id", "left_semi")
        evaluation.candidate_recall(pairs, ids, truth).show(truncate=False)
        if not a.top_k:
            evaluation.ablation(pairs, truth, {"name_tokens": 0, "name_lsh": 1, "addr_tokens": 2}).show(truncate=False)
    return 0


def full(spark: SparkSession, a) -> int:
    """The full-scale run: appends lists to the JSON lines, in a folder named by the parameters, and leaves out records
    that are there already, so that a run that was stopped goes on."""
    s1, cd = _sources(spark, a)
    preset = presets.full_scale(a.max_bucket)
    out = f"{a.output_jsonl}/config={resume.config_hash(preset, a.top_k)}"
    done = validation.there(lambda: readers.read_progress(spark, out))
    todo = s1 if done is None else s1.join(done.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_anti")
    n = todo.count()
    parts = -(-n // a.batch_log_every) if a.batch_log_every else min(n, 1)
    for k in range(parts):
        part = todo.where(F.pmod(F.xxhash64("entity_id"), F.lit(parts)) == k)
        ranked = presets.run_preset(part, cd, preset, a.top_k)
        writers.write_candidates(scoring.nested(ranked, part.select(F.col("entity_id").alias("s1_id"))), out, "append")
        print(f"{k + 1} of {parts} batches done, {n} records in all")
    if a.output_json:
        print(writers.export_object(readers.read_progress(spark, out, strict=True), a.output_json), "lists exported")
    return 0


def prune(spark: SparkSession, a) -> int:
    s1, cd = _sources(spark, a)
    pairs = readers.read_candidates(spark, *a.candidates).select("s1_id", "candidate_id")
    ranked = scoring.prune(pairs, s1, cd, max(a.top_k, *evaluation.PRUNE_LEVELS), a.min_score)
    kept = ranked.where(F.col("rank") <= a.top_k)
    writers.write_candidates(scoring.nested(kept, pairs), a.output)
    if truth := _truth(spark, a.ground_truth):
        evaluation.prune_impact(pairs, ranked, truth, tuple(sorted({a.top_k, *evaluation.PRUNE_LEVELS}))).orderBy("top_k").show(truncate=False)
    return 0


def build(spark: SparkSession, a) -> int:
    s1, cd = _sources(spark, a)
    writers.write_features(features.feature_matrix(readers.read_candidates(spark, *a.candidates), s1, cd, _truth(spark, a.ground_truth)), a.output)
    matrix = spark.read.parquet(a.output)
    features.feature_summary(matrix).show(30, truncate=False)
    features.label_balance(matrix).show(truncate=False)
    return 0


def train(spark: SparkSession, a) -> int:
    matrix = _renamed(spark.read.parquet(a.features), a)
    fitted, held = model.train(matrix, a.test_size, a.seed, a.rounds)
    fitted.write().overwrite().save(a.output_model)
    model.importance(fitted, matrix).coalesce(1).write.mode("overwrite").csv(a.output_importance, header=True)
    scored = model.predict(fitted, held)
    for out in (evaluation.roc_auc(scored), evaluation.average_precision(scored), evaluation.pair_scores(scored)):
        out.show(truncate=False)
    return 0


def sweep(spark: SparkSession, a) -> int:
    from pyspark.ml import PipelineModel

    probs = model.predict(PipelineModel.load(a.model), _renamed(spark.read.parquet(a.features), a))
    ids = readers.read_candidates(spark, *a.candidates).select("s1_id").distinct()
    matches = tuple(a.thresholds or a.match_thresholds or ([a.match_threshold] if a.match_threshold else evaluation.THRESHOLDS))
    singles = tuple(a.thresholds or a.singleton_thresholds or ([a.singleton_threshold] if a.singleton_threshold else matches))
    evaluation.threshold_sweep(probs, ids, _truth(spark, a.ground_truth).join(ids, "s1_id", "left_semi"), matches, singles).show(100, truncate=False)
    return 0


def evaluate(spark: SparkSession, a) -> int:
    ids = readers.read_split(spark, a.split).where("split = 'val'").select("s1_id")
    if ids.isEmpty():
        print(f"warning: {a.split} has no validation ids", file=sys.stderr)
    scores = evaluation.entity_scores(readers.pairs_of(readers.read_predictions(spark, a.predictions)), ids, _truth(spark, a.ground_truth))
    total = evaluation.summary(scores)
    total.show(truncate=False)
    writers.write_details(scores, a.output)
    writers.log_experiment(total, f"{a.output}/experiment_log", a.predictions, a.notes)
    return 0


def split(spark: SparkSession, a) -> int:
    records = readers.read_sniffed(spark, a.input_csv)
    out = (splitting.exact_split if a.exact else splitting.hash_split)(records, a.seed, a.train_size)
    if out.isEmpty():
        print("no reference ids found", file=sys.stderr)
        return 1
    if a.output:
        writers.write_split(out, a.output)
    print(writers.export_split(out, a.output_json), "ids")
    return 0


def empty(spark: SparkSession, a) -> int:
    """Result files without matches: for the validation ids of a split, or for all ids of a table."""
    if a.split:
        ids = readers.read_split(spark, a.split).where("split = 'val'").select("s1_id")
    else:
        ids = readers.read_ids(spark, a.ids).withColumnRenamed("id", "s1_id")
    writers.write_tsv(writers.empty_results(ids), f"{a.output}/matching_results.tsv")
    writers.write_tsv(writers.empty_results(ids, "candidate_entity_ids"), f"{a.output}/candidate_pairs.tsv")
    return 0


def validate(spark: SparkSession, a) -> int:
    ids = lambda n: validation.there(lambda: readers.read_ids(spark, f"{a.test_dir}/test_source{n}.tsv"))
    valid = [x for x in (ids(2), ids(3)) if x is not None] if a.check_ids else []
    if a.check_ids and len(valid) < 2:
        print("warning: a table of target ids is missing, so ids are not checked", file=sys.stderr)
    found = validation.validate(spark, a.matching, a.candidate, ids(1), valid[0].union(valid[1]) if len(valid) == 2 else None).cache()
    validation.said(found).orderBy("rule").show(100, truncate=False)
    if lines := validation.there(lambda: readers.read_lines(spark, a.matching)):
        validation.counts(validation.parse(lines)).show()
    good = validation.passed(found)
    print("PASS" if good else "FAIL")
    return 0 if good else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(run, *names: str, **defaults):
        c = sub.add_parser(run.__name__)
        c.set_defaults(run=run)
        for n in names:
            c.add_argument(*n.split(), required=True) if n[0] == "-" else c.add_argument(f"--{n}", required=True)
        for n, v in defaults.items():
            flag = f"--{n.replace('_', '-')}"
            if isinstance(v, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(v, list):
                c.add_argument(flag, nargs="+", type=float, default=None)
            else:
                c.add_argument(flag, type=v if isinstance(v, type) else type(v), default=None if isinstance(v, type) else v)
        return c

    files = ("s1", "s2", "s3")
    columns = {"s1_id_col": "s1_id", "cand_id_col": "candidate_id"}
    command(block, *files, "output", ground_truth=str, sample_s1=int, top_k=int)
    command(full, *files, "output-jsonl", output_json=str, sample_s1=int, top_k=50, max_bucket=1000, batch_log_every=int)
    command(prune, *files, "output", ground_truth=str, top_k=30, min_score=0.0).add_argument("--candidates", nargs="+", required=True)
    command(build, *files, "output", ground_truth=str).add_argument("--candidates", nargs="+", required=True)
    command(train, "features", "output-model", "output-importance", test_size=0.2, seed=42, rounds=1000, label_col="label", **columns)
    command(sweep, "features", "model", "ground-truth", match_threshold=float, singleton_threshold=float, match_thresholds=[], singleton_thresholds=[], thresholds=[], **columns).add_argument("--candidates", nargs="+", required=True)
    command(evaluate, "predictions", "ground-truth", "split", "output", notes="")
    command(split, "input_csv", "output_json", output=str, seed=42, train_size=0.8, exact=False)
    command(empty, "output", split=str, ids=str)
    command(validate, "-m --matching", "-t --test-dir", check_ids=False).add_argument("-c", "--candidate")
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.appName("linkloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
