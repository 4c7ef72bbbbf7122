"""Every command, on files made from the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom import cli
from linkloom.plans import fixtures
from linkloom.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The three sources and the ground truth as files."""
    top = tmp_path_factory.mktemp("cli")
    s1, cd = fixtures.sides(spark, SF)
    for n in (1, 2, 3):
        rows = (s1 if n == 1 else cd).where(F.col("entity_id").startswith(f"S{n}-")).select("entity_id", "business_name", "business_address", "country").toPandas()
        for name in ("train", "test"):
            rows.to_csv(top / f"{name}_source{n}.tsv", sep="\t", index=False)
    truth = fixtures.truth(s1, cd).groupBy("s1_id").agg(F.concat_ws(",", F.collect_list("candidate_id")).alias("matched_entity_ids"))
    truth = s1.select(F.col("entity_id").alias("s1_id")).join(truth, "s1_id", "left").toPandas().rename(columns={"s1_id": "source1_entity_id"})
    truth.to_csv(top / "truth.tsv", sep="\t", index=False)
    return top


def sources(top, name="train"):
    return [x for n in (1, 2, 3) for x in (f"--s{n}", f"{top}/{name}_source{n}.tsv")]


def objects(spark, path, to):
    from linkloom.sources import writers

    writers.export_object(spark.read.json(path), str(to))
    return str(to)


def test_block_prune_build_train_sweep(spark, files, tmp_path, capfd):
    base, truth = sources(files), ["--ground-truth", f"{files}/truth.tsv"]
    assert cli.main(["block", *base, *truth, "--output", f"{tmp_path}/b"]) == 0
    said = capfd.readouterr().out
    assert "candidate_recall" in said and "recall_drop" in said
    lists = objects(spark, f"{tmp_path}/b", tmp_path / "b.json")
    assert cli.main(["block", *base, *truth, "--output", f"{tmp_path}/t", "--top-k", "5", "--sample-s1", "20"]) == 0
    top = spark.read.json(f"{tmp_path}/t")
    assert top.count() == 20 and top.where("size(candidates) > 5").isEmpty()
    assert cli.main(["prune", *base, *truth, "--candidates", "absent.json", lists, "--output", f"{tmp_path}/p", "--top-k", "3"]) == 0
    assert "recall_after" in capfd.readouterr().out and spark.read.json(f"{tmp_path}/p").where("size(candidates) > 3").isEmpty()
    assert cli.main(["build", *base, *truth, "--candidates", lists, "--output", f"{tmp_path}/f"]) == 0
    assert "positive_rate" in capfd.readouterr().out
    other = spark.read.parquet(f"{tmp_path}/f").withColumnsRenamed({"s1_id": "source1_entity_id", "candidate_id": "candidate_entity_id", "label": "y"})
    other.write.parquet(f"{tmp_path}/g")
    columns = ["--s1-id-col", "source1_entity_id", "--cand-id-col", "candidate_entity_id"]
    assert cli.main(["train", "--features", f"{tmp_path}/g", *columns, "--label-col", "y", "--rounds", "5", "--output-model", f"{tmp_path}/m", "--output-importance", f"{tmp_path}/i"]) == 0
    assert "roc_auc" in capfd.readouterr().out and spark.read.csv(f"{tmp_path}/i", header=True).count() == 19
    assert cli.main(["sweep", "--features", f"{tmp_path}/g", *columns, "--candidates", lists, "--model", f"{tmp_path}/m", *truth, "--match-thresholds", "0.4", "0.6", "--singleton-threshold", "0.5"]) == 0
    assert "macro_f0_5" in capfd.readouterr().out


def test_full_goes_on(spark, files, tmp_path, capfd):
    args = ["full", *sources(files, "test"), "--output-jsonl", f"{tmp_path}/o", "--output-json", f"{tmp_path}/o.json"]
    assert cli.main([*args, "--sample-s1", "10", "--batch-log-every", "4"]) == 0
    assert "3 of 3 batches" in capfd.readouterr().out and len(json.loads((tmp_path / "o.json").read_text())) == 10
    assert cli.main(args) == 0
    out = json.loads((tmp_path / "o.json").read_text())
    assert len(out) == readers.read_ids(spark, f"{files}/test_source1.tsv").count() and max(map(len, out.values())) <= 50
    assert cli.main(args) == 0 and "batches" not in capfd.readouterr().out.split("exported")[-1]


def test_split_empty_evaluate_validate(spark, files, tmp_path, capfd):
    assert cli.main(["split", "--input_csv", f"{files}/train_source1.tsv", "--output_json", f"{tmp_path}/s.json", "--output", f"{tmp_path}/s", "--exact"]) == 0
    one = json.loads((tmp_path / "s.json").read_text())
    assert len(one["train_s1_ids"]) == int(0.8 * (len(one["train_s1_ids"]) + len(one["val_s1_ids"])))
    (tmp_path / "none.tsv").write_text("entity_id\nS9-1\n")
    assert cli.main(["split", "--input_csv", f"{tmp_path}/none.tsv", "--output_json", f"{tmp_path}/x.json"]) == 1
    assert cli.main(["empty", "--split", f"{tmp_path}/s.json", "--output", f"{tmp_path}/e"]) == 0
    assert spark.read.csv(f"{tmp_path}/e/matching_results.tsv", sep="\t", header=True).count() == len(one["val_s1_ids"])
    assert cli.main(["evaluate", "--predictions", f"{files}/truth.tsv", "--ground-truth", f"{files}/truth.tsv", "--split", f"{tmp_path}/s.json", "--output", f"{tmp_path}/v", "--notes", "all right"]) == 0
    log = spark.read.csv(f"{tmp_path}/v/experiment_log", header=True).collect()
    assert len(log) == 1 and float(log[0].macro_f0_5) == 1.0 and log[0].notes == "all right"
    (tmp_path / "twice.tsv").write_text((files / "truth.tsv").read_text() + "S1-0\t\n")
    (tmp_path / "bare.json").write_text('{"train_s1_ids": ["S1-0"], "val_s1_ids": []}')
    assert cli.main(["evaluate", "--predictions", f"{tmp_path}/absent", "--ground-truth", f"{tmp_path}/twice.tsv", "--split", f"{tmp_path}/bare.json", "--output", f"{tmp_path}/w"]) == 0
    said = capfd.readouterr().err
    assert "several rows" in said and "no validation ids" in said
    assert cli.main(["empty", "--ids", f"{files}/test_source1.tsv", "--output", f"{tmp_path}/z"]) == 0
    good = ["-m", f"{tmp_path}/z/matching_results.tsv", "-c", f"{tmp_path}/z/candidate_pairs.tsv"]
    assert cli.main(["validate", *good, "-t", str(files), "--check-ids"]) == 0
    assert "PASS" in capfd.readouterr().out
    assert cli.main(["validate", *good, "-t", str(tmp_path)]) == 1
    assert "VAL16" in capfd.readouterr().out
    (tmp_path / "test_source1.tsv").write_text((files / "test_source1.tsv").read_text())
    assert cli.main(["validate", *good, "-t", str(tmp_path), "--check-ids"]) == 0
    assert "not checked" in capfd.readouterr().err
    (tmp_path / "bad.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-0\t\xff\n")
    assert cli.main(["validate", "-m", f"{tmp_path}/bad.tsv", "-t", str(files)]) == 1
    assert "FAIL" in capfd.readouterr().out
