import difflib
import json
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from linkloom.functions import gestalt, text
from linkloom.operators import blocking, boosting, evaluation, model, scoring, splitting, validation
from linkloom.plans import fixtures, presets, queries
from linkloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    s1, cd = fixtures.sides(spark, SF)
    return s1.cache(), cd.cache(), blocking.candidate_pairs(s1, cd, presets.analysis().strategies).cache()


@pytest.mark.parametrize(
    "actual, predicted, scores",
    [([], [], (1, 1, 1)), ([], ["S2-1"], (0, 0, 0)), (["S2-1"], [], (0, 0, 0)), (["S2-1"], ["S3-9"], (0, 0, 0)), (["S2-1", "S3-1"], ["S2-1"], (1, 0.5, 0.8333333333333334)), (["S2-1"], ["S2-1", "S3-1"], (0.5, 1, 0.5555555555555556)), (["a", "b", "c"], ["b", "c", "d"], (2 / 3,) * 3)],
)
def test_entity_scores(spark, actual, predicted, scores):
    pairs = lambda xs: spark.createDataFrame([("S1-1", x) for x in xs], "s1_id string, candidate_id string")
    r = evaluation.entity_scores(pairs(predicted), spark.createDataFrame([("S1-1",)], "s1_id string"), pairs(actual)).first()
    assert (r.precision, r.recall, r.f0_5) == pytest.approx(scores)


def test_empty_summary(spark):
    none = spark.createDataFrame([], "s1_id string, candidate_id string")
    r = evaluation.summary(evaluation.entity_scores(none, none, none)).first()
    assert r.num_entities == 0 and r.macro_f0_5 == 0


@pytest.mark.parametrize("match, single, kept", [(0.5, 0.9, 2), (0.5, 0.97, 0), (0.97, 0.9, 0)])
def test_decide(spark, match, single, kept):
    probs = spark.createDataFrame([("S1-1", str(p), p) for p in (0.95, 0.6, 0.4)], "s1_id string, candidate_id string, prob double")
    assert evaluation.decide(probs, match, single).count() == kept


def test_parse_ids(spark):
    rows = [(None, []), ("", []), ("  ", []), ("NaN", []), ("S2-1, S3-2,,", ["S2-1", "S3-2"])]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "k int, x string")
    assert [r[0] for r in df.orderBy("k").select(readers.parse_ids("x")).collect()] == [y for _, y in rows]


def test_countries(spark):
    df = spark.createDataFrame([("us", ""), ("", "us"), ("", ""), ("us", "us"), ("us", "fr")], "a string, b string")
    assert [r[0] for r in df.select(blocking.compatible("a", "b")).collect()] == [True] * 4 + [False]


def test_invariants(spark, small):
    s1, cd, pairs = small
    top = scoring.prune(pairs, s1, cd, top_k=3)
    assert top.join(pairs, ["s1_id", "candidate_id"], "left_anti").isEmpty()
    assert top.groupBy("s1_id").count().where("count > 3").isEmpty()
    t = fixtures.truth(s1, cd)
    recalls = [r.recall_after for r in evaluation.prune_impact(pairs, scoring.prune(pairs, s1, cd, top_k=50), t, (1, 5, 50)).orderBy("top_k").collect()]
    assert recalls == sorted(recalls)
    alone = evaluation.ablation(pairs, t, {"a": 0, "b": 1, "c": 2}).collect()
    full = evaluation.candidate_recall(pairs, s1.select(F.col("entity_id").alias("s1_id")), t).first().candidate_recall
    assert all(r.recall_alone <= full + 1e-12 and r.recall_drop >= 0 for r in alone)


def test_staged_equals_fused(spark, small):
    s1, cd, _ = small
    p = presets.fused()
    staged = scoring.prune(blocking.filter_by_country(blocking.combine(*(blocking.candidate_pairs(s1, cd, [s], by_country=False) for s in p.strategies)), s1, cd), s1, cd, 30, 0.0)
    assert presets.run_preset(s1, cd, p).exceptAll(staged).isEmpty()


def test_parts_of_a_key(spark, small, monkeypatch):
    s1, cd, pairs = small
    monkeypatch.setattr(blocking, "PART", 3)
    parted = blocking.candidate_pairs(s1, cd, presets.analysis().strategies)
    assert parted.exceptAll(pairs).isEmpty() and pairs.exceptAll(parted).isEmpty()


def test_gestalt_is_difflib(spark):
    words = ["", "a", "ab", "abcd", "bcda", "the quick fox", "quick the box", "éa", "ae", "aaaa", "aabaa", "日本 語", "本日"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", text.gestalt_ratio("a", "b").alias("x")).collect():
        assert r.x == difflib.SequenceMatcher(None, r.a, r.b).ratio()


def test_gestalt_of_many_pairs():
    r = random.Random(3)
    some = lambda n: "".join(r.choices(r.choice(["ab", "abc ", "aé日 \U0001f600", "etaoin shrdlu"]), k=r.randint(0, n)))
    pairs = [(some(r.choice([3, 40, 250])), some(r.choice([3, 40, 199, 250]))) for _ in range(1000)] + [("x" * 3000 + "ab", "abc"), ("ab", "b" * 300), (None, "a"), ("a", None), ("", ""), ("", "a")]
    pairs += [(x[:9] + y, y + x[9:]) for x, y in pairs[:500]]
    assert gestalt.ratios(*zip(*pairs)) == [None if None in p else difflib.SequenceMatcher(None, *p).ratio() for p in pairs]
    # all pieces of a column go together: the time of a plain loop over the pairs is far above this one
    many = [(some(40) + str(k), str(k) + some(40)) for k in range(10_000)]
    took = []
    for f in (gestalt.ratios, lambda xs, ys: [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(xs, ys)]):
        began = time.process_time()
        f(*zip(*many))
        took.append(time.process_time() - began)
    assert 2 * took[0] < took[1]


def test_exact_split_is_a_seeded_shuffle(spark, small):
    ids = sorted(r.entity_id for r in small[0].select("entity_id").distinct().collect())
    random.Random(42).shuffle(ids)
    got = {r.s1_id: r.split for r in splitting.exact_split(small[0]).collect()}
    assert got == {x: "train" if k < int(0.8 * len(ids)) else "val" for k, x in enumerate(ids)}


def test_classifier(spark):
    rows = [(f"S1-{k // 4}", f"S2-{k}", float(k % 7 > 3) + (k % 11) / 40, float(k % 5), None if k % 50 == 0 else int(k % 7 > 3)) for k in range(1600)]
    matrix = spark.createDataFrame(rows, "s1_id string, candidate_id string, good double, noise double, label int")
    fitted, held = model.train(matrix, rounds=30)
    assert held.where("label is null").isEmpty() and 1 < len(fitted.stages[-1].trees) <= 30
    inner = model.group_split(matrix).where("not is_test")
    assert held.join(inner, "s1_id", "left_semi").isEmpty()
    scored = model.predict(fitted, held)
    assert evaluation.roc_auc(scored).first()[0] > 0.99
    gains = model.importance(fitted, matrix).collect()
    assert gains[0].feature == "good" and [g.gain for g in gains] == sorted((g.gain for g in gains), reverse=True)


def test_jobs_of_training(spark):
    rows = [(f"S1-{k // 4}", f"S2-{k}", float(k % 7 > 3) + (k % 11) / 40, float(k % 5), int(k % 7 > 3)) for k in range(1600)]
    matrix = spark.createDataFrame(rows, "s1_id string, candidate_id string, good double, noise double, label int")
    spark.sparkContext.setJobGroup("training", "")
    fitted, _ = model.train(matrix, rounds=12)
    spark.sparkContext.setJobGroup("other", "")
    assert len(fitted.stages[-1].trees) == 12
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) < 12  # rounds take no jobs


def test_trees_do_not_depend_on_the_order_of_rows(spark):
    rows = [(f"S1-{k // 4}", f"S2-{k}", (k * 37 % 101) / 100, float(k % 5), int(k * 37 % 101 + k % 5 * 8 > 70)) for k in range(1200)]
    names = "s1_id string, candidate_id string, good double, noise double, label int"
    a, b = (model.predict(*model.train(spark.createDataFrame(x, names).repartition(n), rounds=5)).collect() for x, n in ((rows, 1), (rows[::-1], 3)))
    of = lambda xs: {(r.s1_id, r.candidate_id): r.prob for r in xs}
    assert of(a) == pytest.approx(of(b), abs=1e-9) and len(set(of(a).values())) > 2


def test_calls_of_making_a_model(spark):
    rows = [(f"S1-{k // 4}", f"S2-{k}", (k * 37 % 101) / 100, float(k % 5), int(k * 37 % 101 + k % 5 * 8 > 70)) for k in range(1200)]
    matrix = spark.createDataFrame(rows, "s1_id string, candidate_id string, good double, noise double, label int")
    client, calls = spark.sparkContext._gateway._gateway_client, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(client, "send_command", lambda *a, f=client.send_command, **b: (calls.append(a[0]), f(*a, **b))[1])
        counts = []
        for rounds in (2, 12):
            began = len(calls)
            trees = model.train(matrix, rounds=rounds)[0].stages[-1]
            counts.append((len(calls) - began, trees.totalNumNodes))
    (a, m), (b, n) = counts
    assert n - m > 100 and b - a < 6 * (n - m)  # each call into the JVM takes time, and a model has many nodes
    held = model.predict(PipelineModel(stages=[VectorAssembler(inputCols=["good", "noise"], outputCol="x"), trees]), matrix)
    assert evaluation.roc_auc(held).first()[0] > 0.99 and trees.trees[0].depth > 1


def test_counted_children_add_up():
    """A histogram of a node is that of one child and what is left of it."""
    rng = np.random.default_rng(5)
    codes, label, n = rng.integers(0, 9, (3, 5000)).astype(np.uint8), rng.integers(0, 2, 5000).astype(np.uint8), 5000
    data = b"".join(x.tobytes() for x in (codes, label, np.zeros(n, np.uint8), np.arange(n)))
    rows = boosting._Rows(iter([pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["n", "data"])]), [9, 9, 9])
    pull, left = rng.normal(size=n), rows.codes[1] < 4
    parts = [np.arange(n), np.flatnonzero(left), np.flatnonzero(~left)]
    h = boosting._histograms(rows, parts, pull, [9, 9, 9], 32)
    for at, mine in enumerate(parts):
        for k in range(3):
            for got, weights in zip(h[:, at, k], (None, rows.label[mine].astype(float), pull[mine])):
                assert got == pytest.approx(np.bincount(rows.codes[k][mine], weights, 32))
    assert h[:, 0] - h[:, 1] == pytest.approx(h[:, 2])


def kept_rows(codes, label, held, sizes):
    n = len(label)
    data = b"".join(np.ascontiguousarray(x).tobytes() for x in (codes, label, held, np.arange(n)))
    return boosting._Rows(iter([pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["n", "data"])]), sizes)


def test_features_that_go_together_are_counted_together():
    """Ten features that follow from two are two numbers a row, or one, whatever the product of their sizes is."""
    rng, n = np.random.default_rng(6), 20_000
    a, b = rng.integers(0, 30, (2, n))
    codes = np.stack([a, a // 2, (a * 7) % 30, a % 3, 29 - a, b, b // 3, (b * 11) % 30, b % 2, 29 - b]).astype(np.uint8)
    label, held = (rng.random(n) < 0.1).astype(np.uint8), (rng.random(n) < 0.2).astype(np.uint8)
    rows = kept_rows(codes, label, held, [30] * 10)
    assert len(rows.groups) <= 2
    order = np.argsort(2 * held + label, kind="stable")
    assert (rows.codes == codes[:, order]).all() and (rows.label == (label[order] > 0)).all() and (rows.key == order[: rows.learnt]).all()
    mine, pull = np.flatnonzero(rng.random(rows.learnt) < 0.5), rng.normal(size=rows.learnt)
    h = boosting._histograms(rows, [mine], pull, [30] * 10, 32)
    for k in range(10):
        for got, weights in zip(h[:, 0, k], (None, rows.label[mine].astype(float), pull[mine])):
            assert got == pytest.approx(np.bincount(rows.codes[k][mine], weights, 32))
    assert (rows.right(mine, 7, 11) == (rows.codes[7][mine] > 11)).all()


def test_bytes_that_a_row_takes():
    """A task keeps all its rows in memory while trees are trained."""
    rng, n = np.random.default_rng(7), 50_000
    a = rng.integers(0, 30, n)
    codes = np.stack([(a * k + k) % 30 for k in range(19)]).astype(np.uint8)
    rows = kept_rows(codes, np.zeros(n, np.uint8), np.zeros(n, np.uint8), [30] * 19)
    arrays = [x for o in (rows, *getattr(rows, "groups", [])) for x in vars(o).values() if isinstance(x, np.ndarray)]
    assert rows.n == n and sum(x.nbytes for x in arrays) < 16 * n


def test_words_of_entities(spark, tmp_path):
    """Names and addresses are of the first eight words, however long or odd the text is."""
    texts = [None, "", " .. ", "one", "a-b_c d\\e [f] ^g h|i j", "!!a!!b!!c!!d!!e!!f!!g!!h!!i", "\x1c\x1da\x0bb\x0cc\r\nd\x85e f g h i j", "\u0130x \u03a3 c d e f g h i j", "word " * 200_000]
    spark.createDataFrame([(k, "en", 5, t) for k, t in enumerate(texts)], "doc_id long, lang string, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = fixtures.entities(spark, str(tmp_path))
    assert "regexp_extract" in out._jdf.queryExecution().optimizedPlan().toString()  # else every word of the text is split off
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", f"filter(split(translate(lower(text), '{fixtures._SPARK}', repeat(' ', 32)), '\\\\s+'), x -> x <> '') as t")
    t = {r.doc_id: r.t for r in rows.collect()}
    for r in out.collect():
        k = int(r.entity_id[3:])
        end = (" Ltd.", ", Inc", " GmbH", "")[k % 4]
        assert r.business_name == (None if t[k] is None else " ".join(t[k][:4]) + end)
        assert k % 13 == 0 or r.business_address == (None if t[k] is None else f"5 {' '.join(t[k][4:8])} 00005")


def test_gbt_scores_read_a_matrix_that_is_kept(spark):
    out = queries.Q["gbt_scores"](spark, SF)
    assert out.inputFiles() and not any("documents" in f for f in out.inputFiles())  # else it would be computed anew
    assert out.count() > 0 and out.where("prob < 0 or prob > 1 or prob is null").isEmpty()


def test_order_of_sweep(spark, small):
    s1, cd, pairs = small
    probs = scoring.score_pairs(pairs.select("s1_id", "candidate_id"), s1, cd).withColumnRenamed("score", "prob")
    rows = evaluation.threshold_sweep(probs, s1.select(F.col("entity_id").alias("s1_id")), fixtures.truth(s1, cd)).collect()
    assert [(-r.macro_f0_5, r.match_threshold, r.singleton_threshold) for r in rows] == sorted((-r.macro_f0_5, r.match_threshold, r.singleton_threshold) for r in rows)


def test_plans(spark, small):
    s1, cd, _ = small
    plan = presets.run_preset(s1, cd, presets.fused())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_splits(spark, small):
    exact = splitting.exact_split(small[0])
    n = exact.count()
    assert exact.where("split = 'train'").count() == int(n * 0.8) and exact.select("s1_id").distinct().count() == n
    assert splitting.hash_split(small[0]).count() == n
    with pytest.raises(ValueError):
        splitting.exact_split(small[0], most_ids=3)


def test_empty_inputs(spark, small):
    s1, cd, _ = small
    none = s1.limit(0)
    assert presets.run_preset(none, cd, presets.fused()).isEmpty() and presets.run_preset(s1, none, presets.fused()).isEmpty()


def write(path, body):
    path.write_text(body, encoding="utf-8")
    return str(path)


HEAD, CAND = "source1_entity_id\tmatched_entity_ids\n", "source1_entity_id\tcandidate_entity_ids\n"


@pytest.mark.parametrize(
    "body, rules",
    [
        (HEAD + "S1-1\tS2-1\nS1-2\t\n", set()),
        ("", {"VAL2"}),
        ("source1_entity_id,matched_entity_ids\n", {"VAL3"}),
        ("a\tb\n", {"VAL4"}),
        (HEAD + "S1-1\tS2-1\nS1-2\t\njunk\n\n", {"VAL5"}),
        (HEAD + "S1-1\tS2-1\nS1-1\tS2-1\nS1-2\t\n", {"VAL6"}),
        (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", {"VAL7"}),
        (HEAD + "S1-1\tS1-2\nS1-2\t\n", {"VAL8"}),
        (HEAD + "S1-1\tS2-1, S2-2\nS1-2\t\n", {"VAL9"}),
        (HEAD + "S1-1\tS2-9\nS1-2\t\n", {"VAL10"}),
        (HEAD + "S1-1\tS2-1\n", {"VAL11"}),
        (HEAD + "S1-1\tS2-1\nS1-2\t\nS1-3\t\n", {"VAL12"}),
    ],
)
def test_validator(spark, tmp_path, body, rules):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    m, c = write(tmp_path / "m.tsv", body), write(tmp_path / "c.tsv", CAND + "S1-1\tS2-1\nS1-2\tS2-2\n")
    found = validation.validate(spark, m, c, ids("S1-1", "S1-2"), ids("S2-1", "S2-2"))
    errors = {r.rule for r in found.collect() if r.level != "warning"}
    assert errors == rules and validation.passed(found) == (not rules)


def test_validator_warnings(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "id string")
    m, c = write(tmp_path / "m.tsv", HEAD + "S1-1\tS2-1\n"), write(tmp_path / "c.tsv", CAND + "S1-1\tS2-2\n")
    assert {r.rule for r in validation.validate(spark, m, c, ids).collect()} == {"VAL13", "VAL15"}
    assert {r.rule for r in validation.validate(spark, m, None, ids).collect()} == {"VAL14", "VAL15"}
    assert {r.rule for r in validation.validate(spark, str(tmp_path / "no"), c, ids).collect()} == {"VAL1", "VAL15"}
    assert {r.rule for r in validation.validate(spark, m, c, None).collect()} == {"VAL16"}


def test_lines_are_in_order(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"part-{k}.txt", "".join(f"{k} {j} {'x' * (j % 50)}\n" for j in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("5k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [r.value.split()[:2] for r in readers.read_lines(spark, str(tmp_path)).orderBy("line").collect()]
            assert got == [[str(k), str(j)] for k in range(3) for j in range(2000)]
            head = readers.read_records(spark, write(tmp_path / "r.tsv", "entity_id\tcountry\n" + "".join(f"S1-{j}\t\n" for j in range(3000))), head=7).collect()
            assert [r.entity_id for r in head] == [f"S1-{j}" for j in range(7)]
            (tmp_path / "r.tsv").unlink()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    twice = write(tmp_path / "g.tsv", HEAD + "S1-1\tS2-1\n" + "S1-2\t\n" * 900 + "S1-1\tS2-2,S2-3\n")
    assert {r.s1_id: r.matches for r in readers.read_ground_truth(spark, twice).collect()} == {"S1-1": ["S2-2", "S2-3"], "S1-2": []}


def test_not_utf8(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "id string")
    (tmp_path / "m.tsv").write_bytes(HEAD.encode() + b"S1-1\tS2-\xff\n")
    found = validation.validate(spark, str(tmp_path / "m.tsv"), None, ids)
    assert {r.rule for r in found.collect()} == {"VAL14", "VAL15", "VAL17"} and not validation.passed(found)


def test_sources_and_sinks(spark, tmp_path, small):
    s1, cd, pairs = small
    path = write(tmp_path / "r.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"a\tb"\tNA\nS1-2\tX\t\tus\n')
    rows = readers.read_records(spark, path).orderBy("entity_id").collect()
    assert rows[0].business_name is None and rows[0].country is None and rows[0].business_address == "a\tb" and rows[1].business_address is None
    lists = writers.sorted_lists(pairs)
    writers.export_object(lists, str(tmp_path / "c.json"))
    assert len(json.loads((tmp_path / "c.json").read_text())) == lists.count()
    back = readers.read_candidates(spark, str(tmp_path / "absent"), str(tmp_path / "c.json"))
    assert back.select("s1_id", "candidate_id").exceptAll(pairs.select("s1_id", "candidate_id")).isEmpty()
    writers.write_tsv(writers.empty_results(s1.select(F.col("entity_id").alias("s1_id"))), str(tmp_path / "e"))
    body = "".join((tmp_path / "e" / f).read_text() for f in os.listdir(tmp_path / "e") if f.endswith(".csv"))
    assert '"' not in body and "S1-0\t\n" in body
    halves = splitting.hash_split(s1)
    writers.write_split(halves, str(tmp_path / "s"))
    n = writers.export_split(halves, str(tmp_path / "s.json"))
    one = json.loads((tmp_path / "s.json").read_text())
    assert n == halves.count() == len(one["train_s1_ids"]) + len(one["val_s1_ids"]) and one["val_s1_ids"] == sorted(one["val_s1_ids"])
    for at in ("s", "s.json"):
        assert readers.read_split(spark, str(tmp_path / at)).exceptAll(halves).isEmpty()
    p = write(tmp_path / "p.jsonl", '{"s1_id": "S1-1", "candidates": ["a"]}\nbad\n{"s1_id": "S1-1", "candidates": ["b"]}\n')
    assert readers.read_progress(spark, p).first().candidates == ["b"]
    assert readers.read_ids(spark, write(tmp_path / "i.tsv", "id\tx\n a \ty\n\nb\n")).count() == 2
    assert readers.read_sniffed(spark, write(tmp_path / "n.csv", "S1-1,x\nS1-2,y\n")).select("entity_id").count() == 2
    assert readers.read_predictions(spark, str(tmp_path / "none.tsv")).isEmpty()
