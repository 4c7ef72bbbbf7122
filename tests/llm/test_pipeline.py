"""The stages one by one, on documents of known kinds."""

import re

import corpus_pipeline
from linkloom.llm import pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, docs_dir = docs.columns, tmp_path
    seen = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard", "secret_scan", "harmonic_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{docs_dir}/{k}")
        docs = spark.read.parquet(f"{docs_dir}/{k}")
        now = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == cols and set(now) <= set(seen) and now
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 20 for r in now.values()) and len(now) < len(seen)
        if name == "ngram_jaccard":
            assert len({r.text for r in now.values()}) == len(now)
        if name == "secret_scan":
            assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) for r in now.values()) and len(now) == len(seen)
        seen = now
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(seen)


def test_frequent_lines_go(spark):
    own = lambda k: " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(25))
    rows = [(k, f"all rights reserved by us\n{own(k)}", "en", "h", 1) for k in range(26)] + [(99, f"{own(0)}\n{own(1)}", "en", "h", 1), (100, "short", "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.quality_rules(spark, docs, SF).collect()}
    assert set(got) == {*range(26), 99}
    assert all(got[k].text == own(k) and got[k].n_chars == len(own(k)) for k in range(26)) and got[99].text == rows[26][1]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, gone__ string, tag string"


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids shared by good and bad rows, further columns."""
    own = lambda k: " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(26))
    rows = [
        (1, own(0), "en", "h", 9), (1, "too short", "en", "h", 9), (None, "two words", "en", None, None), (None, own(1), "en", "h", 9),
        (2, None, "en", "h", None), (3, "", None, "h", 0), (4, own(2), "en", "h", 9), (4, own(2), "en", "h", 9), (5, own(2) + " token = abcdefghijkl", "en", "h", 9),
        (6, " ".join(f"v{k}" for k in range(300_000)), "en", "h", 1), (None, own(1), "en", "h", 9), (7, "1 2 3 4 " * 10, "en", "h", 1),
    ]
    docs = spark.createDataFrame([(*r, k, "k", "g", "t") for k, r in enumerate(rows)], COLUMNS)
    left = lambda df: sorted((r.row, r.text) for r in df.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = left(out)
        if name == "quality_rules":
            assert [k for k, _ in got] == [0, 3, 6, 7, 8, 9, 10]
        if name == "language_id":
            assert [k for k, _ in got] == [0, 1, 2, 3, 6, 7, 8, 9, 10]
        if name == "ngram_jaccard":
            texts = [t for _, t in got if t]
            assert len(texts) == len(set(texts)) and [k for k, _ in got][:3] == [0, 1, 2] and {r[0] for r in got} >= {4, 5, 9, 11} and 8 not in {r[0] for r in got}
        if name == "secret_scan":
            assert len(got) == len(rows) and dict(got)[8] == own(2) + " [SECRET]" and dict(got)[4] is None
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
