"""Readers of records, ground truth, candidates, splits and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
# The words that count as missing in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def nullify(df: DataFrame, words: list[str] = MISSING) -> DataFrame:
    """String columns with null for words that count as missing."""
    return df.select(*(F.when(~F.col(c).isin(words), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def in_order(df: DataFrame) -> DataFrame:
    """df, just read from files, with file__, block__ and at__: where a row stands; a file's blocks and the rows of a
    block are in order, whatever tasks read them."""
    return df.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.file_block_start").alias("block__"), F.monotonically_increasing_id().alias("at__"))


PLACE = ("file__", "block__", "at__")


def numbered(df: DataFrame) -> DataFrame:
    """df, just read from files, with line: its rows counted from 1 over all files in order.

    Only the blocks of files are brought in order, not rows: each block's rows are counted by themselves."""
    rows = in_order(df)
    blocks = rows.groupBy("file__", "block__").agg(F.count("*").alias("n"), F.min("at__").alias("first__"))
    before = F.sum("n").over(Window.orderBy("file__", "block__").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file__", "block__", "first__", F.coalesce(before, F.lit(0)).alias("before__"))
    out = rows.join(blocks, ["file__", "block__"])
    return out.select(*df.columns, (F.col("before__") + F.col("at__") - F.col("first__") + 1).alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): raw lines, numbered from 1; quotes are ordinary characters."""
    return numbered(spark.read.text(path)).select("line", "value")


def read_records(spark: SparkSession, path: str, missing: bool = True, sep: str = "\t", line_breaks: bool = False, head: int | None = None) -> DataFrame:
    """Records of delimited files with a header, columns that are not there as null. line_breaks: quoted fields may
    hold line breaks; each file is then read by one task. head: only the first so many records in the files' order."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=line_breaks)
    if head is not None:
        # tasks cut their own rows first, so no more than head rows of a task are brought in order
        df = in_order(df).orderBy(*PLACE).limit(head)
    df = df.select(*(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("entity_id", "business_name", "business_address", "country")))
    return nullify(df) if missing else df


def parse_ids(c: Column | str) -> Column:
    """The trimmed pieces of a comma list without empty ones; null, blank and nan give none."""
    c = F.col(c) if isinstance(c, str) else c
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("", "nan"), none).otherwise(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def ground_truth(rows: DataFrame, *order: str) -> DataFrame:
    """(s1_id, matches) of rows source1_entity_id, matched_entity_ids; of repeated ids the last by order stays."""
    last = rows.groupBy(F.col("source1_entity_id").alias("s1_id")).agg(F.max(F.struct(*order, F.coalesce("matched_entity_ids", F.lit("")).alias("ids"))).alias("last"))
    return last.select("s1_id", parse_ids("last.ids").alias("matches"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(in_order(spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')), *PLACE)


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def pairs_of(lists: DataFrame, list_col: str = "matches") -> DataFrame:
    """(s1_id, candidate_id), a row for each distinct member of a list."""
    return lists.select("s1_id", F.explode(F.array_distinct(list_col)).alias("candidate_id"))


def read_candidates(spark: SparkSession, *paths: str) -> DataFrame:
    """(s1_id, candidate_id, rank) of the first of paths that is there: one JSON object of lists."""
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        return text.select(F.explode(F.from_json("value", "map<string,array<string>>"))).select(F.col("key").alias("s1_id"), F.posexplode("value").alias("at", "candidate_id")).select("s1_id", "candidate_id", (F.col("at") + 1).alias("rank"))
    raise FileNotFoundError(f"none of {paths}")


def read_progress(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(s1_id, candidates) of JSON lines, the last of repeated ids; bad lines are passed over, or raise if strict."""
    rows = in_order(spark.read.json(path, "s1_id string, candidates array<string>", mode="FAILFAST" if strict else "DROPMALFORMED"))
    return rows.where("s1_id is not null").groupBy("s1_id").agg(F.max_by("candidates", F.struct(*PLACE)).alias("candidates"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, split) of a file .json with one object of train_s1_ids and val_s1_ids, else of Parquet with these columns."""
    if not path.rstrip("/").endswith(".json"):
        return spark.read.schema("s1_id string, split string").parquet(path).where("s1_id is not null")
    one = spark.read.schema("train_s1_ids array<string>, val_s1_ids array<string>").json(path, multiLine=True)
    return one.select(F.explode("train_s1_ids").alias("s1_id"), F.lit("train").alias("split")).union(one.select(F.explode("val_s1_ids"), F.lit("val")))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A table separated by tabs (.tsv) or commas; without an entity_id header, its first column is that."""
    sep = "\t" if path.endswith(".tsv") else ","
    df = spark.read.csv(path, sep=sep, header=True)
    if "entity_id" in df.columns:
        return df
    df = spark.read.csv(path, sep=sep, header=False)
    return df.withColumnRenamed(df.columns[0], "entity_id")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the trimmed first fields of a file's lines, without its header and blank lines."""
    lines = read_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != ""))
    return lines.select(F.trim(F.substring_index("value", "\t", 1)).alias("id")).distinct()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matches); a file that is not there has no predictions."""
    try:
        return read_ground_truth(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "s1_id string, matches array<string>")
