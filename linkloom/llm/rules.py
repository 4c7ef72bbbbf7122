"""Quality rules with cross-document line frequency, by DataFrame functions only.

A line is normalised (case, white space, digits) and hashed; per host it is counted in how many different texts it
stands, so exact copies of a document count once. Lines above the limit are removed, and a document of which too
little is left is rejected. The limit is a count, so that a host's size doesn't matter. Rules on single documents stand beside that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words, as the characters and for regular expressions.
WHITE, WHITE_RE = " \t\n\x0b\f\r", "[\\x20\\x09-\\x0D]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RE))


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once for all lambdas inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorted hashes show repeats as neighbours, sorted places then
    give the union of windows."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _bind(by_hash, lambda s: F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False)))))
    places = F.array_sort(F.transform(F.filter(twice, lambda e: e.isNotNull()), lambda e: e["i"]))
    width = F.lit(WINDOW).cast("long")
    return _bind(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(width, F.get(p, j + 1) - x), width)), F.lit(0).cast("long"), lambda a, b: a + b))


def base_rules(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """The columns keep of docs, which has a non-null column text, and the counts of the single-document rules."""
    out = docs.select(*keep, "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "").alias("lines"))
    n = F.size("w")
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("windows", _bind(hashes, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))))
    cols = [c for c in out.columns if c not in ("text", "w", "lines", "windows")]
    out = out.select(
        *cols,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows"))).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """Of the normalised line: lower case, digits as one, words parted by one space. Always odd."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.trim(F.lower(line), F.lit(WHITE)), WHITE_RE, " "), "[0-9]+", "0")).bitwiseOR(1)


def _lines(docs: DataFrame) -> DataFrame:
    """(host, doc, line, w): words of each line of each text of a host, copies and repeats added up; and for each text
    a row with the number of its copies as w and an even number of its own as line, where hashes of lines are odd, so
    that no line is common to all texts of a host. No column may be null: a null would be filtered in one use of these
    rows and not in the other, and they would be made twice."""
    some = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    rows = docs.select("host", F.md5("text").alias("doc"), F.explode(F.concat(some, F.array(F.lit(None).cast("string")))).alias("x"))
    there = F.col("x").isNotNull()
    words = F.when(there, F.size(F.split(F.trim("x", F.lit(WHITE)), WHITE_RE))).otherwise(1)
    return rows.select("host", "doc", F.when(there, line_hash(F.col("x"))).otherwise(F.xxhash64("doc").bitwiseAND(F.lit(-2))).alias("line"), words.alias("w")).groupBy("host", "doc", "line").agg(F.sum("w").alias("w"))


def _is_line() -> Column:
    return F.col("line").bitwiseAND(F.lit(1)) == 1


def _frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    # count("w"), not count("*"): the lines' shuffle is then the same one as that of _removed and runs once
    return lines.groupBy("host", "line").agg(F.count("w").alias("n_docs")).where(F.col("n_docs") > min_docs)


def frequent_lines(docs: DataFrame, min_docs: int = 20) -> DataFrame:
    """(host, line, n_docs) of lines in more than min_docs different texts of a host, however many texts it has.

    docs: host, text."""
    return _frequent(_lines(docs), min_docs).where(_is_line())


def _removed(slim: DataFrame, min_docs: int, *more: Column) -> DataFrame:
    """(host, doc, removed): words in lines above the limit of the texts that have some, and the aggregates more over
    the hashes of these lines."""
    lines = _lines(slim)
    marked = lines.join(_frequent(lines, min_docs), ["host", "line"], "left").where(F.col("n_docs").isNotNull() | ~_is_line())
    line, copies = _is_line(), F.sum(F.when(~_is_line(), F.col("w")))
    marked = marked.groupBy("host", "doc").agg(F.sum(F.when(line, F.col("w"))).alias("all_copies"), copies.alias("copies"), *more).where("all_copies > 0")
    return marked.withColumn("removed", F.expr("all_copies div copies")).drop("all_copies", "copies")


def _slim(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))


def _verdict(out: DataFrame, depleted: float) -> DataFrame:
    """removed_share and kept, from n_words, base_failed and removed."""
    out = out.withColumn("removed_share", F.coalesce(F.col("removed") / F.col("n_words"), F.lit(0.0))).drop("removed")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_share") < depleted))


def apply_rules(docs: DataFrame, min_docs: int = 20, depleted: float = 0.8, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_share), a row
    for each of docs, the id under its own name.

    kept: the base rules hold, and lines above the limit have less than the share `depleted` of the words. A null text
    is an empty one, a null host a host of its own. Equal texts of a host have equal results; null ids and repeats are
    rows like others, further columns are ignored."""
    slim = _slim(docs, id_col, text_col, host_col)
    base = base_rules(slim, "doc_id", "host", F.md5("text").alias("doc"))
    out = _verdict(base.join(_removed(slim, min_docs), ["host", "doc"], "left"), depleted)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_share"]
    return out.select(F.col("doc_id").alias(id_col), *cols)


def _rows(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(row, text, host): rows as structs, so that no column of docs can clash with those added here."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))


def _gone(rows: DataFrame, min_docs: int) -> DataFrame:
    """(host, doc, removed, gone): of texts with lines above the limit, the words in these and their hashes."""
    return _removed(rows.select("text", "host"), min_docs, F.collect_set(F.when(_is_line(), F.col("line"))).alias("gone"))


def _without(marked: DataFrame, text_col: str) -> DataFrame:
    """The rows of marked (row, gone) without their lines in gone."""
    text = F.col("row")[text_col]
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("gone"), line_hash(x)) | (F.trim(x, F.lit(WHITE)) == "")), "\n")
    return marked.select(F.col("row").withField(text_col, F.when(F.col("gone").isNull(), text).otherwise(left)).alias("row")).select("row.*")


def remove_frequent_lines(docs: DataFrame, min_docs: int = 20, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with lines above the limit taken out of text_col; null texts stay null, all other columns as they are."""
    rows = _rows(docs, text_col, host_col)
    return _without(rows.select("row", "host", F.md5("text").alias("doc")).join(_gone(rows, min_docs), ["host", "doc"], "left"), text_col)


def clean(docs: DataFrame, min_docs: int = 20, depleted: float = 0.8, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that apply_rules keeps, without their lines above the limit; each row has its own verdict,
    whatever its id. All other columns stay as they are; a null text has no words and goes."""
    rows = _rows(docs, text_col, host_col)
    base = base_rules(rows, "row", "host", F.md5("text").alias("doc")).select("row", "host", "doc", "n_words", "base_failed")
    # a column that isn't deterministic, and is used, keeps the filter here: pushed below, it would compute the rules anew
    base = base.withColumn("at", F.monotonically_increasing_id()).where(~F.col("base_failed") & (F.col("at") >= 0))
    kept = _verdict(base.join(_gone(rows, min_docs), ["host", "doc"], "left"), depleted).where("kept")
    return _without(kept, text_col)
