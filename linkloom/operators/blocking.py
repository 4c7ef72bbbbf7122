"""Candidate pairs by shared keys.

Every strategy turns a record into keys. Keys that too many candidate records have are dropped before the join, so a
reference record has at most `cap` pairs by a key. A key that very many reference records have is dealt in parts of
PART of them, each with a copy of its candidates: a task holds at most PART times cap pairs of a key. One aggregation
over both sides counts keys; all strategies go through one join, and keys of one side alone are dropped before it.
Pairs are made distinct with the strategies that found them as bits, before anything wide is attached."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minhash, text


#: Reference records that share a key within a task.
PART = 20_000


@dataclass(frozen=True)
class Strategy:
    """bit: position in a pair's mask. keys: of a row with norm_name, norm_addr. ratio and floor: a key in more than
    max(int(N ratio), floor) of N candidate records is a stop key; None: no stop list. cap: largest bucket."""

    name: str
    bit: int
    keys: Callable[[], Column]
    cap: int
    ratio: float | None = None
    floor: int = 0


def name_tokens(bit: int = 0, min_len: int = 3, ratio: float = 0.005, floor: int = 500, cap: int = 500) -> Strategy:
    return Strategy("name_tokens", bit, lambda: text.tokens("norm_name", min_len), cap, ratio, floor)


def address_tokens(bit: int = 2, min_len: int = 3, ratio: float = 0.003, floor: int = 500, cap: int = 500) -> Strategy:
    return Strategy("addr_tokens", bit, lambda: text.tokens("norm_addr", min_len), cap, ratio, floor)


def name_lsh(bit: int = 1, num_hashes: int = 16, num_bands: int = 8, n: int = 3, cap: int = 500) -> Strategy:
    def keys() -> Column:
        # a null signature (no n-grams) gives no key
        return F.get(F.transform(F.array(minhash.signature(text.char_ngrams("norm_name", n), num_hashes)), lambda s: F.when(s.isNull(), F.array().cast("array<string>")).otherwise(minhash.bands(s, num_hashes, num_bands))), F.lit(0))

    return Strategy(f"lsh_{num_hashes}x{num_bands}", bit, keys, cap)


def name_trigrams(bit: int = 1, n: int = 3, cap: int = 1000) -> Strategy:
    return Strategy("name_trigrams", bit, lambda: text.char_ngrams("norm_name", n), cap)


def normalized(records: DataFrame, suffixes: bool = True) -> DataFrame:
    """entity_id, norm_name, norm_addr, country of records."""
    name = text.normalize_name("business_name") if suffixes else text.normalize_text("business_name")
    return records.select("entity_id", name.alias("norm_name"), text.normalize_text("business_address").alias("norm_addr"), text.normalize_country("country").alias("country"))


def keyed(norm: DataFrame, strategies: list[Strategy], *more: str) -> DataFrame:
    """(entity_id, country, more, strategy, key), each key of a record once; one row for each, from one pass."""
    each = F.flatten(F.array(*map(_tagged, strategies)))
    return norm.select("entity_id", "country", *more, F.explode(each).alias("k")).select("entity_id", "country", *more, "k.strategy", "k.key")


def _tagged(s: Strategy) -> Column:
    return F.transform(F.array_distinct(s.keys()), lambda k: F.struct(F.lit(s.bit).alias("strategy"), k.alias("key")))


def limit_of(s: Strategy, total: Column) -> Column:
    """Records a key may have at most: the stop list and the bucket cap in one number."""
    if s.ratio is None:
        return F.lit(s.cap).cast("long")
    return F.least(F.lit(s.cap).cast("long"), F.greatest(F.floor(total * F.lit(s.ratio)).cast("long"), F.lit(s.floor).cast("long")))


def key_stats(right: DataFrame, norm: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """(strategy, key, df, kept): in how many candidate records each key is, and whether that is within limits."""
    total = norm.agg(F.count("*").cast("double").alias("n")).scalar()
    out = right.groupBy("strategy", "key").agg(F.count("*").alias("df")).withColumn("total", total)
    return out.withColumn("kept", F.col("df") <= _limit(strategies)).drop("total")


def _limit(strategies: list[Strategy]) -> Column:
    """The limit of a row's strategy, total being the number of candidate records."""
    return F.coalesce(*(F.when(F.col("strategy") == s.bit, limit_of(s, F.col("total"))) for s in strategies))


def document_frequency(norm: DataFrame, keys: Column) -> DataFrame:
    """(token, df) over all records."""
    return norm.select(F.explode(F.array_distinct(keys)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def stoplist(norm: DataFrame, keys: Column, ratio: float = 0.01, min_count: int = 500, total: int | None = None) -> DataFrame:
    """(token, df) of tokens in more than max(int(N ratio), min_count) records."""
    n = F.lit(float(total)) if total is not None else norm.agg(F.count("*").cast("double").alias("n")).scalar()
    out = document_frequency(norm, keys).withColumn("n", n)
    return out.where(F.col("df") > F.greatest(F.floor(F.col("n") * ratio), F.lit(min_count))).drop("n")


def compatible(a: Column | str, b: Column | str) -> Column:
    """Countries clash only if both are known and differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (a == "") | (b == "") | (a == b)


def candidate_pairs(s1: DataFrame, candidates: DataFrame, strategies: list[Strategy], suffixes: bool = True, by_country: bool = True) -> DataFrame:
    """(s1_id, candidate_id, strategies) of records that share a kept key; strategies has the bits that found a pair."""
    sides = [normalized(x, suffixes).withColumn("ref", F.lit(ref)) for x, ref in ((s1, True), (candidates, False))]
    total = sides[1].agg(F.count("*").cast("double").alias("n")).scalar()
    known = keyed(sides[0].union(sides[1]), strategies, "ref").groupBy("strategy", "key").agg(F.count_if("ref").alias("refs"), F.count_if(~F.col("ref")).alias("df"))
    known = known.where("refs > 0 and df > 0").withColumn("total", total)
    known = known.where(F.col("df") <= _limit(strategies)).select("strategy", "key", F.ceil(F.col("refs") / PART).cast("int").alias("parts"))
    left, right = (keyed(x, strategies).join(known, ["strategy", "key"]) for x in sides)
    left = left.select("strategy", "key", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int").alias("part"), F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"))
    right = right.select("strategy", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("entity_id").alias("candidate_id"), F.col("country").alias("candidate_country"))
    pairs = left.join(right, ["strategy", "key", "part"])
    if by_country:
        pairs = pairs.where(compatible("s1_country", "candidate_country"))
    return pairs.groupBy("s1_id", "candidate_id").agg(F.bit_or(F.expr("shiftleft(1, strategy)")).cast("int").alias("strategies"))


def combine(*blocks: DataFrame) -> DataFrame:
    """The distinct pairs of blocks."""
    out = blocks[0].select("s1_id", "candidate_id")
    for b in blocks[1:]:
        out = out.union(b.select("s1_id", "candidate_id"))
    return out.distinct()


def filter_by_country(pairs: DataFrame, s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs whose countries don't clash; records that are not there have no country."""
    a = s1.select(F.col("entity_id").alias("s1_id"), text.normalize_country("country").alias("c1__"))
    b = candidates.select(F.col("entity_id").alias("candidate_id"), text.normalize_country("country").alias("c2__"))
    out = pairs.join(a, "s1_id", "left").join(b, "candidate_id", "left")
    return out.where(compatible(F.coalesce("c1__", F.lit("")), F.coalesce("c2__", F.lit("")))).select(*pairs.columns)
