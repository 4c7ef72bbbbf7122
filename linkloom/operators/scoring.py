"""The cheap similarity of pairs, and the best candidates of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .blocking import normalized

WEIGHTS = (0.45, 0.35, 0.20)


def profiles(records: DataFrame, min_len: int = 2, suffixes: bool = True) -> DataFrame:
    """(entity_id, nt, ng, at): distinct name tokens, name trigrams and address tokens, once a record, as hashes."""
    n = normalized(records, suffixes)
    return n.select("entity_id", text.hashed(text.tokens("norm_name", min_len)).alias("nt"), text.hashed(text.char_ngrams("norm_name")).alias("ng"), text.hashed(text.tokens("norm_addr", min_len)).alias("at"))


def cheap_score(a: str, b: str, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted Jaccard of the profiles whose columns are prefixed a and b."""
    j = [text.jaccard(f"{a}{c}", f"{b}{c}") for c in ("nt", "ng", "at")]
    return F.lit(weights[0]) * j[0] + F.lit(weights[1]) * j[1] + F.lit(weights[2]) * j[2]


def with_profiles(pairs: DataFrame, s1: DataFrame, candidates: DataFrame, min_len: int = 2, suffixes: bool = True) -> DataFrame:
    """pairs with both profiles (columns p_ and q_); pairs of unknown records go."""
    p, q = profiles(s1, min_len, suffixes), profiles(candidates, min_len, suffixes)
    p = p.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"p_{c}") for c in ("nt", "ng", "at")))
    q = q.select(F.col("entity_id").alias("candidate_id"), *(F.col(c).alias(f"q_{c}") for c in ("nt", "ng", "at")))
    return pairs.join(p, "s1_id").join(q, "candidate_id")


def score_pairs(pairs: DataFrame, s1: DataFrame, candidates: DataFrame, min_len: int = 2, weights: tuple[float, float, float] = WEIGHTS, suffixes: bool = True) -> DataFrame:
    """pairs with score, and overlap: common name tokens."""
    out = with_profiles(pairs, s1, candidates, min_len, suffixes)
    return out.select(*(out[c] for c in pairs.columns), cheap_score("p_", "q_", weights).alias("score"), text.overlap("p_nt", "q_nt").alias("overlap"))


def ranked(scored: DataFrame, by: str = "score") -> DataFrame:
    """scored with rank: the place of each pair among those of its s1_id by the values of by, ties by candidate_id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col(by).desc(), F.col("candidate_id"))))


def best(scored: DataFrame, k: int, by: str = "score", floor: float | None = None) -> DataFrame:
    """The k pairs of each s1_id with the highest values of by, with their rank; ties by candidate_id.

    A rank filter over this window is planned as a per-task limit first, so a record's pairs are cut before the shuffle."""
    if floor is not None:
        scored = scored.where(F.col(by) >= floor)
    return ranked(scored, by).where(F.col("rank") <= k)


def prune(pairs: DataFrame, s1: DataFrame, candidates: DataFrame, top_k: int = 30, min_score: float = 0.0, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """(s1_id, candidate_id, score, rank) of the best pairs."""
    return best(score_pairs(pairs.select("s1_id", "candidate_id"), s1, candidates, 2, weights), top_k, floor=min_score).select("s1_id", "candidate_id", "score", "rank")


def nested(ranked: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(s1_id, candidates): ids in rank order; with ids, records without candidates have an empty list."""
    out = ranked.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x["candidate_id"]).alias("candidates"))
    if ids is not None:
        out = ids.select("s1_id").distinct().join(out, "s1_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out
