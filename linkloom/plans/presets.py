"""The three configurations of blocking, and whole runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, scoring


@dataclass(frozen=True)
class Preset:
    """min_len: of tokens in the score; None: no score. prefilter: pairs a record may have before they are scored."""

    name: str
    strategies: list[blocking.Strategy] = field(default_factory=list)
    min_len: int | None = 2
    suffixes: bool = True
    prefilter: int | None = None
    top_k: int = 30


def analysis() -> Preset:
    return Preset("analysis", [blocking.name_tokens(), blocking.name_lsh(), blocking.address_tokens()], None)


def fused() -> Preset:
    return Preset("fused", [blocking.name_tokens(floor=100), blocking.name_lsh(num_hashes=20, num_bands=5, cap=2000), blocking.address_tokens(min_len=2, ratio=0.01, floor=100)])


def full_scale(max_bucket: int = 1000) -> Preset:
    return Preset("full_scale", [blocking.name_tokens(cap=max_bucket), blocking.name_trigrams(cap=max_bucket), blocking.address_tokens(cap=max_bucket)], 3, True, 300, 50)


def run_preset(s1: DataFrame, candidates: DataFrame, preset: Preset, top_k: int | None = None, min_score: float | None = None) -> DataFrame:
    """(s1_id, candidate_id, score, rank): blocks, drops pairs whose countries clash, scores and keeps the best."""
    pairs = blocking.candidate_pairs(s1, candidates, preset.strategies, preset.suffixes).select("s1_id", "candidate_id")
    scored = scoring.score_pairs(pairs, s1, candidates, preset.min_len or 2, suffixes=preset.suffixes)
    if preset.prefilter:
        scored = scoring.best(scored, preset.prefilter, by="overlap").drop("rank")
    return scoring.best(scored, top_k or preset.top_k, floor=min_score).select("s1_id", "candidate_id", "score", F.col("rank"))
