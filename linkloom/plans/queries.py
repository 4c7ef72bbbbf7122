"""The registered queries over the entity fixture, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash, text
from ..operators import blocking, evaluation, features, model, scoring, splitting, validation
from ..sources import readers, writers
from ..streaming import resume
from . import fixtures, presets

BITS = {"name_tokens": 0, "lsh": 1, "addr_tokens": 2}
_LIMITS = {0: (500, 0.005, 500), 1: (500, None, 0), 2: (500, 0.003, 500)}
#: Small limits, so that stop lists and bucket caps bind on small tables: only the queries on these use them.
SMALL = [blocking.name_tokens(ratio=0.01, floor=20, cap=50), blocking.name_lsh(cap=50), blocking.address_tokens(ratio=0.01, floor=20, cap=50)]
_SMALL_LIMITS = {0: (50, 0.01, 20), 1: (50, None, 0), 2: (50, 0.01, 20)}
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _counts(sql: str) -> str:
    """count_if(x) as count(*) filter (where x), which is a bigint."""
    while (a := sql.find("count_if(")) >= 0:
        b, depth = a + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = f"{sql[:a]}count(*) filter (where {sql[a + len('count_if(') : b - 1]}){sql[b:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _counts(sql)
        return f

    return add


# ---- SQL -----------------------------------------------------------------------------------------------------------

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_norm = lambda c: f"translate(lower(coalesce({c}, '')), '{fixtures.DUCK_PUNCTUATION}', repeat(' ', 32))"
_split = lambda c, n: rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: length(x) >= {n})"
_grams = lambda c: f"(case when length({c}) = 0 then []::varchar[] when length({c}) < 3 then [{c}] else list_transform(range(1, length({c}) - 1), lambda i: substring({c}, i, 3)) end)"
_bare = lambda c: rf"regexp_replace({c}, '\s+', '', 'g')"
_BASE = rf"""with {fixtures.SQL},
  nrm as (select entity_id, business_name, business_address, h, lower(trim(coalesce(country, ''))) as nc, {_norm('business_name')} as tn, {_norm('business_address')} as na,
    array_to_string(list_filter(regexp_split_to_array({_norm('business_name')}, '\s+'), lambda x: x <> '' and not list_contains({_list(text.SUFFIXES)}, x)), ' ') as nn from ent),
  s1 as (select * from nrm where entity_id like 'S1-%'), cd as (select * from nrm where entity_id not like 'S1-%'),
  gt as (select s1.entity_id as s1_id, cd.entity_id as candidate_id from s1 join cd using (h))"""


@cache
def _crc_table() -> str:
    def entry(n: int) -> int:
        for _ in range(8):
            n = 0xEDB88320 ^ n >> 1 if n & 1 else n >> 1
        return n

    return "[" + ", ".join(f"{entry(n)}::bigint" for n in range(256)) + "]"


def _signatures(num: int) -> str:
    """CTEs gr, crc and sg: (entity_id, m1 ... of the signature)."""
    a, b = minhash.FAMILIES[num]
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: ('0x' || x)::bigint)), lambda p, q: xor(list_extract({_crc_table()}, (xor(p, q) & 255) + 1), (p >> 8))), 4294967295::bigint) & 2147483647"
    mins = ", ".join(f"min((c * {x} + {y}) % {minhash.PRIME}) as m{k}" for k, (x, y) in enumerate(zip(a, b)))
    return f"gr as (select entity_id, unnest(list_distinct({_grams(_bare('nn'))})) as g from nrm), crc as (select g, {crc} as c from (select distinct g from gr)), sg as (select entity_id, {mins} from gr join crc using (g) group by entity_id)"


def _key_sql(strategy: int, kind: str, arg) -> str:
    if kind == "lsh":
        num, bands = arg
        r = num // bands
        keys = ", ".join(f"'{k}:' || " + " || '-' || ".join(f"m{k * r + j}" for j in range(r)) for k in range(bands))
        return f"select entity_id, nc, {strategy} as strategy, unnest([{keys}]) as key from nrm join sg using (entity_id)"
    what = {"name": _split("nn", arg), "addr": _split("na", arg), "tri": _grams(_bare("nn"))}[kind]
    return f"select entity_id, nc, {strategy} as strategy, unnest(list_distinct({what})) as key from nrm"


def _pairs_sql(spec: list[tuple[int, str, object]], limits: dict, country: bool = True) -> str:
    """CTEs up to pairs (s1_id, candidate_id, strategies)."""
    sig = next((a for _, k, a in spec if k == "lsh"), None)
    limit = " ".join(f"when {s} then " + (f"{cap}" if ratio is None else f"least({cap}, greatest(floor(n * {ratio}::double)::bigint, {floor}))") for s, (cap, ratio, floor) in limits.items())
    parts = [_signatures(sig[0])] if sig else []
    parts += [
        "ky as (" + " union all ".join(_key_sql(*x) for x in spec) + ")",
        "st as (select strategy, key, count(*) as df from ky where entity_id not like 'S1-%' group by strategy, key)",
        f"lim as (select strategy, key, df, df <= case strategy {limit} end as kept from st, (select count(*) as n from cd))",
        "pairs as (select l.entity_id as s1_id, r.entity_id as candidate_id, bit_or(1 << l.strategy)::int as strategies from ky l join ky r on l.strategy = r.strategy and l.key = r.key join lim on lim.strategy = r.strategy and lim.key = r.key and kept"
        " where l.entity_id like 'S1-%' and r.entity_id not like 'S1-%'" + (" and (l.nc = '' or r.nc = '' or l.nc = r.nc)" if country else "") + " group by 1, 2)",
    ]
    return _BASE + ",\n  " + ",\n  ".join(parts)


_SPEC = [(0, "name", 3), (1, "lsh", (16, 8)), (2, "addr", 3)]
_FUSED = ([(0, "name", 3), (1, "lsh", (20, 5)), (2, "addr", 2)], {0: (500, 0.005, 100), 1: (2000, None, 0), 2: (500, 0.01, 100)})
_FULL = ([(0, "name", 3), (1, "tri", None), (2, "addr", 3)], {0: (1000, 0.005, 500), 1: (1000, None, 0), 2: (1000, 0.003, 500)})
_PAIRS = _pairs_sql(_SPEC, _LIMITS)
_FEW = _pairs_sql(_SPEC, _SMALL_LIMITS)


def _j(a: str, b: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    return f"(case when {i} = 0 then 0.0::double else {i}::double / (len({a}) + len({b}) - {i}) end)"


def _score_sql(min_len: int, pairs: str = "pairs") -> str:
    score = f"0.45::double * {_j('p.nt', 'q.nt')} + 0.35::double * {_j('p.ng', 'q.ng')} + 0.2::double * {_j('p.at', 'q.at')}"
    return f"""pf as (select entity_id, list_distinct({_split('nn', min_len)}) as nt, list_distinct({_grams(_bare('nn'))}) as ng, list_distinct({_split('na', min_len)}) as at from nrm),
  sc as (select s1_id, candidate_id, {score} as score, len(list_intersect(p.nt, q.nt)) as overlap from {pairs} x join pf p on p.entity_id = s1_id join pf q on q.entity_id = candidate_id)"""


def _rank(by: str, k: int, src: str = "sc") -> str:
    return f"select *, row_number() over (partition by s1_id order by {by} desc, candidate_id) as rank from {src} qualify rank <= {k}"


_SCORED = _PAIRS + ",\n  " + _score_sql(2)


# ---- fixtures in Spark ---------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(*fixtures.sides(spark, sf_dir), presets.analysis().strategies)


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, candidate_id, prob, label): the cheap score as the probability."""
    s1, cd = fixtures.sides(spark, sf_dir)
    scored = scoring.score_pairs(_pairs(spark, sf_dir).select("s1_id", "candidate_id"), s1, cd)
    label = fixtures.truth(s1, cd).withColumn("label", F.lit(1))
    return scored.join(label, ["s1_id", "candidate_id"], "left").select("s1_id", "candidate_id", F.col("score").alias("prob"), F.coalesce("label", F.lit(0)).alias("label"))


_PROBS = _SCORED + ",\n  pr as (select s1_id, candidate_id, score as prob, case when gt.s1_id is null then 0 else 1 end as label from sc left join gt using (s1_id, candidate_id))"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where Spark runs in one process."""
    if top := spark.sparkContext.getConf().get("spark.checkpoint.dir", ""):
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="stream-")


def _ids(s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id"))


# ---- text ----------------------------------------------------------------------------------------------------------


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.entities(spark, sf_dir).select("entity_id", "business_name", "business_address", "country", text.normalize_name("business_name").alias("norm_name"), text.normalize_text("business_address").alias("norm_addr"))


@query(_BASE + " select entity_id, tn as name_text, na as addr_text from nrm")
def normalize_text(spark, sf_dir):
    return fixtures.entities(spark, sf_dir).select("entity_id", text.normalize_text("business_name").alias("name_text"), text.normalize_text("business_address").alias("addr_text"))


@query(_BASE + " select entity_id, nn as norm_name from nrm")
def normalize_name(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", "norm_name")


@query(_BASE + " select entity_id, nc as norm_country from nrm")
def normalize_country(spark, sf_dir):
    return fixtures.entities(spark, sf_dir).select("entity_id", text.normalize_country("country").alias("norm_country"))


@query(_BASE + f" select entity_id, array_to_string({_split('nn', 2)}, ' ') as tokens from nrm")
def name_tokens(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", F.array_join(text.tokens("norm_name"), " ").alias("tokens"))


@query(_BASE + f" select entity_id, array_to_string({_split('na', 2)}, ' ') as tokens from nrm")
def addr_tokens(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", F.array_join(text.tokens("norm_addr"), " ").alias("tokens"))


@query(_BASE + f" select entity_id, array_to_string({_grams(_bare('nn'))}, '|') as grams from nrm")
def char_trigrams(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", F.array_join(text.char_ngrams("norm_name"), "|").alias("grams"))


@query(_BASE + r" select entity_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(na, '(?i)\b(\d{5,6}|[A-Z]\d[A-Z]\s?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})\b', 1), lambda m: upper(replace(m, ' ', ''))))), ' ') as codes from nrm")
def postal_codes(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", F.array_join(F.array_sort(text.postal_codes("norm_addr")), " ").alias("codes"))


@query(_BASE + r" select entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(na, '\b\d+\b'))), ' ') as numbers from nrm")
def numeric_tokens(spark, sf_dir):
    return _norms(spark, sf_dir).select("entity_id", F.array_join(F.array_sort(text.numeric_tokens("norm_addr")), " ").alias("numbers"))


# ---- blocking ------------------------------------------------------------------------------------------------------

_DF = f"tk as (select unnest(list_distinct({_split('nn', 3)})) as token from cd), df as (select token, count(*) as df from tk group by token)"


@query(_BASE + f", {_DF} select token, df from df")
def token_doc_freq(spark, sf_dir):
    return blocking.document_frequency(blocking.normalized(fixtures.sides(spark, sf_dir)[1]), text.tokens("norm_name", 3))


@query(_BASE + f", {_DF} select token, df from df where df > greatest(floor((select count(*) from cd) * 0.01::double), 20)")
def stoplist(spark, sf_dir):
    return blocking.stoplist(blocking.normalized(fixtures.sides(spark, sf_dir)[1]), text.tokens("norm_name", 3), 0.01, 20)


@query(_FEW + " select strategy, count(*) as keys, count_if(kept) as kept_keys, sum(df)::bigint as rows, coalesce(sum(df) filter (where kept), 0)::bigint as kept_rows, max(df)::bigint as largest from lim group by strategy")
def bucket_prune_stats(spark, sf_dir):
    norm = blocking.normalized(fixtures.sides(spark, sf_dir)[1])
    stats = blocking.key_stats(blocking.keyed(norm, SMALL), norm, SMALL)
    return stats.groupBy("strategy").agg(F.count("*").alias("keys"), F.count_if("kept").alias("kept_keys"), F.sum("df").alias("rows"), F.sum(F.when(F.col("kept"), F.col("df")).otherwise(0)).alias("kept_rows"), F.max("df").alias("largest"))


@query(_BASE + ", " + _signatures(16) + " select entity_id, " + " || ' ' || ".join(f"m{k}" for k in range(16)) + " as signature from sg")
def minhash_signature(spark, sf_dir):
    sig = _norms(spark, sf_dir).select("entity_id", minhash.signature(text.char_ngrams("norm_name"), 16).alias("s")).where("s is not null")
    return sig.select("entity_id", F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("signature"))


def _blocks(spark, sf_dir, strategy, country=False):
    return blocking.candidate_pairs(*fixtures.sides(spark, sf_dir), [strategy], by_country=country).select("s1_id", "candidate_id")


def _block_sql(kind, arg, limit):
    return _pairs_sql([(0, kind, arg)], {0: limit}, False) + " select s1_id, candidate_id from pairs"


@query(_block_sql("lsh", (16, 8), (500, None, 0)))
def block_lsh_16x8(spark, sf_dir):
    return _blocks(spark, sf_dir, blocking.name_lsh(0))


@query(_block_sql("lsh", (20, 5), (2000, None, 0)))
def block_lsh_20x5(spark, sf_dir):
    return _blocks(spark, sf_dir, blocking.name_lsh(0, 20, 5, cap=2000))


@query(_block_sql("name", 3, (500, 0.005, 500)))
def block_name_tokens(spark, sf_dir):
    return _blocks(spark, sf_dir, blocking.name_tokens(0))


@query(_block_sql("addr", 3, (500, 0.003, 500)))
def block_addr_tokens(spark, sf_dir):
    return _blocks(spark, sf_dir, blocking.address_tokens(0))


@query(_block_sql("tri", None, (1000, None, 0)))
def block_trigrams(spark, sf_dir):
    return _blocks(spark, sf_dir, blocking.name_trigrams(0))


@query(_PAIRS + " select s1_id, candidate_id, strategies from pairs")
def combine_country(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(_FEW + " select s1_id, candidate_id, strategies from pairs")
def combine_small_limits(spark, sf_dir):
    return blocking.candidate_pairs(*fixtures.sides(spark, sf_dir), SMALL)


@query(_pairs_sql(_SPEC, _LIMITS, False) + " select count(*) as before, count_if(a.nc = '' or b.nc = '' or a.nc = b.nc) as after from pairs join s1 a on a.entity_id = s1_id join cd b on b.entity_id = candidate_id")
def country_filter_counts(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    pairs = blocking.combine(blocking.candidate_pairs(s1, cd, presets.analysis().strategies, by_country=False))
    kept = blocking.filter_by_country(pairs, s1, cd).withColumn("kept", F.lit(1))
    return pairs.join(kept, ["s1_id", "candidate_id"], "left").agg(F.count("*").alias("before"), F.count("kept").alias("after"))


_ABLATE = "union all ".join(f"select '{n}' as strategy, count_if(s & {1 << b} > 0) / count(*)::double as recall_alone, count_if(s > 0) / count(*)::double - count_if(s & {7 ^ 1 << b} > 0) / count(*)::double as recall_drop from f " for n, b in BITS.items())


@query(_PAIRS + ", f as (select coalesce(strategies, 0) as s from gt left join pairs using (s1_id, candidate_id)) " + _ABLATE)
def strategy_ablation(spark, sf_dir):
    return evaluation.ablation(_pairs(spark, sf_dir), fixtures.truth(*fixtures.sides(spark, sf_dir)), BITS)


_HITS = """
  ea as (select s1_id, count(*) as a from gt group by 1), ec as (select s1_id, count(*) as c from {pairs} group by 1),
  eh as (select s1_id, count(*) as hits from gt join {pairs} using (s1_id, candidate_id) group by 1),
  e as (select entity_id as s1_id, coalesce(a, 0) as a, coalesce(c, 0) as c, coalesce(eh.hits, 0) as h from s1 left join ea on ea.s1_id = entity_id left join ec on ec.s1_id = entity_id left join eh on eh.s1_id = entity_id)"""


@query(_PAIRS + "," + _HITS.format(pairs="pairs") + """ select sum(h) / sum(a)::double as candidate_recall, round(avg(h / a::double) filter (where a > 0), 9) as macro_candidate_recall, sum(a)::bigint as total_true_matches, sum(h)::bigint as total_hits,
  sum(c)::bigint as total_candidate_pairs, round(avg(c), 9) as avg_candidates_per_s1, median(c)::double as median_candidates_per_s1, max(c)::bigint as max_candidates_per_s1 from e""")
def candidate_recall(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    out = evaluation.candidate_recall(_pairs(spark, sf_dir), _ids(s1), fixtures.truth(s1, cd))
    return out.withColumn("macro_candidate_recall", F.round("macro_candidate_recall", 9)).withColumn("avg_candidates_per_s1", F.round("avg_candidates_per_s1", 9))


# ---- scores and pruning --------------------------------------------------------------------------------------------


@query(_SCORED + " select s1_id, candidate_id, score, overlap from sc")
def cheap_score(spark, sf_dir):
    return scoring.score_pairs(_pairs(spark, sf_dir).select("s1_id", "candidate_id"), *fixtures.sides(spark, sf_dir))


@query(_SCORED + f" select s1_id, candidate_id, score, rank from ({_rank('score', 30, '(select * from sc where score >= 0.1::double)')})")
def topk_prune(spark, sf_dir):
    return scoring.prune(_pairs(spark, sf_dir), *fixtures.sides(spark, sf_dir), top_k=30, min_score=0.1)


@query(_SCORED + f" select entity_id as s1_id, coalesce(string_agg(candidate_id, ' ' order by rank), '') as candidates from s1 left join ({_rank('score', 5)}) on s1_id = entity_id group by 1")
def pruned_lists(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    lists = scoring.nested(scoring.prune(_pairs(spark, sf_dir), s1, cd, top_k=5), _ids(s1))
    return lists.select("s1_id", F.array_join("candidates", " ").alias("candidates"))


@query(_pairs_sql(*_FUSED) + ", " + _score_sql(2) + f" select s1_id, candidate_id, score, rank from ({_rank('score', 30)})")
def fused_topk(spark, sf_dir):
    return presets.run_preset(*fixtures.sides(spark, sf_dir), presets.fused())


_PRE = _pairs_sql(*_FULL) + ", " + _score_sql(3) + f", pre as ({_rank('overlap', 300)})"


@query(_PRE + f" select s1_id, candidate_id, score, rank from ({_rank('score', 50, '(select s1_id, candidate_id, score from pre)')})")
def full_scale_topk(spark, sf_dir):
    return presets.run_preset(*fixtures.sides(spark, sf_dir), presets.full_scale())


@query(_SCORED + f" select s1_id, candidate_id, overlap, rank from ({_rank('overlap', 20)})")
def prefilter_overlap(spark, sf_dir):
    scored = scoring.score_pairs(_pairs(spark, sf_dir).select("s1_id", "candidate_id"), *fixtures.sides(spark, sf_dir))
    return scoring.best(scored, 20, "overlap").select("s1_id", "candidate_id", "overlap", "rank")


def _impact(levels, with_k: bool) -> str:
    ks = ", ".join(map(str, levels))
    return _SCORED + f""", rk as (select *, row_number() over (partition by s1_id order by score desc, candidate_id) as rank from sc),
  m as (select rk.*, gt.s1_id is not null as t from rk left join gt using (s1_id, candidate_id)),
  o as (select k as top_k, count(*) as pb, count_if(rank <= k) as pa, count_if(t) as hb, count_if(t and rank <= k) as ha, count(distinct s1_id) as n from m, (select unnest([{ks}]) as k) group by k),
  g as (select count(*) as g from gt where s1_id in (select s1_id from pairs))
  select {'top_k, ' if with_k else ''}hb / g::double as recall_before, ha / g::double as recall_after, hb / g::double - ha / g::double as recall_loss, (ha / g::double) / (hb / g::double) * 100 as recall_retention_pct, hb as hits_before, ha as hits_after, g as total_ground_truth_pairs,
  pb as pairs_before, pa as pairs_after, pb / n::double as avg_cands_before, pa / n::double as avg_cands_after, pb / pa::double as reduction_ratio, (pb - pa) / pb::double * 100 as volume_reduction_pct from o, g"""


def _impacts(spark, sf_dir, levels):
    """All pairs are ranked once; what pruning keeps at any k is read from the ranks."""
    s1, cd = fixtures.sides(spark, sf_dir)
    scored = scoring.score_pairs(_pairs(spark, sf_dir).select("s1_id", "candidate_id"), s1, cd)
    return evaluation.rank_impact(scoring.ranked(scored), fixtures.truth(s1, cd), levels)


@query(_impact((5,), False))
def prune_impact(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    return evaluation.prune_impact(pairs, scoring.prune(pairs, s1, cd, top_k=5), fixtures.truth(s1, cd))


@query(_impact((1, 2, 5, *evaluation.PRUNE_LEVELS), True))
def topk_sweep(spark, sf_dir):
    return _impacts(spark, sf_dir, (1, 2, 5, *evaluation.PRUNE_LEVELS))


# ---- features ------------------------------------------------------------------------------------------------------

# DuckDB's levenshtein counts bytes: letters beyond ASCII become capitals, which normalised text has none of
_ONE = lambda c: f"translate({c}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_lev = lambda a, b: f"(case when greatest(length({a}), length({b})) = 0 then 1.0::double when least(length({a}), length({b})) = 0 then 0.0::double else 1 - levenshtein({_ONE(a)}, {_ONE(b)}) / greatest(length({a}), length({b}))::double end)"
_len = lambda a, b: f"(case when greatest(length({a}), length({b})) = 0 then 0.0::double else least(length({a}), length({b})) / greatest(length({a}), length({b}))::double end)"
_int = lambda c: f"coalesce({c}, false)::int"
_both = lambda a, b: f"len(list_intersect({a}, {b}))"
_POSTAL = r"list_distinct(list_transform(regexp_extract_all(na, '(?i)\b(\d{5,6}|[A-Z]\d[A-Z]\s?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})\b', 1), lambda m: upper(replace(m, ' ', ''))))"
_MATRIX = _SCORED + rf""", fp as (select entity_id, nn, na, nc, trim(coalesce(business_name, '')) = '' as no_name, trim(coalesce(business_address, '')) = '' as no_addr, list_distinct({_split('nn', 2)}) as nt, {_split('nn', 2)}[1] as f1,
    list_distinct({_grams(_bare('nn'))}) as ng, list_distinct({_split('na', 2)}) as at, list_distinct({_grams(_bare('na'))}) as ag, list_distinct(regexp_extract_all(na, '\b\d+\b')) as nu, {_POSTAL} as po from nrm),
  fm as (select s1_id, candidate_id, {_int("p.nn = q.nn and p.nn <> ''")} as name_exact_match, {_lev('p.nn', 'q.nn')} as name_levenshtein_ratio, {_j('p.nt', 'q.nt')} as name_jaccard_tokens, {_j('p.ng', 'q.ng')} as name_jaccard_ngrams, {_both('p.nt', 'q.nt')}::int as name_token_overlap_count,
    {_len('p.nn', 'q.nn')} as name_length_ratio, {_int('p.f1 = q.f1')} as name_first_token_match, {_lev('p.na', 'q.na')} as addr_levenshtein_ratio, {_j('p.at', 'q.at')} as addr_jaccard_tokens, {_j('p.ag', 'q.ag')} as addr_jaccard_ngrams, {_both('p.at', 'q.at')}::int as addr_token_overlap_count,
    {_len('p.na', 'q.na')} as addr_length_ratio, (len(list_intersect(p.nu, q.nu)) > 0)::int as addr_number_match, (len(list_intersect(p.po, q.po)) > 0)::int as addr_has_postal_pattern_match, {_int("p.nc = q.nc and p.nc <> ''")} as country_match, (p.nc = '' or q.nc = '')::int as country_missing,
    (p.no_name or q.no_name)::int as name_missing, (p.no_addr or q.no_addr)::int as addr_missing, score as cheap_similarity_score, case when gt.s1_id is null then 0 else 1 end as label
    from sc join fp p on p.entity_id = s1_id join fp q on q.entity_id = candidate_id left join gt using (s1_id, candidate_id))"""


def _matrix(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    return features.feature_matrix(_pairs(spark, sf_dir), s1, cd, fixtures.truth(s1, cd))


_cols = lambda names: ", ".join(["s1_id", "candidate_id", *names])


@query(_MATRIX + f" select {_cols([*features.FEATURES, 'label'])} from fm")
def feature_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(_MATRIX + f" select {_cols(features.NAME)} from fm")
def pair_features_name(spark, sf_dir):
    return _matrix(spark, sf_dir).select("s1_id", "candidate_id", *features.NAME)


@query(_MATRIX + f" select {_cols(features.ADDR)} from fm")
def pair_features_addr(spark, sf_dir):
    return _matrix(spark, sf_dir).select("s1_id", "candidate_id", *features.ADDR)


@query(_MATRIX + f" select {_cols(features.WHOLE)} from fm")
def pair_features_global(spark, sf_dir):
    return _matrix(spark, sf_dir).select("s1_id", "candidate_id", *features.WHOLE)


@query(_MATRIX + " " + " union all ".join(f"select '{c}' as feature, min({c})::double as min, round(avg({c}), 4) as mean, max({c})::double as max from fm" for c in features.FEATURES))
def feature_summary(spark, sf_dir):
    return features.feature_summary(_matrix(spark, sf_dir))


@query(_MATRIX + " select count(*) as pairs, count(distinct s1_id) as s1_entities, count(distinct candidate_id) as candidates, count_if(label = 1) as positives, count_if(label = 0) as negatives, avg(label)::double as positive_rate, count_if(label = 0) / nullif(count_if(label = 1), 0)::double as imbalance from fm")
def label_balance(spark, sf_dir):
    return features.label_balance(_matrix(spark, sf_dir))


# ---- evaluation ----------------------------------------------------------------------------------------------------

_ONE_BEST = _SCORED + f", best as ({_rank('score', 1)})," + _HITS.format(pairs="best")
_PRF = "case when a = 0 and c = 0 then 1.0::double when h = 0 then 0.0 else h / c::double end as p, case when a = 0 and c = 0 then 1.0::double when h = 0 then 0.0 else h / a::double end as r"
_F = "case when a = 0 and c = 0 then 1.0::double when h = 0 then 0.0 else 1.25::double * p * r / (0.25::double * p + r) end as f"
_EVAL = _ONE_BEST + f", ev as (select *, {_F} from (select *, {_PRF} from e))"
_MACRO = "round(avg(f), 9) as macro_f0_5, round(avg(p), 9) as macro_precision, round(avg(r), 9) as macro_recall, count(*) as num_entities, coalesce(avg((c = 0)::int) filter (where a = 0), 0.0)::double as singleton_accuracy, count_if(a = 0) as actual_singletons, count_if(c = 0) as predicted_singletons"


def _predictions(spark, sf_dir):
    return scoring.prune(_pairs(spark, sf_dir), *fixtures.sides(spark, sf_dir), top_k=1)


def _scores(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    return evaluation.entity_scores(_predictions(spark, sf_dir), _ids(s1), fixtures.truth(s1, cd))


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if c.startswith("macro") else c for c in df.columns))


@query(_EVAL + " select s1_id, c as num_predicted, a as num_actual, h as num_correct, p as precision, r as recall, f as f0_5, a = 0 as is_singleton_actual, c = 0 as is_singleton_predicted from ev")
def eval_per_entity(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(_EVAL + f" select {_MACRO} from ev")
def eval_summary(spark, sf_dir):
    return _rounded(evaluation.summary(_scores(spark, sf_dir)))


_T = ", ".join(f"{t}::double" for t in evaluation.THRESHOLDS)


@query(_PROBS + f""", g as (select m, s from (select unnest([{_T}]) as m), (select unnest([{_T}]) as s)), tp as (select s1_id, max(prob) as top from pr group by 1), ea as (select s1_id, count(*) as a from gt group by 1),
  k as (select s1_id, m, count_if(prob >= m) as c, count_if(prob >= m and label = 1) as h from pr, (select unnest([{_T}]) as m) group by 1, 2),
  e as (select g.m, g.s, entity_id, coalesce(a, 0) as a, case when top >= g.s then k.c else 0 end as c, case when top >= g.s then k.h else 0 end as h from s1 cross join g left join tp on tp.s1_id = entity_id left join ea on ea.s1_id = entity_id left join k on k.s1_id = entity_id and k.m = g.m),
  ev as (select *, {_F} from (select *, {_PRF} from e)) select m as match_threshold, s as singleton_threshold, {_MACRO} from ev group by m, s""")
def threshold_sweep(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    return _rounded(evaluation.threshold_sweep(_probs(spark, sf_dir), _ids(s1), fixtures.truth(s1, cd)))


@query(_PROBS + " select s1_id, candidate_id from pr join (select s1_id, max(prob) as top from pr group by 1) using (s1_id) where prob >= 0.5::double and top >= 0.8::double")
def two_threshold_predictions(spark, sf_dir):
    return evaluation.decide(_probs(spark, sf_dir), 0.5, 0.8)


@query(_PROBS + ", b as (select prob, count_if(label = 1) as pos, count_if(label = 0) as neg from pr group by 1), c as (select *, sum(pos) over (order by prob desc) as p from b) select round(sum(neg * (p - pos / 2.0::double)) / (sum(pos) * sum(neg)), 9) as roc_auc from c")
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_probs(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(_PROBS + ", b as (select prob, count_if(label = 1) as pos, count_if(label = 0) as neg from pr group by 1), c as (select *, sum(pos) over (order by prob desc) as p, sum(neg) over (order by prob desc) as n from b) select round(sum(pos * p / (p + n)::double) / sum(pos), 9) as average_precision from c")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(_probs(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(_PROBS + f""", t as (select t as threshold, count_if(prob >= t and label = 1) as c, count_if(prob >= t) as n, count_if(label = 1) as pos from pr, (select unnest([{', '.join(f'{t}::double' for t in evaluation.PAIR_THRESHOLDS)}]) as t) group by t),
  u as (select threshold, case when n = 0 then 0.0::double else c / n::double end as precision, case when pos = 0 then 0.0::double else c / pos::double end as recall from t)
  select *, case when precision + recall = 0 then 0.0::double else 1.25::double * precision * recall / (0.25::double * precision + recall) end as f0_5 from u""")
def pair_prf_at_thresholds(spark, sf_dir):
    return evaluation.pair_scores(_probs(spark, sf_dir))


# ---- splits, results, checks ---------------------------------------------------------------------------------------

_PART = "('0x' || substring(md5('42' || {0}), 1, 8))::bigint"


@query(_BASE + f" select entity_id as s1_id, case when {_PART.format('entity_id')} < {int(0.8 * (1 << 32))} then 'train' else 'val' end as split from s1")
def split_hash(spark, sf_dir):
    return splitting.hash_split(fixtures.entities(spark, sf_dir))


@query(_PAIRS + f", x as (select s1_id, {_PART.format('s1_id')} < {int(0.2 * (1 << 32))} as t from pairs) select count(*) as pairs, count_if(t) as test_pairs, count(distinct s1_id) as groups, 0::bigint as leaked from x")
def group_split_leak_check(spark, sf_dir):
    per = splitting.group_split(_pairs(spark, sf_dir)).groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    return per.agg(F.sum("n").alias("pairs"), F.sum("t").alias("test_pairs"), F.count("*").alias("groups"), F.count_if((F.col("t") > 0) & (F.col("t") < F.col("n"))).alias("leaked"))


@query(_SCORED + f", best as ({_rank('score', 3)}) select entity_id as source1_entity_id, coalesce(string_agg(candidate_id, ',' order by candidate_id), '') as matched_entity_ids from s1 left join best on s1_id = entity_id group by 1")
def matching_results(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    return writers.results(scoring.prune(_pairs(spark, sf_dir), s1, cd, top_k=3), _ids(s1))


@query(_BASE + " select entity_id as source1_entity_id, '' as matched_entity_ids from s1")
def baseline_submission(spark, sf_dir):
    return writers.empty_results(_ids(fixtures.sides(spark, sf_dir)[0]))


@query("select coalesce(text, '') as id, count(*) as n from (select md5(text) as text from documents) group by 1 having count(*) > 1")
def dup_id_report(spark, sf_dir):
    return readers.duplicate_ids(fixtures.entities(spark, sf_dir), "h")


# Raw lists made from the records: some blank, some with white space, empty pieces or repeats.
_RAW_SPARK = "case doc % 7 when 0 then null when 1 then '  ' when 2 then 'NaN' when 3 then concat('S2-', doc, ', S3-', doc, ',,') when 4 then concat('S2-', doc, ',S2-', doc) when 5 then concat('S1-', doc, ',X-', doc) else concat('S3-', doc) end"
_RAW_DUCK = "case doc % 7 when 0 then null when 1 then '  ' when 2 then 'NaN' when 3 then 'S2-' || doc || ', S3-' || doc || ',,' when 4 then 'S2-' || doc || ',S2-' || doc when 5 then 'S1-' || doc || ',X-' || doc else 'S3-' || doc end"
_RAW_SQL = f"raw as (select 'S1-' || doc as s1, {_RAW_DUCK} as rest, doc + 2 as line from (select doc_id as doc from documents) union all select 'S1-' || doc, 'S2-7', doc + 1000000000 from (select doc_id as doc from documents where doc_id % 50 = 0))"


def _raw(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"))
    rows = docs.selectExpr("concat('S1-', doc) as s1", f"{_RAW_SPARK} as rest", "doc + 2 as line")
    return rows.union(docs.where("doc % 50 = 0").selectExpr("concat('S1-', doc)", "'S2-7'", "doc + 1000000000"))


@query(f"with {_RAW_SQL}, l as (select s1, arg_max(coalesce(rest, ''), line) as r from raw group by s1) select s1 as s1_id, case when lower(trim(r)) in ('', 'nan') then '' else array_to_string(list_filter(list_transform(string_split(r, ','), lambda x: trim(x)), lambda x: x <> ''), '|') end as matches from l")
def ground_truth_parse(spark, sf_dir):
    rows = _raw(spark, sf_dir).select(F.col("s1").alias("source1_entity_id"), F.coalesce("rest", F.lit("")).alias("matched_entity_ids"), "line")
    return readers.ground_truth(rows, "line").select("s1_id", F.array_join("matches", "|").alias("matches"))


@query(f"""with {_RAW_SQL}, r as (select s1, case when trim(coalesce(rest, '')) = '' then []::varchar[] else string_split(rest, ',') end as ids from raw), i as (select s1, unnest(ids) as id from r), q as (select 'S1-' || doc_id as id from documents where doc_id % 3 = 0),
  f as (select 'VAL6' as rule, s1 as x from r group by s1 having count(*) > 1 union select 'VAL7', s1 from r where len(ids) <> len(list_distinct(ids)) union select 'VAL8', id from i where id like 'S1-%' union select 'VAL9', id from i where not regexp_matches(id, '^S[123]-')
    union select 'VAL10', id from i where (id like 'S2-%' or id like 'S3-%') and id not in (select entity_id from (with {fixtures.SQL} select entity_id from ent where entity_id not like 'S1-%'))
    union select 'VAL11', id from q where id not in (select s1 from r) union select 'VAL12', s1 from r where s1 not in (select id from q))
  select rule, 'error' as level, count(*) as n, array_to_string(list_sort(list(x))[1:5], ', ') as examples from f group by rule""")
def validate_rules(spark, sf_dir):
    value = F.concat("s1", F.lit("\t"), F.coalesce("rest", F.lit("")))
    rows = validation.parse(_raw(spark, sf_dir).select("line", value.alias("value")))
    s1, cd = fixtures.sides(spark, sf_dir)
    return validation.row_findings(rows, s1.select(F.col("entity_id").alias("id")), cd.select(F.col("entity_id").alias("id")))


@query(_SCORED + f", a as ({_rank('overlap', 3)}), b as ({_rank('score', 3)}) select distinct s1_id as s1 from a anti join b using (s1_id, candidate_id)")
def matches_not_in_candidates(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    scored = scoring.score_pairs(_pairs(spark, sf_dir).select("s1_id", "candidate_id"), s1, cd)
    lists = lambda by: writers.sorted_lists(scoring.best(scored, 3, by)).select(F.col("s1_id").alias("s1"), F.col("candidates").alias("ids"), F.lit(2).alias("line"))
    return validation.not_in_candidates(lists("overlap"), lists("score"))


@query()
def split_exact_shuffle(spark, sf_dir):
    return splitting.exact_split(fixtures.entities(spark, sf_dir))


@query()
def gbt_scores(spark, sf_dir):
    """Probabilities of the rows held out; the matrix is computed once, for the training and for them."""
    path, freed = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed)
    spark.conf.set(freed, "true")  # else the matrix's shuffles stay on disk while trees are trained
    try:
        _matrix(spark, sf_dir).write.parquet(path)
    finally:
        spark.conf.set(freed, before)
    fitted, held = model.train(spark.read.parquet(path))
    return model.predict(fitted, held)


@query()
def feature_importance(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    return model.importance(model.train(matrix)[0], matrix)


@query()
def gestalt_features(spark, sf_dir):
    s1, cd = fixtures.sides(spark, sf_dir)
    return features.feature_matrix(_pairs(spark, sf_dir), s1, cd, None, text.gestalt_ratio).select("s1_id", "candidate_id", "name_levenshtein_ratio", "addr_levenshtein_ratio")


@query(_pairs_sql(*_FUSED) + ", " + _score_sql(2) + f" select entity_id as s1_id, coalesce(string_agg(candidate_id, ' ' order by rank), '') as candidates from s1 left join ({_rank('score', 30)}) on s1_id = entity_id group by 1")
def resume_stream(spark, sf_dir):
    """The fused run over records that arrive as files, in micro-batches."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s1, cd = fixtures.sides(spark, sf_dir)
    s1 = s1.drop("h")
    s1.repartition(4, "entity_id").write.parquet(f"{top}/in")
    resume.start(spark, f"{top}/in", readers.RECORD, cd, f"{top}/out", f"{top}/state", presets.fused(), 30).awaitTermination()
    return spark.read.parquet(f"{top}/out").select("s1_id", F.array_join("candidates", " ").alias("candidates"))
