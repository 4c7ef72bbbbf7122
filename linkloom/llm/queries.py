"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, metric, packing, pieces, privacy, quality, rules, secrets, tokencounts

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold(5) != 0)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    order = [*secrets.KINDS, *(f"decoded_{k}" for k in secrets.KINDS)]
    rank = lambda x: F.array_position(F.array(*map(F.lit, order)), x["kind"])
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("s"), rank(x).alias("k"), x["end"].alias("e"), x.alias("x")))), lambda y: text(y["x"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "decoded")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(3) != 1))
    return language.identify(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    base = F.concat(*(privacy.tagged(F.col(k), k) for k in privacy.KINDS))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in privacy.KINDS), F.sha2(privacy.joined(base), 256).alias("base_sha256"), privacy.joined(F.concat(base, privacy.tagged(F.col("term"), "term"))).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_ngram_jaccard, op3_harmonic_packing, op4_embedding_range_join, op5_secret_scan, op6_language_id, op7_sentencepiece, op8_quality_rules, op9_pii_sanitisation, op10_token_counts]
    return {f.__name__: f for f in found}


OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
  u as (select distinct text from d),
  w as (select text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from u),
  p as (select text, i, w[i:i + 7] as g from (select text, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
  t as (select text, i, count(*) over (partition by text, g) as c from p),
  c as (select text, sum(least(8, coalesce(nxt - i, 8))) as n from (select text, i, lead(i) over (partition by text order by i) as nxt from t where c > 1) group by text),
  b as (select w.text, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
    from w left join c using (text)),
  x as (select host, text, unnest(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) as l from (select distinct host, text from d)),
  y as (select host, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
      regexp_replace(array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') as line from x),
  f as (select host, line from y group by host, line having count(distinct text) > 20),
  r as (select y.host, text, sum(case when f.line is null then 0 else n end)::double / sum(n) as removed_share from y left join f on y.host = f.host and y.line = f.line group by y.host, text)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(removed_share, 0.0) < 0.8 as kept,
  coalesce(removed_share, 0.0) as removed_share
from d join b using (text) left join r on d.text = r.text and d.host = r.host
"""


#: Components of the links e (a, b), both ways, among the nodes n (id): reach (id, top).
_REACH = """reach as (select id, id as top from n union select e.b, reach.top from reach join e on e.a = reach.id)"""

OP2_SQL = rf"""
with recursive d as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh from d),
  n as (select id, len(sh) as size from s),
  p as (select id, unnest(sh) as g from s),
  c as (select x.id as a, y.id as b, count(*) as shared from p x join p y on x.g = y.g and x.id <> y.id group by 1, 2),
  e as (select a, b from c join n na on na.id = a join n nb on nb.id = b where 100 * shared >= 75 * (na.size + nb.size - shared)),
  {_REACH}
select n.id as doc_id, n.size::bigint as n_shingles, min(top) as component_id from n join reach on reach.id = n.id group by n.id, n.size
"""

OP4_SQL = rf"""
with recursive n as (select vec_id as id, label, embedding::double[] as v from embeddings),
  f as (select * from n where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(v, lambda x: x * x)) > 0),
  e as (select x.id as a, y.id as b from f x join f y on x.label = y.label and x.id <> y.id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.93),
  {_REACH},
  k as (select a, count(*) as links from e group by a), t as (select id, min(top) as component_id from reach group by id)
select t.id as vec_id, coalesce(links, 0)::bigint as n_links, component_id, t.id = component_id as kept from t left join k on a = t.id
"""

# ---- op9: places are sums of the lengths of what lies between matches and of the matches ----------------------------
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_full_match(v, '{privacy._BYTE}(?:[.]{privacy._BYTE}){{3}}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(digits) between 14 and 19 and list_sum(list_transform(range(length(digits)), lambda i: case when i % 2 = 0 then digits[length(digits) - i]::int when digits[length(digits) - i]::int > 4 then 2 * digits[length(digits) - i]::int - 9 else 2 * digits[length(digits) - i]::int end)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 10 and 15"),
}
_located = lambda source, pattern: f"""(select id, a, a + length(v) as b, v from (select id, v, sum(length(g)) over w + coalesce(sum(length(v)) over (w rows between unbounded preceding and 1 preceding), 0) as a
    from (select id, unnest(range(1, len(g) + 1)) as i, unnest(g) as g, unnest(v) as v from (select id, string_split_regex(t, '{pattern}') as g, regexp_extract_all(t, '{pattern}') as v from {source})) window w as (partition by id order by i)) where v is not null)"""  # noqa: E731
OP9_SQL = (
    "with u as (select t, row_number() over () as id from (select distinct coalesce(text, '') as t from documents)),\n  "
    + ",\n  ".join(f"{k} as (select id, {i} as k, a, b, v from (select *, regexp_replace(v, '[^0-9]', '', 'g') as digits from {_located('u', pattern)}) where {valid})" for i, (k, (pattern, valid)) in enumerate(_PII.items()))
    + rf""",
  base as (select * from email union all select * from ip union all select * from card union all select * from phone),
  total as (select count(*)::double as total from u),
  held as (select distinct id, lower(v) as entity from base),
  ne as (select entity, count(*) as n_e from held group by entity having n_e >= 3 and n_e < (select total from total)),
  h as (select id, entity from held join ne using (entity)),
  tx as (select * from u where id in (select id from h)),
  wd as (select w.id, w.a, w.b, lower(w.v) as term from {_located("tx", r"[\p{L}\p{N}]+")} w where length(w.v) >= 3 and not exists (select 1 from base x where x.id = w.id and x.a < w.b and w.a < x.b)),
  et as (select entity, term, count(*) as n_et from h join (select distinct id, term from wd) using (id) group by entity, term having n_et >= 3),
  nt as (select term, count(*) as n_t from (select distinct id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) as term from u) where term in (select term from et) group by term),
  tell as (select entity, term from et join ne using (entity) join nt using (term), total where log2(total * n_et / (n_e * n_t)) / log2(total / n_e) >= 0.7),
  mk as (select distinct wd.id, wd.a, wd.b from wd join h using (id) join tell using (entity, term)),
  every as (select id, k, a, b from base union all select id, 4, a, b from mk),
  named as (select id, k, a, b, ['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || a || ':' || b as s from every),
  o as (select id, count(*) filter (where k = 0) as n_email, count(*) filter (where k = 1) as n_ip, count(*) filter (where k = 2) as n_card, count(*) filter (where k = 3) as n_phone,
      string_agg(s, ',' order by a, k, b) filter (where k < 4) as base, string_agg(s, ',' order by a, k, b) as spans from named group by id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from (select doc_id, coalesce(text, '') as t from documents) join u using (t) left join o using (id)
"""
)


def oracle_sql() -> dict[str, str]:
    """Tokens, trained models and decoders can't be put in SQL: tests hold those operators against plain versions."""
    return {"op2_ngram_jaccard": OP2_SQL, "op4_embedding_range_join": OP4_SQL, "op8_quality_rules": OP8_SQL, "op9_pii_sanitisation": OP9_SQL}
