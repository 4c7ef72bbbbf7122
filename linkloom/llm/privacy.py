"""Information-theoretic sanitisation of personal data, by DataFrame functions only.

Personal data with a fixed form (addresses, numbers) are the protected entities. A term in a text with an entity, at
any distance, reveals it as far as it carries the entity's information: over the different texts of the corpus, the
pointwise mutual information log2(N n(e, t) / (n(e) n(t))) against the entity's own log2(N / n(e)). Terms with enough
support that reveal more than a share of it are marked wherever they stand in a text that holds the entity; above a
higher share they are removed, else generalised to their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: For each kind: its pattern, and a plain string or pattern that a text with a match has. Possessive repeats give the
#: same matches and keep long runs from recursion; an address begins where a run does or the last match ended.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
ORDER = [*KINDS, "term"]
TOKEN, GAP = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
STRETCH, PARTS = 128, 64
SPAN, TERM = "array<struct<start:bigint,end:bigint,value:string>>", "array<struct<start:bigint,end:bigint,share:double>>"


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once for all lambdas inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches with their places, in code points: what lies between them, and they themselves, added up. Appending
    copies an array, so each STRETCH of matches is gathered by itself first."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.array().cast(SPAN).alias("out")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["value"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))).alias("out"))

    def stretch(acc: Column, some: Column) -> Column:
        return _bind(F.aggregate(some, F.struct(acc["at"].alias("at"), none), step), lambda new: F.struct(new["at"].alias("at"), F.concat(acc["out"], new["out"]).alias("out")))

    def gathered(every: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(STRETCH)), lambda k: F.slice(every, k, STRETCH))
        return F.aggregate(stretches, F.struct(F.lit(0).cast("long").alias("at"), none), stretch, lambda acc: acc["out"])

    return _bind(F.filter(pairs, lambda x: x["value"].isNotNull()), gathered)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))

    def weigh(c: Column, i: Column) -> Column:
        x = c.cast("int")
        return F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    total = F.aggregate(F.transform(F.filter(F.split(d, ""), lambda c: c != ""), weigh), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    pattern, sign = KINDS[kind]
    has = F.contains(text, F.lit(sign)) if len(sign) == 1 else text.rlike(sign)
    return F.when(has, F.filter(located(text, pattern), lambda x: valid(kind, x["value"]))).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("k"), x["end"].alias("end")))


def distinct_texts(slim: DataFrame) -> DataFrame:
    """(doc, text): copies count once, and every count of the corpus is over these."""
    return slim.select(F.md5("text").alias("doc"), "text").groupBy("doc").agg(F.first("text").alias("text"))


def _found(slim: DataFrame) -> DataFrame:
    """(doc, text, email, ip, card, phone) of the different texts with an entity, computed once and cut: all that
    follows reads these, so that patterns run once over the table."""
    rows = slim.select(F.md5("text").alias("doc"), "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    # a column that isn't deterministic, and is used, keeps the filter here: pushed below, it would run the patterns anew
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rows = rows.where((sum((F.size(k) for k in KINDS), F.lit(0)) > 0) & (F.col("at") >= 0))
    return cut(rows.groupBy("doc").agg(F.first(F.struct("text", *KINDS)).alias("r")).select("doc", "r.*"))


def _words(text: Column, spans: Column) -> Column:
    """(start, end, value) of the whole words of three characters or more that no entity touches."""
    apart = lambda t: ~F.exists(spans, lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"]))
    return F.filter(located(text, TOKEN), lambda t: (F.length(t["value"]) >= 3) & apart(t))


def _hash(value: Column) -> Column:
    return F.xxhash64(F.lower(value))


def _held(found: DataFrame, least_docs: int, total: Column) -> tuple[DataFrame, DataFrame]:
    """(doc, entity) of all entities with support, and (entity, n_e). An entity that every text holds has no
    information to reveal."""
    held = found.select("doc", F.explode(F.array_distinct(F.transform("spans", lambda e: _hash(e["value"])))).alias("entity"))
    of = held.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= least_docs) & (F.col("n_e") < total))
    return held.join(of.select("entity"), "entity"), of


def disclosing_terms(texts: DataFrame, contexts: DataFrame, of: DataFrame, total: Column, least_docs: int = 3, share: float = 0.7) -> DataFrame:
    """(entity, term, share) of terms that reveal at least that share of an entity, with support of least_docs texts."""
    pairs = contexts.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= least_docs).join(of, "entity")
    words = texts.select(F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), GAP), lambda w: F.xxhash64(w)))).alias("term"))
    freq = words.groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = pairs.join(freq, "term").withColumn("total", total)
    pmi = F.log2(F.col("total") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    return pairs.withColumn("share", pmi / F.log2(F.col("total") / F.col("n_e"))).where(F.col("share") >= share).select("entity", "term", "share")


def _marked(slim: DataFrame, found: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(doc, term): in each text, all words that reveal an entity which this text holds, wherever they stand."""
    texts = distinct_texts(slim)
    total = slim.select(F.md5("text").alias("doc")).distinct().agg(F.count("*").cast("double").alias("total")).scalar()
    found = found.select("doc", "text", F.concat(*KINDS).alias("spans"))
    held, of = _held(found, least_docs, total)
    with_support = found.join(held.groupBy("doc").agg(F.collect_list("entity").alias("entities")), "doc")
    contexts = with_support.select("doc", "entities", F.explode(F.array_distinct(F.transform(_words(F.col("text"), F.col("spans")), lambda t: _hash(t["value"])))).alias("term"))
    contexts = contexts.select("doc", F.explode("entities").alias("entity"), "term")
    terms = contexts.join(disclosing_terms(texts, contexts, of, total, least_docs, share), ["entity", "term"])
    terms = terms.groupBy("doc", "term").agg(F.max("share").alias("share")).groupBy("doc").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.filter("terms", lambda x: F.pmod(x["term"], F.lit(PARTS)) == k))
    both = found.join(terms.select("doc", parts.alias("parts")), "doc")

    def revealed(parts: Column) -> Column:
        of_word = lambda h: F.get(F.filter(F.get(parts, F.pmod(h, F.lit(PARTS)).cast("int")), lambda x: x["term"] == h), F.lit(0))["share"]
        out = F.transform(_words(F.col("text"), F.col("spans")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _bind(_hash(t["value"]), of_word).alias("share")))
        return F.filter(out, lambda x: x["share"].isNotNull())

    return both.select("doc", _bind(F.col("parts"), revealed).alias("term"))


def find(docs: DataFrame, least_docs: int = 3, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, term) for every row of docs: arrays of (start, end, value) in code points, of
    terms (start, end, share).

    A null text is an empty one and has none. Equal texts have equal results, and count once in the corpus. Null ids
    and repeats are rows like others, further columns are ignored."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _found(slim)
    # cut, so that Spark deals both sides of the last join itself and can split a text with very many copies
    spans = cut(found.drop("text").join(_marked(slim, found, least_docs, share), "doc", "left"))
    out = slim.select("doc_id", F.md5("text").alias("doc")).join(spans, "doc", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(F.col("doc_id").alias(id_col), *(none(k, SPAN) for k in KINDS), none("term", TERM))


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, least_docs: int = 3, share: float = 0.7, remove: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) for every row of docs, with entities replaced by their kind, terms that reveal the share `remove`
    taken out and other marked terms generalised to TERM. Overlapping spans go as one. A null text becomes an empty one;
    null ids and repeats are rows like others, further columns are ignored."""
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))
    own = slim.select(F.col("text__").alias("text"))
    found = _found(own)
    found = found.join(_marked(own, found, least_docs, share), "doc", "left").withColumn("term", F.coalesce("term", F.array().cast(TERM)))
    mark = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("by")))
    terms = F.transform("term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["share"] >= remove, "").otherwise("[TERM]").alias("by")))
    both = found.select("doc", "text", F.array_sort(F.concat(*map(mark, KINDS), terms)).alias("s"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(x["start"] < acc["at"], "").otherwise(x["by"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], kept, new).alias("out"))

    text = F.aggregate("s", first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    changed = both.where("size(s) > 0").select("doc", text.alias("new__"))
    out = slim.withColumn("doc", F.md5("text__")).join(changed, "doc", "left")
    return out.select(F.col(id_col), F.coalesce("new__", "text__").alias(text_col))
