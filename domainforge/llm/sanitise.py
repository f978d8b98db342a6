"""Personal data: fixed patterns, and terms whose co-occurrence in the corpus gives a protected entity away.

A term t discloses a protected entity c by its pointwise mutual information relative to the information content
of the entity: PMI(t; c) / IC(c), which is 1 when t occurs with c only. Protected are the single values (one
address, by hash) and the kinds (any address). A ratio counts only where so many common documents are not to be
expected by chance, given how many pairs are tried. Disclosing terms are generalised in all documents, and terms
that are (almost) conclusive are removed. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.plans.scratch import materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns in a form that the regular-expression engine matches in linear time with a bounded
#: stack. A match can only begin where a run of its first class begins or where the last match ended.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]++",
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
NOT_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_TERM = 3
#: Expected number of pairs, among all that are tried, whose common documents would be as many by chance.
CHANCE = 0.05
#: Disclosure ratios from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.97


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    worth = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i) - F.when(worth(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _places(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as structs (s, v): the text between them gives their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,v:string>>").alias("out"))
    step = lambda a, m: F.struct(
        (a["at"] + F.length(m["0"]) + F.coalesce(F.length(m["1"]), F.lit(0))).alias("at"),
        F.when(m["1"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct((a["at"] + F.length(m["0"])).alias("s"), m["1"].alias("v"))))).alias("out"),
    )
    return F.aggregate(F.arrays_zip(between.alias("0"), found.alias("1")), zero, step)["out"]


def _kind_spans(text: Column, k: int, kind: str) -> Column:
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    value = (lambda m: F.regexp_replace(m["v"], "[ ().-]+$", "")) if kind == "phone" else (lambda m: m["v"])
    kept = F.filter(_places(text, PATTERNS[kind]), lambda m: _passes(kind, value(m)))
    spans = F.transform(kept, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), (m["s"] + F.length(value(m))).alias("e")))
    return F.when(guard, spans).otherwise(F.array().cast("array<struct<k:int,s:int,e:int>>"))


def base_spans(text: Column) -> Column:
    """All pattern matches as an array of (k, s, e): kind number, start and end in code points."""
    return F.concat(*(_kind_spans(text, k, kind) for k, kind in enumerate(KINDS[:4])))


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), NOT_LETTER, -1)


def entities(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct texts by key that hold an entity: id, th (hash of the text), text, base (spans)."""
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = source.where(F.col("text").rlike("[0-9@]")).withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    return materialize(found.select("id", F.xxhash64("text").alias("th"), "text", "base").dropDuplicates(["id", "th"]), "entities")


def _term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_terms(text), lambda w: F.length(w) >= MIN_TERM), lambda w: F.xxhash64(w)))


def _value_hash(kind: Column, value: Column) -> Column:
    """One hash for all spellings of a value: addresses in lower case, numbers by their digits."""
    return F.xxhash64(kind, F.when(kind < 2, F.lower(value)).otherwise(F.regexp_replace(value, "[^0-9]", "")))


def _log_chance(common: Column, a: Column, b: Column, n: Column) -> Column:
    """Chernoff's bound of the log-probability that ``a`` of ``n`` documents meet ``b`` others at least ``common`` times."""
    p, q = common / a, b / n
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return F.when(p > q, -a * (p * F.log(p / q) + rest)).otherwise(0.0)


def disclosing_terms(docs: DataFrame, found: DataFrame, *, text: str = "text", generalise: float = GENERALISE, chance: float = CHANCE) -> DataFrame:
    """(term hash, kind number, ratio) of the terms that disclose a value or a kind, by document co-occurrence
    over all of ``docs``. Of a value in one document only nothing can be told: all words of it go with all others."""
    value = lambda b: F.struct(b["k"].alias("kind"), _value_hash(b["k"], F.substring(F.col("text"), b["s"] + 1, b["e"] - b["s"])).alias("value"))
    kind = lambda b: F.struct(b["k"].alias("kind"), F.lit(None).cast("long").alias("value"))
    held = found.select("id", "th", F.explode(F.array_distinct(F.concat(F.transform("base", kind), F.transform("base", value)))).alias("of"))
    by_entity = materialize(held.groupBy("of").agg(F.count("*").alias("n_c")).where(F.col("of.value").isNull() | (F.col("n_c") > 1)), "protected")
    tried = held.join(by_entity.where("of.value is not null").select("of"), "of", "left_semi").groupBy("id", "th").agg(F.collect_list("of").alias("values")).toDF("_i", "_t", "values")
    kinds = F.array_distinct(F.transform("base", kind))
    with_entity = found.join(tried, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left").select(F.concat(kinds, F.coalesce("values", F.array().cast("array<struct<kind:int,value:bigint>>"))).alias("all"), "text")
    terms = with_entity.select("all", F.explode(_term_hashes(F.col("text"))).alias("term"))
    both = materialize(terms.select("term", F.explode("all").alias("of")).groupBy("term", "of").agg(F.count("*").alias("n_tc")), "common")
    alone = docs.where(F.col(text).isNotNull()).select(F.explode(_term_hashes(F.col(text).cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total, pairs = docs.agg(F.count("*").alias("n")), both.agg(F.count("*").alias("pairs"))
    joined = both.join(alone, "term").join(by_entity, "of").join(F.broadcast(total)).join(F.broadcast(pairs))
    pmi, ic = F.log(F.col("n_tc") * F.col("n") / (F.col("n_t") * F.col("n_c"))), -F.log(F.col("n_c") / F.col("n"))
    ratio = F.when(ic > 0, pmi / ic).otherwise(0.0)
    log_chance = F.least(_log_chance(F.col("n_tc"), F.col("n_t"), F.col("n_c"), F.col("n")), _log_chance(F.col("n_tc"), F.col("n_c"), F.col("n_t"), F.col("n")))
    sure = log_chance + F.log("pairs") <= F.log(F.lit(chance))
    return joined.where(sure).select("term", F.col("of.kind").alias("kind"), ratio.alias("ratio")).where(F.col("ratio") >= generalise)


def term_spans(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, added): spans of disclosing terms in all texts that have one."""
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ratios = F.broadcast(terms.groupBy("term").agg(F.max("ratio").alias("ratio")))
    having = source.select("id", "th", F.explode(_term_hashes(F.col("text"))).alias("term")).join(ratios, "term", "left_semi").select(F.col("id").alias("_i"), F.col("th").alias("_t")).distinct()
    texts = source.join(having, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select("id", "th", "text").dropDuplicates(["id", "th"])
    between, words = F.split("text", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", -1), F.regexp_extract_all("text", F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = texts.select("id", "th", F.posexplode(F.arrays_zip(between.alias("gap"), words.alias("word"))).alias("pos", "m"))
    before = F.sum(F.length("m.gap") + F.coalesce(F.length("m.word"), F.lit(0))).over(W.partitionBy("id", "th").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.select("id", "th", "pos", F.col("m.word").alias("word"), (F.coalesce(before, F.lit(0)) + F.length("m.gap")).cast("int").alias("s"))
    placed = placed.where(F.length("word") >= MIN_TERM).withColumn("term", F.xxhash64(F.lower("word")))
    hit = placed.join(ratios, "term")
    return hit.groupBy("id", "th").agg(F.collect_list(F.struct(F.lit(4).alias("k"), F.col("s"), (F.col("s") + F.length("word")).alias("e"), (F.col("ratio") >= REMOVE).alias("drop"))).alias("added"))


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["k"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["s"], s["e"])), ",")


def find_private(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with _base, an array of (k, s, e), and _added, an array of (k, s, e, drop).

    A null text is empty. Repeated rows have the same spans. A term's span within an entity is left out.
    Columns of the input with these names are replaced."""
    docs = docs.drop("_base", "_added")
    found = entities(docs, key=key, text=text)
    terms = materialize(disclosing_terms(docs, found, text=text), "terms")
    added = term_spans(docs, terms, key=key, text=text)
    none, plain = F.array().cast("array<struct<k:int,s:int,e:int,drop:boolean>>"), F.array().cast("array<struct<k:int,s:int,e:int>>")
    spans = found.select("id", "th", "base").unionByName(added, allowMissingColumns=True)
    spans = spans.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.coalesce(F.first("base", True), plain).alias("_base"), F.coalesce(F.first("added", True), none).alias("_added"))
    apart = F.filter("_added", lambda a: ~F.exists("_base", lambda b: (b["s"] < a["e"]) & (a["s"] < b["e"])))
    spans = materialize(spans.withColumn("_added", apart), "spans")
    hashed = docs.withColumn("_th_of", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = hashed.join(spans, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_th_of") == F.col("_th")), "left")
    return joined.drop("_id", "_th", "_th_of").withColumn("_base", F.coalesce("_base", F.array().cast("array<struct<k:int,s:int,e:int>>"))).withColumn("_added", F.coalesce("_added", F.array().cast("array<struct<k:int,s:int,e:int,drop:boolean>>")))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with entities and generalised terms replaced by their kind and conclusive terms removed."""
    marks = F.concat(F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), F.lit(False).alias("drop"))), F.transform(added, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), b["drop"].alias("drop"))))
    label = lambda m: F.when(m["drop"], "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*(F.lit(k) for k in KINDS)), m["k"] + 1)), F.lit("]")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, m: F.struct(
        F.greatest(a["at"], m["e"]).alias("at"),
        F.when(m["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, m["s"] - a["at"]), label(m))).alias("out"),
    )
    done = F.aggregate(F.array_sort(marks), zero, step)
    return F.when(F.size(marks) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    plain = F.transform("_added", lambda a: F.struct(a["k"].alias("k"), a["s"].alias("s"), a["e"].alias("e")))
    count = lambda k: F.size(F.filter("_base", lambda b: b["k"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", plain)).alias("spans"))
