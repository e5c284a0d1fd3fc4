"""Personal data by pattern, and the terms that give it away by corpus co-occurrence. DataFrame functions only.

Protected entities are the values of the four patterns and secrets (long runs of letters and digits of high entropy), each by its value
and, for what they have in common, by its kind. A term reveals an entity when knowing the term tells most of what there is to know about
it: the pointwise mutual information of term and entity over documents, as a share of the entity's own information,
PMI(t, e) / -log2 p(e), which is 1 if the term only occurs with the entity. Terms are the words of all documents that have
the entity, wherever they stand. Kinds are common, so that a rare word may fall on their documents by chance: for them p(e | t) is a lower
posterior bound whose prior is p(e). Terms over DISCLOSURE, seen in SUPPORT different documents or surroundings of the
entity at least, are spans of kind term in each document that has the entity, and are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm.common import drop, saved

#: In this order where two spans begin together.
KINDS = ("email", "ip", "card", "phone", "term", "secret")
# Possessive loops and starts only at the edge of a run: the same matches as the plain patterns, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"
#: A secret has this many bits a character at least, and changes this often between letters and digits.
ENTROPY, CHANGES = 3.0, 5
WORD = r"\p{L}{2,}"
#: Characters around an entity whose words count as its surroundings; thresholds.
AROUND, DISCLOSURE, SUPPORT = 60, 0.85, 3
#: Least hashes of three-word shingles that tell whether documents differ; near copies share most.
SKETCH = 3
#: Documents that the prior of p(kind | term) counts as, and how many standard deviations below its mean the bound lies.
PRIOR, BELOW = 1.0, 2.0
#: Items in a block of a running sum, and code points in a piece of a text.
STEP, PIECE = 256, 1000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def term(i: Column) -> Column:
        n = F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    d = _digits(x)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda s: _valid(kind, s["value"])


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: int, merge) -> Column:
    """For each of some ints what merge makes of start and all before it, in blocks: an array that grows by one item is copied each time, so none grows long."""
    grown = lambda xs, first: F.aggregate(xs, F.struct(first.alias("now"), F.expr("CAST(array() AS array<int>)").alias("out")), lambda acc, x: F.struct(merge(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int")), lambda k: F.slice(xs, k * STEP + 1, F.lit(STEP)))

    def whole(parts: Column) -> Column:
        firsts = grown(F.transform(parts, lambda p: F.aggregate(p, F.lit(start), merge)), F.lit(start))
        return F.flatten(F.zip_with(parts, firsts, grown))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, _let(blocks(xs), whole)).otherwise(F.expr("CAST(array() AS array<int>)")))


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans (start, kind number, end, value) of all matches: a match starts after the pieces and matches before it."""
    number, empty = KINDS.index(kind), F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int, value: string>>)")
    span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(number).alias("kind"), (at + x["both"]).alias("end"), x["value"].alias("value"))

    def spans(found: Column) -> Column:
        measured = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), (F.length(p) + F.length(m)).alias("both"), m.alias("value")))
        return _let(measured, lambda xs: F.zip_with(xs, _running(F.transform(xs, lambda x: x["both"]), 0, lambda a, x: a + x), span))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(empty))


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by start and kind. Matches that fail their kind's check are dropped."""
    own = []
    for kind, pattern in PATTERNS.items():
        own.append(F.filter(_located(text, F.lit(pattern), kind), _passes(kind)))
    return F.array_sort(F.concat(*own))


def _random(x: Column) -> Column:
    """Whether a run of letters and digits looks drawn at random: characters of high entropy, letters and digits in turns."""
    n = F.length(x)
    counts = F.transform(F.array_distinct(F.split(x, "")), lambda c: n - F.length(F.replace(x, c)))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, c / n * F.log2(c / n)).otherwise(F.lit(0.0)))
    changes = F.size(F.regexp_extract_all(x, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0)))
    return (changes >= CHANGES) & (bits >= ENTROPY)


def secret_spans(text: Column) -> Column:
    return F.filter(_located(text, F.lit(SECRET), "secret"), lambda s: _random(s["value"]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near(text: Column, span: Column) -> Column:
    """The text around a span, without words cut at its ends."""
    from_ = F.greatest(span["start"] - AROUND, F.lit(0))
    left = F.substring(text, from_ + 1, span["start"] - from_)
    right = F.substring(text, span["end"] + 1, F.lit(AROUND))
    left = F.when(from_ > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(text) > span["end"] + AROUND, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return F.concat_ws(" ", left, right)


def _whole(found: DataFrame) -> DataFrame:
    """(doc_id, terms, sketch) of found (doc_id, text): the words outside entities (of which emails and secrets have letters), and SKETCH numbers that differ between documents but for copies."""
    i = lambda k: F.get("words", k)
    shingles = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda k: F.xxhash64(i(k), i(k + 1), i(k + 2)))
    clean = F.lower(F.regexp_replace(F.regexp_replace("text", PATTERNS["email"], " "), SECRET, " "))
    out = found.select("doc_id", F.regexp_extract_all(clean, F.lit(WORD), F.lit(0)).alias("words"))
    out = out.withColumn("shingles", F.when(F.size("words") >= 3, shingles).otherwise(F.array(F.xxhash64("words"))))
    sketch = [F.array_min(F.transform("shingles", lambda h, k=k: F.xxhash64(h, F.lit(k)))) for k in range(SKETCH)]
    return out.select("doc_id", F.array_distinct("words").alias("terms"), F.array(*sketch).alias("sketch"))


def disclosed(n: Column, n_entity: Column, n_term: Column, n_both: Column, is_kind: Column) -> Column:
    """PMI of term and entity as a share of the entity's information; for kinds at the lower posterior bound of p(entity | term)."""
    own = n_entity / n
    mean = (n_both + PRIOR * own) / (n_term + PRIOR)
    bound = F.greatest(mean - BELOW * F.sqrt(mean * (1 - mean) / (n_term + PRIOR + 1)), F.lit(1e-12))
    return F.log2(F.when(is_kind, bound).otherwise(n_both / n_term) / own) / -F.log2(own)


def revealing_terms(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs (text), found (doc_id, text, own) -> a saved table (entity, terms). Counts are over all documents and whole texts."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))).alias("term"))
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    having = found.where("size(own) > 0")
    rows = having.select("doc_id", "text", F.explode("own").alias("s")).withColumn("entity", _entity("s"))
    kinds = having.select("doc_id", F.explode(F.array_distinct(F.transform("own", lambda s: s["kind"].cast("string")))).alias("entity"))
    entities = rows.select("doc_id", "entity").distinct().union(kinds)
    n_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = rows.withColumn("near", F.lower(_near(F.col("text"), F.col("s"))))
    pairs = near.select("entity", F.xxhash64("near").alias("where"), F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(WORD), F.lit(0)))).alias("term"))
    by_where = saved(pairs.distinct().groupBy("entity", "term").agg(F.count("*").alias("n_where")).where(F.col("n_where") >= support).select("entity", "term"), "near")
    # other entities are in too few documents and surroundings for any term
    eligible = n_entity.where(F.col("n_entity") >= support).select("entity").union(by_where.select("entity")).distinct()
    entities = saved(entities.join(eligible, "entity"), "entities")
    key = F.col("doc_id").eqNullSafe(F.col("doc"))
    own = having.select("doc_id", "text").join(entities.select(F.col("doc_id").alias("doc")).distinct(), key, "left_semi")
    whole = saved(_whole(own), "whole")
    both = whole.join(entities.withColumnRenamed("doc_id", "doc"), key).select("doc_id", "entity", "sketch", F.explode("terms").alias("term"))
    by_doc = both.select("entity", "term", "doc_id").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    measured = by_doc.join(n_entity, "entity").join(n_term, "term").crossJoin(F.broadcast(total)).where(F.col("n") > F.col("n_entity"))
    share = disclosed(F.col("n"), F.col("n_entity"), F.col("n_term"), F.col("n_both"), ~F.contains("entity", F.lit(":")))
    telling = saved(measured.where(share >= disclosure).select("entity", "term"), "telling")
    seen = both.join(telling, ["entity", "term"]).select("entity", "term", F.posexplode("sketch").alias("k", "value")).distinct().groupBy("entity", "term", "k").agg(F.count("*").alias("n"))
    by_text = seen.groupBy("entity", "term").agg(F.min("n").alias("n")).where(F.col("n") >= support).select("entity", "term")
    supported = telling.join(by_where, ["entity", "term"], "left_semi").union(by_text)
    out = saved(supported.groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms")), "terms")
    drop(by_where, entities, whole, telling)
    return out


def _entity(span: str) -> Column:
    return F.concat_ws(":", F.col(f"{span}.kind").cast("string"), F.lower(f"{span}.value"))


def _spans(docs: DataFrame, disclosure: float, support: int, with_text: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, text, base, spans), and the tables it reads, which hold personal data."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", "text", base_spans(text).alias("base"), secret_spans(text).alias("secrets"))
    found = found.select("doc_id", "text", "base", F.array_sort(F.concat("base", "secrets")).alias("own"))
    found = saved(found if with_text else found.withColumn("text", F.when(F.size("own") > 0, F.col("text"))), "found")
    terms = revealing_terms(docs, found, disclosure, support)
    rows = found.where("size(own) > 0 AND doc_id IS NOT NULL").select("doc_id", F.explode("own").alias("s"))
    rows = rows.select("doc_id", F.explode(F.array(_entity("s"), F.col("s.kind").cast("string"))).alias("entity")).distinct()
    own = rows.join(terms, "entity").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    out = found.join(own, "doc_id", "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.reverse(F.array_sort("terms")), "|"), F.lit(r")(?!\p{L})"))
    extra = F.when(F.col("terms").isNotNull(), _located(F.col("text"), pattern, "term"))
    return out.withColumn("spans", F.when(F.col("terms").isNull(), F.col("own")).otherwise(F.array_sort(F.concat("own", extra)))), [found, terms]


def sanitised(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets, terms by nothing; spans that overlap are replaced as one."""
    names = F.array(*[F.lit("" if k == "term" else f"<{k}>") for k in KINDS])

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Code points from start to end, looked up in the pieces that hold them."""
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

    def body(pieces: Column, own: Column) -> Column:
        reached = _running(F.transform(own, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))  # where the spans before end
        parts = F.zip_with(own, reached, lambda s, r: F.when(s["start"] >= r, F.concat(cut(pieces, r, s["start"]), F.get(names, s["kind"]))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), cut(pieces, F.array_max(F.transform(own, lambda s: s["end"])), F.length(text)))

    whole = lambda own: F.when(F.size(own) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: body(pieces, own))).otherwise(text)
    return _let(spans, whole)


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, base, spans, sanitised), a row for each row of docs.

    base (the four patterns) and spans (secrets and terms too) are arrays of (start, kind number, end, value), in code points, end
    exclusive. sanitised has every span replaced by its kind in angle brackets, terms by nothing; spans that overlap are replaced as
    one. Null and empty texts have no spans (sanitised stays null or empty). Rows that repeat a doc_id share their terms; rows without doc_id
    have no terms. An empty table gives no rows; further columns are left out.
    """
    out, made = _spans(docs.select("doc_id", "text"), disclosure, support, True)
    out = saved(out.select("doc_id", "base", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised")), "sanitised")
    drop(*made)
    return out


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, made = _spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DISCLOSURE, SUPPORT, False)
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS long)").alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    out = saved(out.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")), "positions")
    drop(*made)  # no personal data stays in the shared folder
    return out
