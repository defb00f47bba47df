"""Personal data: fixed patterns, and terms that give them away by co-occurrence in the corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, small

#: Kinds in their order, with patterns that match what the plain ones do but never go back in a run of characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "general", "term"]
#: Every match of a kind has these characters.
MARKS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
SPACE = r"[\x20\x09-\x0D]"
CUT = "\x01"
TERM = r"^[\p{L}\p{M}'’-]++$"
#: A table of terms of no more rows is broadcast.
SMALL_TERMS = 200_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """Whether a match of a kind passes the kind's check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.when(kind == "ip", value.rlike(IP)).when(kind == "card", card).when(kind == "phone", F.length(digits).between(10, 15)).otherwise(True)


def pattern_spans(texts: DataFrame) -> DataFrame:
    """texts (key, text) to (key, kind, start, end, value) of all matches that hold, in code points.

    A match is cut out by a character that no pattern has; lengths of the pieces give the places.
    """
    clean = texts.select("key", F.translate("text", CUT, "\x02").alias("text"))
    cuts = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col("text").rlike(MARKS[k]), F.regexp_replace("text", p, f"{CUT}$0{CUT}")).alias("marked")) for k, p in PATTERNS.items()])
    each = clean.select("key", F.inline(cuts)).where(F.instr("marked", CUT) > 0)
    pieces = each.select("key", "kind", F.posexplode(F.split("marked", CUT, -1)).alias("n", "value"))
    end = F.sum(F.length("value")).over(Window.partitionBy("key", "kind").orderBy("n")).cast("long")
    found = pieces.withColumn("end", end).where((F.col("n") % 2 == 1) & holds(F.col("kind"), F.col("value")))
    return found.select("key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def words_of(texts: DataFrame) -> DataFrame:
    """texts (key, text) to (key, start, end, term): words by white space, without what is no letter at their ends, lower-cased.

    Only words of letters are terms; what holds digits or signs is left to the patterns.
    """
    pieces = texts.select("key", F.posexplode(F.split("text", SPACE, -1)).alias("n", "word"))
    end = (F.sum(F.length("word") + 1).over(Window.partitionBy("key").orderBy("n")) - 1).cast("long")
    placed = pieces.withColumn("end", end).where("word != ''").select("key", (F.col("end") - F.length("word")).alias("start"), "end", term_of(F.col("word")).alias("term"))
    return placed.where(F.col("term").rlike(TERM))


def term_of(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]++|[^\p{L}]++$", ""))


@dataclass
class Disclosure:
    """When a term gives an entity away.

    `disclosed`: a term is risky if it gives so much of the entity's information -log p(e): if the pointwise mutual
    information log(p(e | t) / p(e)) is at least that share of it, that is p(e | t) >= p(e) ** (1 - disclosed).
    `evidence`: so many texts must have both; a text in which the term stands within `near` code points of the
    entity counts twice. `general`: letters of a word that may stay if what begins with them is in so many rows
    that it discloses less than that; shorter words than `least_general` are removed in any case.
    """

    disclosed: float = 0.9
    evidence: int = 2
    near: int = 60
    general: int = 3
    least_general: int = 6


def disclosing_terms(corpus: DataFrame, copies: DataFrame, found: DataFrame, words: DataFrame, written: Written, d: Disclosure) -> DataFrame:
    """(kind, value, term, general): terms of texts with an entity that reveal it, and whether their beginning may stay.

    n(t), n(e) and n(e, t) count different texts of the whole corpus, whole texts each. Entities of one text only
    have no pairs but with what stands near them; pairs of other entities are made after terms that too many
    texts have fell out. Only terms that pass among the texts with entities are counted in all the others.
    """
    entity = ["kind", "value"]
    texts = corpus.agg(F.count_distinct("key")).first()[0] or 1
    held = found.select("key", *entity).distinct()
    rows = held.join(copies, "key").groupBy(*entity).agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    rows = written.table(rows.withColumn("room", F.pow(F.lit(float(texts)) / F.col("n"), F.lit(1 - d.disclosed))), "entities")

    width = 2 * d.near
    spots = found.withColumn("bin", F.explode(F.sequence(F.expr(f"(start - {d.near}) div {width}"), F.expr(f"(end + {d.near}) div {width}"))))
    placed = words.select("key", F.expr(f"start div {width}").alias("bin"), F.col("start").alias("s"), F.col("end").alias("e"), "term")
    close = spots.join(placed, ["key", "bin"]).where(f"(e <= start AND e > start - {d.near}) OR (s >= end AND s < end + {d.near})")
    close = written.table(close.select(*entity, "term", "key").distinct().groupBy(*entity, "term").agg(F.count("*").alias("close")), "close")

    local = written.table(words.select("term", "key").distinct(), "local")
    here = local.groupBy("term").agg(F.count("*").alias("here"))
    often = held.join(rows.where("n > 1").withColumn("most", F.col("n") * F.col("room")), entity)
    most = often.groupBy("key").agg(F.max("most").alias("limit"))
    rare = local.join(most, "key").join(here, "term").where("here <= limit").select("key", "term", "here")
    pairs = often.join(rare, "key").where("here <= most").groupBy(*entity, "term").agg(F.count("*").alias("both"))
    pairs = pairs.join(close, [*entity, "term"], "left").select(*entity, "term", "both", F.coalesce("close", F.lit(0)).alias("close"))
    pairs = pairs.unionByName(close.join(rows.where("n = 1").select(*entity), entity).select(*entity, "term", F.lit(1).cast("long").alias("both"), "close"))
    pairs = pairs.where(F.col("both") + F.col("close") >= d.evidence).join(here, "term").join(rows, entity).where("here <= both * room")
    risky = written.table(pairs.select(*entity, "term", "both", "room", "rows"), "risky")

    terms = small(risky.select("term").distinct(), SMALL_TERMS)
    spread = corpus.select("key", F.explode(F.split("text", SPACE)).alias("word")).where("word != ''")
    everywhere = spread.select("key", term_of(F.col("word")).alias("term")).join(terms, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("all"))
    risky = written.table(risky.join(everywhere, "term").where("all <= both * room").drop("both"), "disclosing")

    begin = F.substring("term", 1, d.general)
    begins = risky.where(F.length("term") >= d.least_general).select(begin.alias("begin")).distinct()
    of_row = F.array_distinct(F.transform(F.split("text", SPACE), lambda w: F.substring(term_of(w), 1, d.general)))
    common = corpus.select(F.explode(of_row).alias("begin")).groupBy("begin").agg(F.count("*").alias("having")).join(small(begins, SMALL_TERMS), "begin")
    wide = (F.length("term") >= d.least_general) & (F.coalesce("having", F.lit(0)) > F.col("rows") * F.col("room"))
    return risky.withColumn("begin", begin).join(common, "begin", "left").select(*entity, "term", wide.alias("general"))


def find_personal_data(docs: DataFrame, disclosure: Disclosure | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the different texts of `docs` that hold personal data (key, text), and their spans (key, kind, start, end).

    key is the MD5 of the text, so copies are looked at once. Spans are those of PATTERNS and all words of a text
    that give away an entity of that text: of kind `general` if their first letters may stay, else of kind
    `term`. Positions are code points, the end exclusive. Null texts count as empty; repeated rows have one entry;
    spans of several kinds may overlap; a very long text is split into words like others; empty tables give
    no rows. No other column than text is looked at.
    """
    d = disclosure or Disclosure()
    written = Written(docs.sparkSession, "personal")
    corpus = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    marked = reduce(lambda a, b: a | b, [F.col("text").rlike(m) for m in MARKS.values()])
    texts = corpus.where(marked).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = written.table(pattern_spans(texts), "found")
    texts = written.table(texts.join(found.select("key").distinct(), "key", "left_semi"), "texts")
    words = written.table(words_of(texts), "words")
    risky = disclosing_terms(corpus, texts.select("key", "copies"), found, words, written, d)
    here = found.select("key", "kind", "value").distinct().join(risky, ["kind", "value"]).groupBy("key", "term").agg(F.bool_and("general").alias("general"))
    terms = words.join(here, ["key", "term"]).select("key", F.when(F.col("general"), "general").otherwise("term").alias("kind"), "start", "end")
    spans = written.table(found.select("key", "kind", "start", "end").unionByName(terms), "spans")
    written.drop_others("texts", "spans")
    return texts.select("key", "text"), spans


def sanitise(docs: DataFrame, disclosure: Disclosure | None = None) -> DataFrame:
    """`docs` without the personal data in `text`; all columns stay, whatever their names.

    Spans are replaced by their kind in brackets, those of kind `general` by their first letters and a star. Spans
    that overlap an earlier one are part of it. Texts without personal data stay as they are, null ones too.
    """
    d = disclosure or Disclosure()
    texts, spans = find_personal_data(docs, d)
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).where("start >= seen")
    lists = apart.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "seen", "end", "kind"))).alias("cuts"))
    cut = lambda a, n: F.substring("text", (a + 1).cast("int"), n.cast("int"))
    said = lambda c: F.when(c["kind"] == "general", F.regexp_replace(cut(c["start"], c["end"] - c["start"]), rf"^([^\p{{L}}]*+.{{{d.general}}}).*?([^\p{{L}}]*+)$", "$1*$2")).otherwise(F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]")))
    piece = lambda c: F.concat(cut(c["seen"], c["start"] - c["seen"]), said(c))
    rest = F.substring("text", (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length("text"))
    cleaned = texts.join(lists, "key").select("key", F.concat(F.array_join(F.transform("cuts", piece), ""), rest).alias("clean"))
    return docs.join(cleaned, F.md5(docs["text"]) == cleaned["key"], "left").select(*[F.coalesce(cleaned["clean"], docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns])


def op8_disclosure(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, spans = find_personal_data(docs)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind")))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    by_text = spans.groupBy("key").agg(*counts, listed.alias("s"))
    by_text = by_text.select("key", *[f"n_{k}" for k in KINDS], F.sha2(said(F.filter("s", lambda x: x["order"] <= len(PATTERNS))), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    zero = F.lit(0).cast("long")
    return keyed.join(by_text, "key", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in PATTERNS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[len(PATTERNS):]]
    )
