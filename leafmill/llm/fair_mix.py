"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE_WORD, Written, in_order, running_total, small

#: A table of sources of no more rows than this is broadcast; beyond it, Spark joins by shuffling.
SMALL_SOURCES = 100_000
#: The same for a table of ids and copies.
SMALL_DOCS = 500_000


def count_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(SPACE_WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: Column, epochs: int, written: Written) -> DataFrame:
    """Targets for (source, source_size), which share the sum of all sizes by weight.

    A target stops at `epochs` times its source's size, and the excess goes to the others by weight
    until none is above. With sources by size for each unit of weight, the common level is the first at
    which what is left, divided by the weights that are left, fits the next source. Adds weight, target, start
    (sizes of the sources before it), ordinal. Both orders are made by range, so sources need not fit a task.
    """
    placed = in_order(sizes, [F.col("source").asc_nulls_last()], written, "by-source").withColumn("one", F.lit(1))
    placed = running_total(placed, "one", "ordinal")
    placed = running_total(placed, "source_size", "start").withColumn("start", F.col("start") - F.col("source_size"))
    s = placed.select("source", "source_size", F.col("ordinal").cast("int").alias("ordinal"), "start").withColumn("weight", weights.cast("double"))
    s = s.withColumns({"cap": F.col("source_size") * epochs, "full_at": F.col("source_size") * epochs / F.col("weight")})
    placed = in_order(s, [F.col("full_at"), F.col("ordinal")], written, "by-level")
    whole, weight = (x or 0 for x in placed.agg(F.sum("source_size"), F.sum("weight")).first())
    s = running_total(running_total(placed, "cap", "caps"), "weight", "weights")
    s = s.withColumn("level", (F.lit(whole) - F.col("caps") + F.col("cap")) / (F.lit(float(weight)) - F.col("weights") + F.col("weight")))
    fits = s.agg(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level")))).first()[0]
    return s.select("source", "source_size", "weight", "ordinal", "start", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(fits or 0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: Column, epochs: int = 3, seed: str = "") -> DataFrame:
    """How many copies of each row of `docs` (doc_id, source, size) the mix takes: adds source_size, target, copies.

    `weights` is a column over `ordinal`, the place of a source by code point with null last. In each
    source, rows are shuffled by the MD5 of seed and doc_id and queued `epochs` times over; the virtual
    finish time of an entry is the source's words up to it, divided by the source's weight. All entries
    are range-sorted by it and taken until the sum of all sizes is reached; ties go by source, epoch and place.
    Rows of size 0 take nothing away. Null ids count as empty; rows alike in id and size may change places. The
    same rows give the same mix. An empty table gives no rows. Other columns of `docs` are kept, whatever their
    names, but those of the added ones are replaced.
    """
    spark = docs.sparkSession
    written = Written(spark, "mix")
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    own = ["doc_id", "source", "size"]
    inner = {c: c if c in own else f"_c{i}" for i, c in enumerate(kept)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    queued = in_order(docs.withColumn("_key", key), [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")], written, "queues")
    sizes = queued.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written.table(source_targets(sizes, weights, epochs, written), "sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0

    total = running_total(queued, "size", "_total").drop("_part")
    shares = small(sources.withColumnRenamed("source", "_source"), SMALL_SOURCES)
    queued = total.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("_total") - F.col("start")) / F.col("weight")

    entries = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    entries = entries.select(finish(F.col("epoch")).alias("finish"), "ordinal", "epoch", F.col("_at").alias("entry"), "size")
    entries = in_order(entries, [F.col(c) for c in ("finish", "ordinal", "epoch", "entry")], written, "entries")
    last = running_total(entries, "size", "spent").where(F.col("spent") <= budget).agg(F.max(F.struct("finish", "ordinal", "epoch", "entry")).alias("last")).first()[0]
    written.drop_others("queues", "sources")
    if last is None:
        copies = F.lit(0)
    else:
        bound = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("ordinal", "int"), ("epoch", "int"), ("entry", "long"))])
        copies = sum((F.struct(finish(F.lit(e)).alias("finish"), F.col("ordinal"), F.lit(e).alias("epoch"), F.col("_at").alias("entry")) <= bound).cast("int") for e in range(epochs))
    return queued.select(*[F.col(n).alias(c) for c, n in inner.items()], "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: Column, epochs: int = 3) -> DataFrame:
    """`docs` (doc_id, source, text) with each row as often as the mix takes it; all columns stay.

    Only ids, sources and sizes are sorted, and the number of copies is joined back. Rows alike in id, text
    and source are taken equally often.
    """
    light = docs.select("doc_id", F.hash("text").alias("mark"), "source", count_words(F.col("text")).alias("size"))
    light = light.groupBy("doc_id", "mark", "source").agg(F.sum("size").alias("size"))
    taken = mix_sources(light, weights, epochs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("source").alias("_source"), "copies")
    taken = small(taken, SMALL_DOCS)
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & (F.hash(docs["text"]) == taken["_mark"]) & docs["source"].eqNullSafe(taken["_source"])
    each = F.explode(F.sequence(F.lit(1), taken["copies"])).alias("_copy")
    numbered = docs.join(taken, same).select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)], each)
    return numbered.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_weights() -> Column:
    return F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (F.col("ordinal") - 1) % 3 + 1)


def op7_fair_queue(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    mixed = mix_sources(docs, op7_weights())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ordinal FROM s0
), s2 AS (
  SELECT *, CAST(CASE (ordinal - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s1
), s3 AS (
  SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS full_at FROM s2
), s4 AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY full_at, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s3
), s5 AS (
  SELECT *, (SELECT max(level) FROM s4 WHERE level <= full_at) AS fits FROM s4
), s AS (
  SELECT *, least(CAST(cap AS DOUBLE), weight * fits) AS target FROM s5
), q AS (
  SELECT d.doc_id, d.size, s.ordinal, s.source_size, s.weight, s.target, row_number() OVER (ORDER BY d.source ASC NULLS LAST, k, doc_id, size) AS entry,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), e AS (
  SELECT entry, size, sum(size) OVER (ORDER BY CAST(epoch * source_size + cum AS DOUBLE) / weight, ordinal, epoch, entry ROWS UNBOUNDED PRECEDING) AS spent
  FROM q, (VALUES (0), (1), (2)) AS t(epoch)
), c AS (
  SELECT entry, CAST(sum(size) AS BIGINT) AS taken FROM e WHERE spent <= (SELECT sum(size) FROM d) GROUP BY entry
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN c USING (entry)
"""
