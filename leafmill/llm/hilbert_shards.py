"""Shards along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Written, in_order, small, with_offsets

#: A table of groups of equal texts of no more rows is broadcast.
SMALL_GROUPS = 500_000


def quantise_category(value: Column, bits: int) -> Column:
    """A cell of 0 .. 2**bits - 1 for a category, by its CRC-32; null shares the cell of the empty string."""
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(1 << bits)).cast("int")


def quantise_size(value: Column, bits: int) -> Column:
    """A cell for a size: its binary logarithm, in steps that use the whole range up to 2**40."""
    steps = (1 << bits) - 1
    return F.least(F.lit(steps), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * (steps / 40.0))).cast("int")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve through len(cells) dimensions of `bits` bits each.

    Rotations are undone from the highest bit down, then the axes are Gray-coded and their bits
    interleaved. All of it is one expression over an array of the axes.
    """
    n, top = len(cells), 1 << (bits - 1)
    axes = F.array(*[c.cast("int") for c in cells])

    def replaced(x: Column, new: dict[int, Column]) -> Column:
        return F.array(*[new.get(i, x[i]) for i in range(n)])

    def undo(x: Column, q: int, i: int) -> Column:
        low = F.lit(q - 1)
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        flipped = replaced(x, {0: x[0].bitwiseXOR(low)})
        swapped = replaced(x, {0: x[0].bitwiseXOR(swap), i: x[i].bitwiseXOR(swap)} if i else {})
        return F.when(x[i].bitwiseAND(F.lit(q)) != 0, flipped).otherwise(swapped)

    def bind(value: Column, f) -> Column:
        """f(value) with value computed once: a one-element fold."""
        return F.aggregate(F.array(F.lit(0)), value, lambda x, _: f(x))

    for q in (top >> k for k in range(bits - 1)):
        for i in range(n):
            axes = bind(axes, lambda x, q=q, i=i: undo(x, q, i))
    gray = bind(axes, lambda x: F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [x[j] for j in range(i + 1)]) for i in range(n)]))

    def spread(x: Column) -> Column:
        flips = [F.when(x[n - 1].bitwiseAND(F.lit(top >> k)) != 0, F.lit((top >> k) - 1)).otherwise(F.lit(0)) for k in range(bits - 1)]
        turn = reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0))
        return F.array(*[x[i].bitwiseXOR(turn) for i in range(n)])

    def interleave(x: Column) -> Column:
        places = [(q, i) for q in range(bits - 1, -1, -1) for i in range(n)]
        parts = [F.shiftleft(F.shiftright(x[i], q).bitwiseAND(F.lit(1)).cast("long"), len(places) - 1 - k) for k, (q, i) in enumerate(places)]
        return reduce(lambda a, b: a + b, parts)

    return F.aggregate(F.array(F.lit(0)), bind(gray, spread), lambda x, _: x, interleave)


def shard_by_hilbert(docs: DataFrame, cells: list[Column], bits: int, ties: list[Column], shards: int, columns: list[str]) -> DataFrame:
    """`columns` of `docs`, cut along the curve into `shards` runs whose row counts differ by one at most.

    Returns `columns`, hilbert (long), shard (int) and slot (long, gapless from 0 in each shard). Rows
    are sorted by the curve index, then by `ties`; rows alike in all of them may change places among
    themselves. Nulls sort first and share a cell with the empty string; an empty table gives no rows.
    Text columns need not be carried: only `columns` and the keys are shuffled.
    """
    written = Written(docs.sparkSession, "shards")
    keyed = docs.select(*columns, hilbert_index(cells, bits).alias("hilbert"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])
    placed = in_order(keyed, [F.col("hilbert"), *[F.col(f"_t{i}") for i in range(len(ties))]], written, "sorted")
    ranked = with_offsets(placed, F.lit(1), "_n").withColumn("_rank", F.col("_n_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"_rank * {shards} div _n_all")
    first = F.expr(f"(shard * _n_all + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(*columns, "hilbert", "shard", (F.col("_rank") - first).alias("slot"))


#: Columns that sharding adds.
RESULT = ["size", "text_crc32", "hilbert", "shard", "slot"]


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Shards of a table of documents by source, language and text size; the law is `rows`.

    Rows of equal texts count as of their least source and language, so they lie side by side on the curve; only a
    cut may part them, since no shard may have two rows more than another. Every column may be null: a null
    text has size 1 and the checksum of the empty text. Repeated rows get slots of their own; long texts are
    only measured, unless they are kept; an empty table gives no rows. Columns of `keep` may have any names: one that is
    called like a column of RESULT, in any case, gives way to it.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    sized = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("lang").alias("_lang"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_text"))
    groups = sized.groupBy("_text").agg(F.min("_source").alias("_s"), F.min("_lang").alias("_l"), F.count("*").alias("_n")).where("_n > 1")
    sized = sized.join(small(groups, SMALL_GROUPS), "_text", "left")
    of_group = lambda a, b: F.when(F.col("_n").isNull(), F.col(a)).otherwise(F.col(b))
    cells = [quantise_category(of_group("_source", "_s"), bits), quantise_category(of_group("_lang", "_l"), bits), quantise_size(F.col("size"), bits)]
    ties = [F.col("text_crc32"), F.col("size"), F.xxhash64(F.col("_id")), F.col("_id")]
    placed = shard_by_hilbert(sized, cells, bits, ties, shards, ["_row", "size", "text_crc32"])
    return placed.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in RESULT], *RESULT)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard as a folder of its own, in the order of its slots, so that readers that filter by what the curve is made of skip shards and parts of files.

    An empty table gives an empty folder. A folder that is there already is an error.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_hilbert(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
