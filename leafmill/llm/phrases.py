"""Phrases whose words stand together more often than by chance, mined by dynamic itemset counting.

The texts lie in shards that are scanned in turn, over and over. A step scans one shard and counts phrases of all
lengths that are active: words from the start, a longer phrase from the step after both of its subphrases (all words
but the last, all but the first) have reached the threshold. A phrase that has been counted for one full cycle has its
exact count and leaves. It is over when nothing is active.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, free_shuffles, small, task, text_bytes
from leafmill.llm.hashing import Hashes, mixed

#: Bytes of a block of text; the least of a shard.
BLOCK, SHARD = 2 << 20, 32 << 20
#: A-Z lower-cased, ends of pieces a line feed, spaces and tabs a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
#: The least and the most bits of the hash that picks a phrase's cell.
BITS = 20, 28
#: The step of a phrase that has not reached the threshold.
NEVER = 255
#: A table of no more rows is broadcast.
SMALL = 200_000
STEP = "lang string, phrase string, k int, since int, count long"


def one_separator(x):
    """Bytes of plain text with one separator between words: a line feed where a piece ends, else a space; a line feed ends all."""
    import numpy as np

    gap = (x == 32) | (x == 10)
    first = gap & ~np.concatenate([[True], gap[:-1]])
    run = np.cumsum(first)
    ends = np.bincount(run[x == 10], minlength=int(run[-1]) + 1 if len(run) else 1) > 0
    out = x.copy()
    out[first] = np.where(ends[run[first]], 10, 32)
    out = out[~gap | first]
    if len(out) and out[-1] in (10, 32):
        out = out[:-1]
    return np.append(out, np.uint8(10)) if len(out) else out


def cut_at(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end where pieces end; a longer piece stays whole."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _packed(batches: Iterator) -> Iterator:
    """(lang, text) to blocks (number, lang, n, data) of plain texts of one lang; n is the number of words."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number, open_, sizes = TaskContext.get().partitionId(), {}, {}

    def block(lang):
        nonlocal number
        data = one_separator(np.frombuffer(b"\n".join(open_.pop(lang)), np.uint8))
        sizes.pop(lang)
        number += 1
        n = int(((data == 32) | (data == 10)).sum())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["number", "lang", "n", "data"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            for part in cut_at(text.translate(PLAIN), BLOCK):
                open_.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= BLOCK:
                    yield block(lang)
        for lang in [x for x in sizes if sum(sizes.values()) > 4 * BLOCK]:
            yield block(lang)
    for lang in list(open_):
        yield block(lang)


def salt(lang: str):
    """What tells the hashes of a language from those of others."""
    import hashlib

    import numpy as np

    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def different(keys):
    """(places, counts): one place of each different key, in the order of the keys, and how often it is there."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(keys)))


def texts_of(x, begins, ends, most: int = 32 << 20) -> Iterator:
    """(first, end, texts) for runs of the ranges [begin, end) of UTF-8 bytes x, as Arrow strings of about `most` bytes in all."""
    import numpy as np
    import pyarrow as pa

    sizes = ends - begins
    run = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(run)], strict=False):
        offsets = np.concatenate([[0], np.cumsum(sizes[a:z])]).astype(np.int32)
        kind = np.int32 if len(x) < 1 << 31 else np.int64
        at = np.arange(offsets[-1], dtype=kind)
        at += np.repeat((begins[a:z] - offsets[:-1]).astype(kind), sizes[a:z])
        yield a, z, pa.Array.from_buffers(pa.string(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(x[at])])


def _counted(shared, bits: int, step: int, shards: int, longest: int):
    """Blocks of a shard to the phrases active in this step, with the step since which they are, and their number in the block."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        reached = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, own = np.frombuffer(data, np.uint8), salt(lang)
                ends = np.flatnonzero((x == 32) | (x == 10))
                begins = np.concatenate([[0], ends[:-1] + 1])
                last = x[ends] == 10
                hashes, at = Hashes(x), np.arange(len(ends))
                since = np.zeros(len(at), np.uint8)
                for k in range(1, longest + 1):
                    h = mixed(hashes.of(begins[at], ends[at + k - 1]) ^ own)
                    active = (since <= step) & (since.astype(np.int64) + shards > step)
                    first, count = different(h[active])
                    place, from_ = at[active][first], since[active][first].astype(np.int32)
                    for a, z, phrases in texts_of(x, begins[place], ends[place + k - 1]):
                        arrays = [pa.repeat(pa.scalar(lang, pa.string()), z - a), phrases, pa.repeat(pa.scalar(k, pa.int32()), z - a), pa.array(from_[a:z]), pa.array(count[a:z])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "k", "since", "count"])
                    if k == longest:
                        break
                    when = np.full(len(ends) + 1, NEVER, np.uint8)
                    # no earlier than the parts of this phrase: a cell that it shares may have been reached before a block could get to it
                    when[at] = np.maximum(reached[h >> np.uint64(64 - bits)], since)
                    at = at[(when[at] != NEVER) & (when[np.minimum(at + 1, len(ends))] != NEVER) & ~last[at]]
                    at = at[at + k < len(ends)]
                    since = np.maximum(when[at], when[at + 1])

    return run


def _cells(bits: int, chunk: int):
    """(lang, phrase) to bit maps of the cells of their hashes, by chunk of 2**chunk cells."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            phrases = text_bytes(batch.column(1))
            if phrases:
                sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
                ends = np.cumsum(sizes)
                langs = batch.column(0).to_pylist()
                salts = {x: salt(x) for x in set(langs)}
                h = mixed(Hashes(np.frombuffer(b"".join(phrases), np.uint8)).of(ends - sizes, ends) ^ np.array([salts[x] for x in langs], np.uint64))
                seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        parts = [(i, p) for i, p in enumerate(np.split(seen, 1 << (bits - chunk))) if p.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([np.packbits(p).tobytes() for _, p in parts], pa.binary())], names=["chunk", "data"])

    return run


def _either(key, table):
    import numpy as np
    import pyarrow as pa

    maps = [np.frombuffer(b, np.uint8) for b in table.column("data").to_pylist()]
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([reduce(np.bitwise_or, maps).tobytes()], pa.binary())})


def frequent(docs: DataFrame, least: int, longest: int, shards: int, written: Written) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text) to (lang, phrase, k, count) of all phrases of `least` or more places, and (lang, n) with the number of words.

    Which phrases have reached the threshold, and in which step, is sent to the tasks as a table of one byte for
    each of 2**bits cells of a hash; there are a few cells for 16 words of the corpus, between 2**20 and 2**28. Phrases that
    share a cell may become active too early or without need, but none before all its parts; they are counted for a full
    cycle and dropped if rare, so the result does not depend on it. The bit maps that come back to the driver have that same size.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = written.table(docs.mapInArrow(task(_packed), "number long, lang string, n long, data binary").withColumn("slice", F.pmod("number", F.lit(shards)).cast("int")), "blocks", "slice")
    size = blocks.agg(F.sum("n"), F.sum(F.octet_length("data")), F.count("*")).first()
    shards = min(shards, max(1, (size[1] or 0) // SHARD))
    words = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    bits = min(BITS[1], max(BITS[0], ((size[0] or 1) // 16).bit_length()))
    chunk = min(bits, 20)
    reached = np.full(1 << bits, NEVER, np.uint8)
    carried, done, step, latest = None, [], 0, 0
    while step < latest + shards:
        shared = spark.sparkContext.broadcast(reached.tobytes())
        part = blocks.where(F.pmod("slice", F.lit(shards)) == step % shards).select("lang", "data")
        counts = part.mapInArrow(task(_counted(shared, bits, step, shards, longest)), STEP)
        counts = counts if carried is None else carried.unionByName(counts)
        totals = written.table(counts.groupBy("lang", "phrase", "k", "since").agg(F.sum("count").alias("count")), f"totals-{step}")
        often = totals.where((F.col("count") >= least) & (F.col("k") < longest)).select("lang", "phrase")
        maps = often.mapInArrow(task(_cells(bits, chunk)), "chunk int, data binary").groupBy("chunk").applyInArrow(_either, "chunk int, data binary").collect()
        for r in maps:
            own = reached[r["chunk"] << chunk : (r["chunk"] + 1) << chunk]
            new = (own == NEVER) & np.unpackbits(np.frombuffer(r["data"], np.uint8)).astype(bool)
            own[new] = step + 1
            latest = step + 1 if new.any() else latest
        shared.unpersist()
        over = F.col("since") + shards <= step + 1
        done.append(written.table(totals.where(over & (F.col("count") >= least)).select("lang", "phrase", "k", "count"), f"done-{step}"))
        carried = totals.where(~over)
        if step:
            written.drop(f"totals-{step - 1}")
        free_shuffles(spark)
        step += 1
    return reduce(DataFrame.unionByName, done), words


def _parts(k: Column) -> Column:
    """(begin, length) of the contiguous parts of two or more of k words that are shorter than k; k is at least 3."""
    return F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda b: F.struct(b.alias("b"), n.alias("n")))))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, shards: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of docs (lang, text) for each lang.

    Texts are lower-cased in A-Z and end a piece at `.,;:!?` and line ends; words of a piece stand between spaces and
    tabs. A phrase is 2 to `longest` words in a row within a piece that occur `least` times or more, overlaps included.
    Of its cuts into two, with l and r places of the parts, the one of least floor(1000 * a * n / (l * r)) counts, at ties
    the one after the fewest words. A phrase inside a longer one of at least `percent` % of its places is dropped. The
    first `top` of a lang by score, places and phrase stay.

    Null and empty texts have no words; null languages are `und`. Repeated rows count again. Very long texts are cut where
    pieces end and counted whole. An empty table gives no rows. Other columns are not looked at. Numbers are exact
    (decimals of 38 digits); phrases of one block of text are told apart by 64-bit hashes, those of the corpus by their words.
    """
    written = Written(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found, words = frequent(texts, least, longest, shards, written)
    found = written.table(found, "frequent")
    longer = found.where("k > 2").select("lang", F.split("phrase", " ").alias("w"), "count", F.explode(_parts(F.col("k"))).alias("p"))
    longer = longer.groupBy("lang", F.array_join(F.slice("w", F.col("p.b"), F.col("p.n")), " ").alias("phrase")).agg(F.max("count").alias("inside"))
    kept = found.where("k > 1").join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("inside") < F.lit(percent) * F.col("count"), F.lit(True)))
    w = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("count").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    known = small(written.table(found.where(F.col("k") < longest).select("lang", "phrase", "count"), "parts"), SMALL)
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(F.broadcast(words), "lang") if words.limit(SMALL + 1).count() <= SMALL else cuts.join(words, "lang")
    scored = scored.withColumns({"x": exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)"), "y": exact("l") * exact("r")}).withColumn("score", F.expr("x div y"))
    least_cut = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP11_SQL = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k)) GROUP BY lang, k, g HAVING count(*) >= 100
), c AS (
  SELECT lang, k, g, f AS a FROM f WHERE k > 1
), inside AS (
  SELECT lang, g[b : b + m - 1] AS g, max(a) AS most
  FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS b FROM c, range(2, 5) AS t(m) WHERE m < k) GROUP BY ALL
), s AS (
  SELECT c.lang, c.g, c.a, cut, x.f AS l, y.f AS r, n.n, CAST(1000::HUGEINT * c.a * n.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN inside USING (lang, g) WHERE coalesce(100 * most < 100 * a, TRUE)) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1 :] JOIN n ON n.lang = c.lang
), b AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
