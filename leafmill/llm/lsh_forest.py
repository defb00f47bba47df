"""Near-duplicates by a forest of MinHash signatures.

Each tree is an order: the different sets of shingles, sorted by a signature of several min-hashes of their own. Sets
that share a prefix of it are neighbours there, and a region of sets with a common prefix is a subtree. How long the
prefix has to be follows from the region: one min-hash where few sets share it, more where many unlike ones do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, free_shuffles, small, task
from leafmill.llm.jaccard_join import BLOCK_BYTES, SMALL_IDS, Found, blocks, join_lists, node_of, parity_sketch, shingle_sets

#: Trees; min-hashes of 32 bits in a signature; sets of a region that need no longer prefix.
TREES, DEPTH, REGION = 16, 6, 512


def _signed(k: int, trees: int, depth: int):
    """(doc, mark, text) to the size and number of each set, with sketch and signatures for one of equal sets of a block."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        factors = np.random.default_rng(13).integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
        names, kinds = ["doc", "mark", "n", "node", "sketch", "signature"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for docs, marks, texts in blocks(batches, BLOCK_BYTES):
            h, cut = shingle_sets(texts, k)
            nodes = [node_of(h[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
            once = np.zeros(len(texts), bool)
            once[np.unique(np.array([-1 if x is None else x for x in nodes]), return_index=True)[1]] = True
            once &= np.diff(cut) > 0
            own, at = h[np.repeat(once, np.diff(cut))], np.flatnonzero(once)
            size = np.diff(cut)[at]
            starts = np.cumsum(size) - size
            signs = np.empty((len(at), len(factors)), ">u4")
            with np.errstate(over="ignore"):
                for i, f in enumerate(factors if len(at) else ()):
                    signs[:, i] = np.minimum.reduceat(own * f, starts) >> np.uint64(32)
            sketches, signatures = [None] * len(texts), [None] * len(texts)
            for i, s in zip(at.tolist(), signs, strict=True):
                sketches[i], signatures[i] = parity_sketch(h[cut[i] : cut[i + 1]]), s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([docs, marks, np.diff(cut), nodes, sketches, signatures], kinds, strict=True)], names=names)

    return run


def _neighbours(batches: Iterator) -> Iterator:
    """Sorted rows (tree, sign, node, n) that share their first min-hash with the row before or after; the first and last row stay in any case."""
    import numpy as np
    import pyarrow as pa

    last, start, tied = None, True, False  # the row before, still open; whether it is the first of all; whether it is like the one before it
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if last is None else pa.concat_tables([last, rows])
        if len(rows) < 2:
            last = rows if len(rows) else last
            continue
        head = np.frombuffer(b"".join(s[:4] for s in rows["sign"].to_pylist()), ">u4").astype(np.int64) << 8 | rows["tree"].to_numpy()
        same = head[1:] == head[:-1]
        keep = np.concatenate([[start], same[:-1]]) | same
        keep[0] |= tied
        yield from rows.slice(0, len(rows) - 1).filter(pa.array(keep)).to_batches()
        last, start, tied = rows.slice(len(rows) - 1), False, bool(same[-1])
    if last is not None:
        yield from last.to_batches()


def prefix(depth: int) -> Column:
    return F.substring("sign", 1, 4 * depth)


def regions(near: DataFrame, depth: int, most: int, written: Written) -> DataFrame:
    """near (tree, sign, node, n) to lists (g, node, n) of sets with a common prefix.

    A region of more than `most` sets asks for one more min-hash, unless more than half of it would still be in one
    part: then it is a family of like sets, which a longer prefix would only tear apart.
    """
    lists, open_ = [], near
    for d in range(1, depth + 1):
        dense = None
        if d < depth:
            parts = open_.groupBy("tree", prefix(d).alias("p"), prefix(d + 1).alias("q")).agg(F.count("*").alias("c"))
            dense = parts.groupBy("tree", "p").agg(F.sum("c").alias("c"), F.max("c").alias("top")).where(f"c > {most} AND 2 * top <= c").select("tree", "p")
            dense = written.table(dense, f"dense-{d}")
            dense = None if dense.isEmpty() else dense
        rows = open_.withColumn("p", prefix(d))
        settled = rows if dense is None else rows.join(small(dense, SMALL_IDS), ["tree", "p"], "left_anti")
        lists.append(settled.select(F.xxhash64(F.lit(d), "tree", "p").alias("g"), "node", "n"))
        if dense is None:
            break
        open_ = written.table(rows.join(small(dense, SMALL_IDS), ["tree", "p"], "left_semi").drop("p"), f"open-{d}")
    lists = written.table(reduce(DataFrame.unionByName, lists), "regions")
    alike = lists.groupBy("g").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = alike.where("c > 1").groupBy("c", "x", "y").agg(F.min("g").alias("g")).select("g")
    return lists.join(small(written.table(chosen, "chosen"), SMALL_IDS), "g", "left_semi")


def find_neighbours(docs: DataFrame, percent: int, k: int, trees: int = TREES, depth: int = DEPTH, most: int = REGION) -> Found:
    """Groups of docs (doc_id, text) whose sets of k words meet in a region of some tree and are similar."""
    spark = docs.sparkSession
    bounded_batches(spark)
    written = Written(spark, "forest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("mark"), "text")
    signed = written.table(rows.mapInArrow(task(_signed(k, trees, depth)), "doc long, mark int, n long, node long, sketch binary, signature binary"), "signed")
    members = signed.select("doc", "mark", "n", "node")
    sets = signed.where("signature IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"), F.first("n").alias("n"))
    sets = written.table(sets, "sets")
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.substring(F.col("signature"), t * (4 * depth) + 1, F.lit(4 * depth)).alias("sign")))
    forest = sets.select("node", "n", F.inline(each)).select("tree", "sign", "node", "n")
    ordered = forest.repartitionByRange("tree", "sign", "node").sortWithinPartitions("tree", "sign", "node")
    near = written.table(ordered.mapInArrow(_neighbours, forest.schema), "near")
    free_shuffles(spark)
    lists = written.table(regions(near, depth, most, written), "lists")
    free_shuffles(spark)
    return join_lists(rows, members, signed.where("sketch IS NOT NULL").select("node", F.col("sketch").alias("data")), lists, percent, k, written)


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 3, trees: int = TREES, depth: int = DEPTH, most: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Texts are lower-cased in A-Z and split at ASCII white space; a text's set are its distinct shingles of k words, or
    all its words if it has fewer. Two rows link if their sets have `percent` % of their union in common, which is
    confirmed on the whole sets; component_id is the smallest doc_id that links reach, `kept` whether it is the row's own.

    Two sets of similarity s share a region of prefix d in one tree with probability s ** d. At 85 % and 16 trees a pair
    is in no common region with a probability of 7e-14 where prefixes are of one min-hash, of 1e-9 where they are of
    two; regions get longer prefixes only where more than `most` unlike sets meet.

    Null and empty texts have an empty set and link with nothing; repeated rows are rows of their own; a very long text
    is read whole, its set goes to one task at a time. Ids are integers; rows with a null id link, but give no
    component_id to others. Other columns are not looked at. An empty table gives no rows.
    """
    grouped = find_neighbours(docs, percent, k, trees, depth, most).rows
    least = grouped.where("n > 0").groupBy("label").agg(F.min("doc").alias("component"))
    out = grouped.where("n > 0").join(least, "label").select("doc", "n", "component").unionByName(grouped.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    kind = dict(docs.dtypes)["doc_id"]
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))


def op13_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i + 1 : i + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), c AS (
  SELECT x.r AS a, y.r AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r
), e AS (
  SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)
), edges AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(r, t) AS (
  SELECT r, r FROM d UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.t
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id
"""
