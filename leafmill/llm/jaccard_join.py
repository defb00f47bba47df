"""Similarity join of documents by the Jaccard index of their word shingles.

Size-aware: all sets that can be similar share tokens among the first few of a common order. Small sets
enumerate the pairs of those tokens and meet under a common pair; large sets scan the inverted lists of
single tokens. Where one way becomes cheaper than the other follows from the corpus. Who meets in a list is
compared by a sketch that never tells similar sets apart; what is left is verified set against set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, free_shuffles, give_back, small, task, text_bytes
from leafmill.llm.components import connected_components
from leafmill.llm.hashing import Hashes, mixed, pack, unpack

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text that a task works on at a time; packed bytes of one bucket; counters of the frequency sketch.
BLOCK_BYTES, BUCKET_BYTES, CELL_BITS, CHUNKS = 1 << 20, 8 << 20, 21, 16
#: Sets with one key in a block, from which on they are told apart from the rest of its list.
HOT_IN_BLOCK = 32
#: A table of ids of no more rows is broadcast.
SMALL_IDS = 500_000
#: Sets, and shingles of sets, of a group that meet in one place; larger groups are cut into parts that meet part by part.
PART_SETS, PART_SHINGLES = 512, 1 << 18
#: Sets of a group in parts that are sent to each of its parts.
PIVOTS = 16


def shingle_sets(texts: list[bytes], k: int):
    """The distinct shingles of each text as sorted 64-bit hashes, one after the other, and where each begins."""
    import numpy as np

    words = [t.translate(LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    hashes = Hashes(np.frombuffer(b" ".join(flat), np.uint8))
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    first = np.repeat(np.cumsum(counts) - counts, shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.minimum(counts[doc], k) - 1
    h = hashes.of(begins[first], ends[last]) if len(doc) else np.zeros(0, np.uint64)
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def node_of(hashes) -> int:
    """A number for a set of shingles: 63 bits of BLAKE2 over its sorted hashes."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def parity_sketch(hashes) -> bytes:
    """For each of 2**b cells, at least three for each shingle, whether an odd number of shingles falls into it.

    Two sketches differ in no more cells than the sets differ in shingles.
    """
    import numpy as np

    cells = 64
    while cells < 3 * len(hashes):
        cells *= 2
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Several parity sketches; those of more cells are folded onto those of fewer."""

    def __init__(self, data: list[bytes]):
        import numpy as np

        self.words = np.frombuffer(b"".join(data), np.uint64)
        self.width = np.fromiter(map(len, data), np.int64, len(data)) // 8
        self.begin = np.cumsum(self.width) - self.width

    def folded(self, at, width: int, to: int):
        import numpy as np

        x = self.words[self.begin[at][:, None] + np.arange(width)]
        while width > to:
            width //= 2
            x = x[:, :width] ^ x[:, width:]
        return x

    def apart(self, p, q):
        """In how many cells the sketches at p and q (arrays of places) differ."""
        import numpy as np

        out = np.zeros(len(p), np.int64)
        both = self.width[p] << 32 | self.width[q]
        for code in np.unique(both):
            rows, wide = np.flatnonzero(both == code), (int(code) >> 32, int(code) & 0xFFFFFFFF)
            for part in np.array_split(rows, -(-len(rows) * max(wide) // (1 << 19))):
                differ = self.folded(p[part], wide[0], min(wide)) ^ self.folded(q[part], wide[1], min(wide))
                out[part] = np.bitwise_count(differ).sum(1, dtype=np.int64)
        return out


def blocks(batches: Iterator, limit: int) -> Iterator[tuple[list, list, list[bytes]]]:
    """Rows (doc, mark, text) of Arrow batches in blocks of about `limit` bytes of text."""
    docs, marks, texts, size = [], [], [], 0
    for batch in batches:
        for d, m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            docs.append(d)
            marks.append(m)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield docs, marks, texts
                docs, marks, texts, size = [], [], [], 0
    if docs:
        yield docs, marks, texts


def needed(n, percent: int):
    """The least overlap of a set of n with any similar set."""
    return -(-n * percent // 100)


def most_apart(n, m, percent: int):
    """In how many shingles similar sets of n and m can differ."""
    return n + m - 2 * -(-(n + m) * percent // (100 + percent))


def _measure(k: int):
    """docs (doc, mark, text) to their set's size, number and sketch (once for equal sets of a block), and chunks of the frequency sketch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc", "mark", "n", "node", "sketch", "chunk", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for docs, marks, texts in blocks(batches, BLOCK_BYTES):
            h, cut = shingle_sets(texts, k)
            nodes = [node_of(h[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
            _, first = np.unique(np.array([-1 if x is None else x for x in nodes]), return_index=True)
            once = np.zeros(len(texts), bool)
            once[first] = True
            of_first = np.repeat(once, np.diff(cut))
            at, count = np.unique((h[of_first] >> np.uint64(64 - CELL_BITS)).astype(np.int64), return_counts=True)
            cells[at] += count.astype(np.uint32)
            sketches = [parity_sketch(h[a:b]) if o and b > a else None for a, b, o in zip(cut[:-1], cut[1:], once, strict=True)]
            none = [None] * len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([docs, marks, np.diff(cut), nodes, sketches, none, none], kinds, strict=True)], names=names)
        if cells.any():
            top = int(cells.max())
            cells = cells.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
            parts, none = [pack(count=p) for p in np.split(cells, CHUNKS)], [None] * CHUNKS
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none, none, none, none, none, range(CHUNKS), parts], kinds, strict=True)], names=names)

    return run


def frequencies(sketch: DataFrame):
    """(counters of the sketch as bytes, mean length of an inverted list among rare tokens).

    The sketch has a fixed number of counters over all shingles of all documents. Tokens are ordered by their
    counter, then by hash: a token that stands out from what shares its counter comes late, whatever its
    number. Among counters that do not stand out the variance over the mean is 1 if each token occurs once
    and grows with the length of their lists.
    """
    import numpy as np

    def add(key, table):
        import pyarrow as pa

        total = sum((unpack(b)["count"].astype(np.int64) for b in table.column("data").to_pylist()), np.int64(0))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    summed = sketch.select("chunk", "data").groupBy("chunk").applyInArrow(add, "chunk int, data binary").collect()
    if not summed:
        return bytes(4 << CELL_BITS), 1.0
    cells = np.concatenate([np.frombuffer(r["data"], np.int64) for r in sorted(summed, key=lambda r: r["chunk"])])
    rare = cells[cells <= 2 * cells.mean() + 8]
    counters = np.minimum(cells, (1 << 32) - 1).astype(np.uint32)
    return counters.tobytes(), max(1.0, float(rare.var() / rare.mean())) if rare.any() else 1.0


def boundary(list_length: float, percent: int) -> int:
    """The least size from which on scanning the lists of a set's tokens costs less than its pairs of tokens."""
    n = 1
    while True:
        one = n - needed(n, percent) + 1
        if (one + 1) * one / 2 > one * list_length:
            return n
        n += 1


def _post(shared, light: int, percent: int, k: int, buckets: int):
    """docs to packed postings by bucket of their key."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counters = np.frombuffer(shared.value, np.uint32)
        for _, _, texts in blocks(batches, BLOCK_BYTES):
            h, cut = shingle_sets(texts, k)
            nodes = np.array([node_of(h[a:b]) if b > a else 0 for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)
            size = np.diff(cut)
            once = np.zeros(len(texts), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            use = once & (size > 0) & (100 * size >= percent * (size + 1))  # smaller sets are similar to none but their equals
            doc = np.repeat(np.arange(len(texts)), size)
            h, doc = h[use[doc]], doc[use[doc]]
            by = np.lexsort((h, counters[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)], doc))
            h, doc = h[by], doc[by]
            begin = np.searchsorted(doc, np.arange(len(texts)))
            place = np.arange(len(h)) - begin[doc]
            single = size - needed(size, percent) + 1
            scans = (place < single[doc]) & (size[doc] >= needed(light, percent))
            keys, owners = [mixed(h[scans] * np.uint64(2) + np.uint64(1))], [doc[scans]]
            for d in np.flatnonzero(use & (size < light)):
                p = single[d] + 1
                i, j = np.triu_indices(p, 1)
                own = h[begin[d] : begin[d] + p]
                i, j = i[j < len(own)], j[j < len(own)]
                keys.append(mixed(own[i] * np.uint64(3) + mixed(own[j])))
                owners.append(np.full(len(i), d))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            _, number, count = np.unique(key, return_inverse=True, return_counts=True)
            hot = count[number] > HOT_IN_BLOCK
            told = np.zeros(len(key), bool)
            told[np.flatnonzero(hot)[np.unique(key[hot], return_index=True)[1]]] = True
            rows = []
            for kind, own, bucket in (("list", ~hot | told, key % np.uint64(buckets)), ("loose", hot & ~told, mixed(key + owner.astype(np.uint64)) % np.uint64(buckets))):
                own = np.flatnonzero(own)
                own = own[np.argsort(bucket[own], kind="stable")]
                edges = np.flatnonzero(np.diff(bucket[own], prepend=np.uint64(buckets), append=np.uint64(buckets)))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    i = own[a:b]
                    ds, local = np.unique(owner[i], return_inverse=True)
                    rows.append((kind, int(bucket[i[0]]), pack(nodes=nodes[ds], sizes=size[ds].astype(np.uint32), key=key[i], owner=local.astype(np.uint16 if len(ds) < 1 << 16 else np.uint32), told=np.packbits(told[i]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "data"])

    return run


def _lists(percent: int):
    """One bucket of postings to lists (g, node, n) of sets that share a key and have sizes in reach of each other.

    Keys with the same list give it once: g is then a hash of the list. Lists that were told apart in some
    block are in several buckets and keep their key.
    """

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        parts = []
        for p in map(unpack, table.column("data").to_pylist()):
            owner = p["owner"]
            parts.append((p["key"], p["nodes"][owner], p["sizes"][owner].astype(np.int64), np.unpackbits(p["told"])[: len(owner)].astype(bool)))
        k, node, n, told = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        by = np.lexsort((node, n, k))
        k, node, n, told = (x[by] for x in (k, node, n, told))
        group = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
        spread = (np.bincount(group, told)[group] > 0) | (key[0].as_py() == "loose")
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (node[1:] != node[:-1])])
        k, node, n, group, spread = (x[new] for x in (k, node, n, group, spread))
        near = (k[1:] == k[:-1]) & (n[:-1] * 100 >= percent * n[1:])
        keep = spread | np.concatenate([[False], near]) | np.concatenate([near, [False]])
        k, node, n, group, spread = (x[keep] for x in (k, node, n, group, spread))
        if len(k):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            with np.errstate(over="ignore"):
                sums = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
            k = np.where(spread, k, sums[of])
            first = np.zeros(len(starts), bool)
            first[np.unique(k[starts], return_index=True)[1]] = True
            own = first[of]
            k, node, n = k[own], node[own], n[own]
        give_back()
        return pa.table({"g": k.view(np.int64), "node": node, "n": n})

    return run


# ---- Groups that meet ------------------------------------------------------------------------------


def parts_of(rows: DataFrame) -> DataFrame:
    """(g, parts) for the groups of rows (g, node, n) that are too large to meet in one place."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    parts = F.greatest(F.ceil(F.col("c") / PART_SETS), F.ceil(F.col("w") / PART_SHINGLES)).cast("int")
    return sizes.select("g", parts.alias("parts")).where("parts > 1")


def _placed(rows: DataFrame, big: DataFrame) -> DataFrame:
    """rows with the number of parts of their group and their own part."""
    parted = rows.join(small(big, SMALL_IDS), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return parted.withColumn("part", F.pmod(F.hash("node"), "parts")).withColumn("label", F.col("node"))


MEETING = ["g", "i", "j", "side", "node", "n", "label"]


def own_meetings(rows: DataFrame, big: DataFrame) -> DataFrame:
    """Who meets whom first: each part of a group by itself, with a few sets of the group that come to all of its parts."""
    own = _placed(rows, big).withColumn("at", F.col("part"))
    if big.isEmpty():
        return own.withColumns({"i": F.col("at"), "j": F.col("at"), "side": F.lit(2)}).select(*MEETING)
    order = Window.partitionBy("g").orderBy(F.xxhash64("node"), "node")
    pivots = own.where("parts > 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS).drop("rank")
    pivots = pivots.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at != part")
    return own.unionByName(pivots).withColumns({"i": F.col("at"), "j": F.col("at"), "side": F.lit(2)}).select(*MEETING)


def open_meetings(rows: DataFrame, big: DataFrame, labels: DataFrame) -> DataFrame:
    """Who of groups in parts has still to meet: sets that are not linked with most of their group, and all of the group."""
    own = _placed(rows.join(small(big.select("g"), SMALL_IDS), "g", "left_semi"), big).drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = own.groupBy("g", "label").agg(F.count("*").alias("c"))
    most = by_label.groupBy("g").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"))
    most = most.select("g", F.col("most.label").alias("main"), (F.col("c") - F.col("most.c")).alias("rest"), "c").where("rest > 0")
    own = own.join(small(most, SMALL_IDS), "g").withColumn("asking", F.ceil(F.col("rest") * F.col("parts") / F.col("c")).cast("int"))
    ask = own.where("label != main").withColumns({"i": F.pmod(F.hash("node"), "asking"), "j": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "side": F.lit(0)})
    answer = own.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("asking") - 1)), "j": F.col("part"), "side": F.lit(1)})
    return ask.select(*MEETING).unionByName(answer.select(*MEETING))


def all_meetings(rows: DataFrame, big: DataFrame) -> DataFrame:
    """Each part of a group meets itself and each other part once."""
    own = _placed(rows, big).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    return own.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": side}).select(*MEETING)


def bucketed(meetings: DataFrame, bytes_each: float) -> DataFrame:
    """meetings with a bucket; those of one place (g, i, j) share it, and a bucket gets a bounded number of bytes."""
    total = (meetings.agg(F.sum("n")).first()[0] or 0) * bytes_each
    return meetings.withColumn("bucket", F.pmod(F.hash("g", "i", "j"), F.lit(max(48, int(total) // BUCKET_BYTES))))


class Places:
    """The rows of a bucket by place (g, i, j), in order of their sizes."""

    def __init__(self, table):
        import numpy as np

        g, i, j, side, node, n, label = (table.column(c).to_numpy() for c in MEETING)
        self.by = np.lexsort((node, n, j, i, g))
        g, i, j, self.side, self.node, self.n, label = (x[self.by] for x in (g, i, j, side, node, n.astype(np.int64), label))
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[: len(g)]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(g))
        self.component = np.unique(label, return_inverse=True)[1]

    def data(self, table) -> list[bytes]:
        found = table.column("data").to_pylist()
        return [found[i] for i in self.by.tolist()]

    def may(self, p, q, percent: int):
        """Whether rows at p and q, where the set at q is no smaller, can be linked and are not yet."""
        sides = (self.side[p] == 2) | (self.side[p] != self.side[q])
        return sides & (self.component[p] != self.component[q]) & (self.n[p] * 100 >= percent * self.n[q])

    def join(self, at, p: int, others) -> list[int]:
        """Ties the component of p with those of `others`, inside the rows `at`; returns one of `others` for each that is new."""
        out = []
        for q in others:
            if self.component[q] != self.component[p]:
                own = self.component[at]
                own[own == self.component[q]] = self.component[p]
                self.component[at] = own
                out.append(int(q))
        return out


def _links(ends: list[tuple[int, int]], node):
    """Pairs of places as an Arrow table of links (a, b, links)."""
    import numpy as np
    import pyarrow as pa

    pairs = np.array(ends, np.int64).reshape(-1, 2)
    a, b = node[pairs[:, 0]], node[pairs[:, 1]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "links": pa.nulls(len(a), pa.int64())})


def _compare_sketches(percent: int, few: int = 8):
    """One bucket of places to links that tie together all sets that their sketches do not tell apart."""

    def run(key, table):
        import numpy as np

        places = Places(table)
        sketches, n, found = Sketches(places.data(table)), places.n, []
        close = lambda p, q: sketches.apart(p, q) <= most_apart(n[p], n[q], percent)
        end = np.repeat(places.ends, places.ends - places.starts)
        in_few = np.repeat(places.ends - places.starts <= few, places.ends - places.starts)
        for step in range(1, few):
            p = np.flatnonzero(in_few & (np.arange(len(n)) + step < end))
            p = p[places.may(p, p + step, percent)]
            p = p[close(p, p + step)]
            found += zip(p.tolist(), (p + step).tolist(), strict=True)
        for a, b in zip(places.starts, places.ends, strict=True):
            for p in range(a, b) if b - a > few else ():
                q = np.arange(p + 1, b)
                q = q[places.may(np.full(len(q), p), q, percent)]
                if len(q):
                    found += [(p, x) for x in places.join(slice(a, b), p, q[close(np.full(len(q), p), q)])]
        out = _links(found, places.node)
        give_back()
        return out

    return run


def _compare_sets(percent: int, count: bool):
    """One bucket of places to links that tie together all similar sets, and with `count` the links of each set, weighed by `copies`."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        places = Places(table)
        sets = [np.frombuffer(d, np.uint64) for d in places.data(table)]
        copies = table.column("copies").to_numpy()[places.by] if count else None
        links, found = np.zeros(len(sets), np.int64), []
        for a, b in zip(places.starts, places.ends, strict=True):
            n, side = places.n[a:b], places.side[a:b]
            begins = np.cumsum(n) - n
            known, number = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
            marked = np.zeros(len(known), bool)
            for p in range(a, b):
                other = (side == 2) | (side != places.side[p])
                other[: p - a + 1] = False
                other &= n[p - a] * 100 >= percent * n
                if not count:
                    other &= places.component[a:b] != places.component[p]
                if not other.any():
                    continue
                own = number[begins[p - a] : begins[p - a] + n[p - a]]
                marked[own] = True
                common = np.add.reduceat(marked[number], begins, dtype=np.int64)
                marked[own] = False
                q = a + np.flatnonzero(other & (100 * common >= percent * (n[p - a] + n - common)))
                if count:
                    links[p] += copies[q].sum()
                    links[q] += copies[p]
                found += [(p, x) for x in places.join(slice(a, b), p, q)]
        out = _links(found, places.node)
        if count:
            own = np.flatnonzero(links)
            out = pa.concat_tables([out, pa.table({"a": places.node[own], "b": pa.nulls(len(own), pa.int64()), "links": links[own]})])
        give_back()
        return out

    return run


def linked(rows: DataFrame, compare: Callable[[DataFrame], DataFrame], written: Written, name: str) -> DataFrame:
    """(node, label) of the sets of rows (g, node, n) that links found in a group tie together.

    Parts of a group meet by themselves first. Sets of groups in parts that are in the same component then need
    not meet again; those that are not linked with most of their group meet all of it.
    """
    big = written.table(parts_of(rows), f"{name}-parts")
    links = written.table(compare(own_meetings(rows, big)), f"{name}-own")
    labels = connected_components(links, written, f"{name}-first")
    if not big.isEmpty():
        links = links.unionByName(written.table(compare(open_meetings(rows, big, labels)), f"{name}-open"))
        labels = connected_components(links, written, f"{name}-all")
    free_shuffles(written.spark)
    return labels


@dataclass
class Found:
    """rows: (doc, mark, n, node, label) and, if counted, n_links, for each row; null labels have no words."""

    rows: DataFrame
    written: Written


def find_groups(docs: DataFrame, percent: int, k: int, count: bool = False) -> Found:
    """The links of docs (doc_id, text); doc and mark are the id and the hash of the text.

    Rows of equal sets are one node. Postings of the first tokens, or pairs of them, are dealt out by key. The
    nodes of a list compare their sketches where they meet, and only links that tie components together leave
    that place. No similar sets are in different components then, so sets are read once for each node that
    has a partner, and verified where the parts of its component meet. With `count` all pairs of a component
    are; else only as long as something is left to tie together.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    written = Written(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("mark"), "text")
    measured = written.table(rows.mapInArrow(task(_measure(k)), "doc long, mark int, n long, node long, sketch binary, chunk int, data binary"), "measured")
    counters, list_length = frequencies(measured.where("chunk IS NOT NULL"))
    members = measured.where("chunk IS NULL").select("doc", "mark", "n", "node")
    light = boundary(list_length, percent)
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(48, total * (100 - percent) // 100 * 12 // BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(counters)
    posted = rows.mapInArrow(task(_post(shared, light, percent, k, buckets)), "kind string, bucket int, data binary")
    lists = written.table(posted.groupBy("kind", "bucket").applyInArrow(_lists(percent), "g long, node long, n long"), "lists")
    lists = written.table(lists.distinct(), "different")
    free_shuffles(spark)
    return join_lists(rows, members, measured.where("sketch IS NOT NULL").select("node", F.col("sketch").alias("data")), lists, percent, k, written, count)


def join_lists(rows: DataFrame, members: DataFrame, sketches: DataFrame, lists: DataFrame, percent: int, k: int, written: Written, count: bool = False) -> Found:
    """Groups of similar sets, if any two of them are in one of `lists` (g, node, n).

    rows are (doc, mark, text), members (doc, mark, n, node), sketches (node, data). Sets of a list meet by their
    sketches first; those that these tie together are read from the texts and verified set against set.
    """

    def by_sketch(meetings: DataFrame) -> DataFrame:
        met = bucketed(written.table(meetings, "meetings"), 0.6)
        own = sketches.join(small(met.select("node").distinct(), SMALL_IDS), "node", "left_semi").groupBy("node").agg(F.first("data").alias("data"))
        return met.join(own, "node").groupBy("bucket").applyInArrow(_compare_sketches(percent), "a long, b long, links long").select("a", "b").distinct()

    near = linked(lists, by_sketch, written, "near")
    nodes = members.join(near, "node").groupBy("node").agg(F.first("label").alias("g"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("doc", "mark")).alias("row"))
    nodes = written.table(nodes.select("node", "g", "n", "copies", "row.*"), "nodes")
    one = small(nodes.select(F.col("doc").alias("d"), F.col("mark").alias("m")), SMALL_IDS)
    twice = not members.join(one, members["doc"].eqNullSafe(F.col("d")) & (members["mark"] == F.col("m")), "left_semi").groupBy("doc", "mark").count().where("count > 1").isEmpty()

    def by_set(meetings: DataFrame) -> DataFrame:
        met = bucketed(written.table(meetings, "meetings"), 8)
        places = met.groupBy("node").agg(F.collect_list(F.struct("bucket", *[c for c in MEETING if c != "node"])).alias("places"))
        chosen = nodes.select("node", "copies", F.col("doc").alias("d"), F.col("mark").alias("m")).join(places, "node")
        texts = rows.join(small(chosen, SMALL_IDS), rows["doc"].eqNullSafe(F.col("d")) & (rows["mark"] == F.col("m")))
        sets = texts.select("node", "copies", "text", "places").mapInArrow(task(_sets(k)), "node long, copies long, data binary, " + f"places {dict(places.dtypes)['places']}")
        if twice:  # rows alike in id and text: one of them brings the set
            sets = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("copies", "data", "places")])
        sets = sets.select("node", "copies", "data", F.inline("places")).groupBy("bucket").applyInArrow(_compare_sets(percent, count), "a long, b long, links long")
        return sets if count else sets.select("a", "b").distinct()

    grouped = nodes.select("g", "node", "n")
    if count:
        big = written.table(parts_of(grouped), "sets-parts")
        verified = written.table(by_set(all_meetings(grouped, big)), "verified")
        labels = connected_components(verified.where("b IS NOT NULL").select("a", "b"), written, "sets")
        others = verified.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
        copies = members.where("n > 0").groupBy("node").agg(F.count("*").alias("copies"))
        count_of = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    else:
        labels = linked(grouped, by_set, written, "sets")
    out = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if count:
        out = out.join(count_of, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    found = written.table(out, "found")
    written.drop_others("found")
    return Found(found, written)


def _sets(k: int):
    """Rows (node, copies, text, places) to the set of the text, if it is that of the node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h, cut = shingle_sets(text_bytes(batch.column(2)), k)
            sets = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            own = pa.array([node_of(s) == x for s, x in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            out = [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out, names=["node", "copies", "data", "places"]).filter(own)

    return run


def similar_groups(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs (doc_id, text).

    Texts are lower-cased in A-Z and split at ASCII white space; a text's set are its distinct shingles of
    k words, or all its words if it has fewer. Two rows link if their sets have `percent` % of their union in
    common; component_id is the smallest doc_id that links reach, n_links the number of other rows that a row
    links with. Rows of equal sets link with each other and with the same others, so links are verified once for
    each pair of different sets and counted by the rows of both.

    Null and empty texts link with nothing; repeated rows are rows of their own; a very long text is read whole,
    its set goes to one task at a time. Ids are integers; a null id counts as no id: such rows link, but
    give no component_id to others. Other columns are not looked at. An empty table gives no rows.
    """
    grouped = find_groups(docs, percent, k, True).rows
    least = grouped.where("n > 0").groupBy("label").agg(F.min("doc").alias("component"))
    out = grouped.where("n > 0").join(least, "label").select("doc", "n", "component", "n_links").unionByName(grouped.where("n = 0").select("doc", "n", F.col("doc").alias("component"), "n_links"))
    kind = dict(docs.dtypes)["doc_id"]
    return out.select(F.col("doc").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").cast(kind).alias("component_id"), "n_links")


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row of each group of similar rows of `docs` (doc_id, text): that of the smallest id; all columns stay.

    Groups are those of `similar_groups`. Rows without words are in no group and stay. Of rows alike in id
    and text one stays. Columns of any other name are carried along.
    """
    grouped = find_groups(docs, percent, k).rows
    first = grouped.where("n > 0").groupBy("label").agg(F.min(F.struct("doc", "mark")).alias("row")).select("row.*")
    chosen = first.unionByName(grouped.where("n = 0").select("doc", "mark")).distinct()
    chosen = small(chosen, SMALL_IDS)
    kept = docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["doc"]) & (F.hash(docs["text"]) == chosen["mark"]), "left_semi")
    twice = grouped.groupBy("doc", "mark").count().where("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op2_size_aware(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op2_links(spark, sf_dir: str) -> DataFrame:
    """The same rows; n_links was not part of op2_size_aware at first."""
    return op2_size_aware(spark, sf_dir)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), c AS (
  SELECT x.r AS a, y.r AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r
), e AS (
  SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)
), edges AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(r, t) AS (
  SELECT r, r FROM d UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.t
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id, coalesce(max(l.n_links), 0) AS n_links
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN (SELECT a, count(*) AS n_links FROM edges GROUP BY a) l ON l.a = d.r
JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id
"""
