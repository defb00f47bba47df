"""Removal of repeated byte strings with suffix arrays built over a difference cover.

Equal strings of `width` bytes have the same minimal k-gram at the same place (its anchor). So the corpus
is dealt out by anchor: strings around different anchors never have to be compared, each part gets a
suffix array of its own, and no part needs more of a text than the bytes around its anchors. Contexts of
an anchor that are alike in full are settled by a hash of them and the smallest id, before anything is
sorted; the suffix arrays then hold only contexts that differ from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, free_shuffles, give_back, task, text_bytes
from leafmill.llm.hashing import Hashes, mixed, narrow, pack, runs_of, unpack

WIDTH, GRAM = 50, 24
#: Text that a task works on at a time, and packed anchors for one bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Text of the corpus for each bucket of contexts, about a quarter of which are contexts to sort.
TEXT_OF_BUCKET = 2 << 20
#: Text of a block of documents that meet their ranges.
TEXT_OF_BLOCK = 4 << 20
#: Different contexts of one anchor in a block, or in all, from which on they are compared string by string.
HOT_IN_BLOCK, HOT = 32, 4096
NO_ID = (1 << 63) - 1
PIECE = "kind string, bucket int, data binary"


# ---- Difference-cover suffix ranks ----------------------------------------------------------------


def names(columns: list):
    """Ranks of rows (columns of non-negative ints, first column first); equal rows share one."""
    import numpy as np

    code, top = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if top * width >= 1 << 62:
            code = ranked(code)
            top = int(code.max(initial=0)) + 1
        code, top = code * width + c, top * width
    return ranked(code)


def ranked(code):
    import numpy as np

    by = np.argsort(code)
    out = np.empty(len(code), np.int64)
    in_order = code[by]
    out[by] = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]]))[: len(code)]
    return out


def suffix_ranks(s, depth: int, wanted=None):
    """Ranks of all suffixes of the positive ints `s`, right for at least their first `depth` symbols.

    Suffixes that share a longer prefix may share a rank. Triples at the places i % 3 != 0 are sorted and
    named; their names form a shorter string, ranked in the same way unless they are all different or
    reach deep enough. The other suffixes are ranked by their first symbol and the rank after it, and
    merged with the sampled ones. With a mask `wanted`, only those places are merged and get a rank.
    """
    import numpy as np

    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    rank = np.zeros(n + 3, np.int64)
    if len(sample):
        named = names([t[sample], t[sample + 1], t[sample + 2]]) + 1
        if depth > 3 and named.max() < len(sample):
            # a zero keeps the strings of the two residues apart
            deeper = suffix_ranks(np.concatenate([named[: len(ones)], [0], named[len(ones) :]]), -(-depth // 3))
            named = np.concatenate([deeper[: len(ones)], deeper[len(ones) + 1 :]]) + 1
        rank[sample] = named
    rest = np.arange(0, n, 3)
    if wanted is not None:
        rest, ones, twos = rest[wanted[rest]], ones[wanted[ones]], twos[wanted[twos]]
    span, top = int(rank.max()) + 1, int(t.max()) + 1

    def by_one(i):
        return t[i] * span + rank[i + 1]

    if top * top * span < 1 << 62:

        def by_two(i):
            return (t[i] * top + t[i + 1]) * span + rank[i + 2]
    else:
        both = np.concatenate([rest, twos])
        pairs = np.zeros(n, np.int64)
        pairs[both] = names([t[both], t[both + 1]])

        def by_two(i):
            return pairs[i] * span + rank[i + 2]

    # in their own order, lookups of one residue among another run through memory once
    rest, ones, twos = rest[np.argsort(by_one(rest))], ones[np.argsort(rank[ones])], twos[np.argsort(rank[twos])]
    rest_one, rest_two = by_one(rest), by_two(rest)
    ones_one, twos_two = by_one(ones), by_two(twos)
    sampled = np.sort(np.concatenate([rank[ones], rank[twos]]))
    sorted_two = np.sort(rest_two)
    out = np.zeros(n, np.int64)
    out[rest] = np.searchsorted(rest_one, rest_one) + np.searchsorted(np.sort(ones_one), rest_one) + np.searchsorted(np.sort(twos_two), rest_two)
    out[ones] = np.searchsorted(sampled, rank[ones]) + np.searchsorted(rest_one, ones_one)
    out[twos] = np.searchsorted(sampled, rank[twos]) + np.searchsorted(sorted_two, twos_two)
    return out


def repeated_starts(contexts: list[bytes], starts, order, width: int):
    """Of each context's first starts[i] strings of `width` bytes, those that occur in a context of smaller order.

    Returns (context, start) arrays. Suffixes are put in order, and neighbours whose first `width` bytes
    agree form a class.
    """
    import numpy as np

    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    which = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin[which] + offset
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    by_rank = np.argsort(suffix_ranks(text.astype(np.int64) + 1, width, wanted)[at])
    at, which, offset = at[by_rank], which[by_rank], offset[by_rank]
    words = np.zeros(len(text), np.uint64)  # eight bytes from each place on
    for k in range(8):
        words[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(len(at) - 1, 0), bool)
    for d in [*range(0, width - 7, 8), width - 8]:
        w = words[at + d]
        same &= w[1:] == w[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])[: len(at)]
    least = np.full(int(group.max(initial=0)) + 1, NO_ID, np.int64)
    np.minimum.at(least, group, order[which])
    hit = order[which] > least[group]
    return which[hit], offset[hit]


# ---- Anchors of blocks of documents ---------------------------------------------------------------


def sliding(f, a, w: int):
    """f over each run of w neighbours, f being minimum or maximum."""
    size = 1
    while size * 2 <= w:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def anchors(text, ends, width: int, gram: int):
    """The runs of strings of `width` bytes with one anchor: arrays key, sign, first, last (starts), doc.

    `text` holds several documents that end at `ends`. A string's anchor is its leftmost minimal k-gram;
    `sign` hashes all bytes of a run's strings and the anchor's place among them.
    """
    import numpy as np

    none = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    if len(text) < width:
        return none, None
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    hashes = Hashes(text)
    g = hashes.grams(gram)
    w = width - gram + 1
    least = sliding(np.minimum, g, w)
    starts = np.flatnonzero(doc[: len(least)] == doc[width - 1 :])
    if not len(starts):
        return none, hashes
    used = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    used[w - 1 : w - 1 + len(least)] = least
    places = np.flatnonzero(sliding(np.maximum, used, w) == g)
    # the first place from each start on that holds its minimum
    j = np.searchsorted(places, starts)
    off = np.flatnonzero(g[places[j]] != least[starts])
    while len(off):
        j[off] += 1
        off = off[g[places[j[off]]] != least[starts[off]]]
    at = places[j]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last, place = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], at[new]
    with np.errstate(over="ignore"):
        sign = mixed(hashes.of(first, last + width) + (place - first).astype(np.uint64) * np.uint64(0x51ED270B) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return [g[place], sign, first, last, doc[first]], hashes


def block_of(ids, marks, blocks: int):
    """The block of a row, as `row_block` computes it in Spark."""
    import numpy as np

    return np.mod(np.fmod(ids, 1_000_003) + marks, blocks)


def by_block(kind: str, ids, marks, which, blocks: int, **arrays) -> Iterator[tuple]:
    """Entries of documents (`which`, with ids and marks), packed by the block of their document."""
    import numpy as np

    block = block_of(ids, marks.astype(np.int64), blocks)[which]
    by = np.argsort(block, kind="stable")
    for a, b in runs_of(block[by]):
        own = by[a:b]
        docs, local = np.unique(which[own], return_inverse=True)
        yield kind, int(block[own[0]]), pack(ids=ids[docs], marks=marks[docs], doc=local.astype(np.uint32), **{k: v[own] for k, v in arrays.items()})


def mark_rows(ids, marks, which, first, last, width: int, blocks: int) -> Iterator[tuple]:
    """Covered ranges by block: the strings that start at first .. last of documents."""
    import numpy as np

    which, lo, hi = united(which, first, last + width)
    yield from by_block("mark", ids, marks, which, blocks, lo=lo.astype(np.uint32), n=(hi - lo).astype(np.uint32))


def united(which, lo, hi):
    """Ranges of documents in order and without overlaps; ranges that touch become one."""
    import numpy as np

    if not len(lo):
        return which, lo, hi
    by = np.lexsort((lo, which))
    which, lo, hi = which[by].astype(np.int64), lo[by].astype(np.int64), hi[by].astype(np.int64)
    reach = np.maximum.accumulate((which << 40) + hi)
    new = np.flatnonzero(np.concatenate([[True], (which[1:] << 40) + lo[1:] > reach[:-1]]))
    return which[new], lo[new], reach[np.concatenate([new[1:], [len(lo)]]) - 1] - (which[new] << 40)


def smallest(sign, order):
    """For each entry the least order among those with its sign, and the sign's number."""
    import numpy as np

    if not len(sign):
        return order, np.zeros(0, np.int64)
    by = np.argsort(sign)
    new = np.concatenate([[True], sign[by][1:] != sign[by][:-1]])
    group = np.cumsum(new) - 1
    least, number = np.empty(len(sign), np.int64), np.empty(len(sign), np.int64)
    least[by] = np.minimum.reduceat(order[by], np.flatnonzero(new))[group]
    number[by] = group
    return least, number


def string_rows(sign, order, ids, marks, which, start, buckets: int, blocks: int, width: int) -> Iterator[tuple]:
    """Single strings, by bucket of their hash; those that a smaller id has in this block are marked here."""
    import numpy as np

    least, _ = smallest(sign, order)
    done = order > least
    yield from mark_rows(ids, marks, which[done], start[done], start[done], width, blocks)
    sign, which, start = sign[~done], which[~done], start[~done]
    bucket = (sign % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, b in runs_of(bucket[by]):
        own = by[a:b]
        docs, local = np.unique(which[own], return_inverse=True)
        yield "string", int(bucket[own[0]]), pack(ids=ids[docs], marks=marks[docs], sign=sign[own], doc=local.astype(np.uint32), start=start[own].astype(np.uint32))


def block_rows(texts: list[bytes], ids, marks, buckets: int, strings: int, blocks: int, width: int, gram: int) -> Iterator[tuple]:
    """What a block of documents sends: packed anchors by bucket, strings of hot anchors, ranges settled here."""
    import numpy as np

    ends = np.cumsum([len(t) for t in texts])
    begin = ends - [len(t) for t in texts]
    (key, sign, first, last, doc), hashes = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, width, gram)
    if not len(key):
        return
    order = ids[doc]
    least, _ = smallest(sign, order)
    done = order > least
    yield from mark_rows(ids, marks, doc[done], first[done] - begin[doc[done]], last[done] - begin[doc[done]], width, blocks)
    key, sign, first, last, doc = (a[~done] for a in (key, sign, first, last, doc))
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    hot = np.zeros(len(key), bool)
    if (count > HOT_IN_BLOCK).any():
        different = np.bincount(number[np.unique(sign, return_index=True)[1]], minlength=len(count))
        hot = different[number] > HOT_IN_BLOCK
    if hot.any():
        n = last[hot] - first[hot] + 1
        start = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = np.repeat(doc[hot], n)
        yield from string_rows(hashes.of(start, start + width), ids[d], ids, marks, d, start - begin[d], strings, blocks, width)
    sign = np.where(hot, np.uint64(0), sign)
    keep = ~hot
    keep[np.flatnonzero(hot)[np.unique(key[hot], return_index=True)[1]]] = True  # one of each hot anchor tells the others
    key, sign, first, last, doc = (a[keep] for a in (key, sign, first, last, doc))
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, b in runs_of(bucket[by]):
        own = by[a:b]
        docs, local = np.unique(doc[own], return_inverse=True)
        rest = key[own] // np.uint64(buckets)
        # 40 bits of the key beside its bucket and 48 of the sign; together they tell contexts apart
        yield "anchor", int(bucket[own[0]]), pack(
            ids=ids[docs], marks=marks[docs], low=(rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=((rest >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8),
            sign=(sign[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), more=((sign[own] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16), told=np.packbits(sign[own] == 0),
            doc=narrow(np.diff(local, prepend=0)), start=narrow(first[own] - begin[doc[own]]), n=narrow(last[own] - first[own]),
        )


def settle_anchors(pieces: list[bytes], blocks: int, width: int) -> Iterator[tuple]:
    """One bucket of anchors: marks ranges that a smaller id has alike, and asks for contexts that differ."""
    import numpy as np

    parts, at = [], 0
    for p in map(unpack, pieces):
        local = np.cumsum(p["doc"].astype(np.int64)) + at
        key = p["low"].astype(np.uint64) | p["high"].astype(np.uint64) << np.uint64(32)
        sign = p["sign"].astype(np.uint64) | p["more"].astype(np.uint64) << np.uint64(32)
        with np.errstate(over="ignore"):
            both = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sign)
        parts.append((p["ids"], p["marks"], key, both, np.unpackbits(p["told"])[: len(key)].astype(bool), local, p["start"].astype(np.int64), p["n"].astype(np.int64)))
        at += len(p["ids"])
    ids, marks, key, sign, told, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = ids[doc]
    least, number = smallest(sign, order)
    done = (order > least) & ~told
    yield from mark_rows(ids, marks, doc[done], start[done], start[done] + n[done], width, blocks)
    _, group = smallest(key, order)
    groups = int(group.max(initial=-1)) + 1
    one = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    one[number] = group  # a sign has one key
    different = np.bincount(one, minlength=groups)
    hot = np.bincount(group, told, minlength=groups) > 0
    left = np.flatnonzero(~done & ~told & ((different[group] > 1) | hot[group]))
    strings = hot[group[left]] | (different[group[left]] > HOT)
    yield from by_block("ask", ids, marks, doc[left], blocks, key=key[left], start=start[left].astype(np.uint32), n=n[left].astype(np.uint8), strings=strings)


def settle_strings(pieces: list[bytes], blocks: int, width: int) -> Iterator[tuple]:
    import numpy as np

    parts, at = [], 0
    for p in map(unpack, pieces):
        parts.append((p["ids"], p["marks"], p["sign"], p["doc"].astype(np.int64) + at, p["start"].astype(np.int64)))
        at += len(p["ids"])
    ids, marks, sign, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    least, _ = smallest(sign, ids[doc])
    done = ids[doc] > least
    yield from mark_rows(ids, marks, doc[done], start[done], start[done], width, blocks)


def settle_contexts(pieces: list[bytes], blocks: int, width: int) -> Iterator[tuple]:
    """One bucket of contexts: a suffix array over all of them."""
    import numpy as np

    parts, contexts, at = [], [], 0
    for p in map(unpack, pieces):
        size = p["n"].astype(np.int64) + width
        cut = np.concatenate([[0], np.cumsum(size)])
        raw = p["bytes"].tobytes()
        contexts += [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        parts.append((p["ids"], p["marks"], p["doc"].astype(np.int64) + at, p["start"].astype(np.int64), p["n"].astype(np.int64)))
        at += len(p["ids"])
    ids, marks, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    which, offset = repeated_starts(contexts, n + 1, ids[doc], width)
    yield from mark_rows(ids, marks, doc[which], start[which] + offset, start[which] + offset, width, blocks)


# ---- Spark --------------------------------------------------------------------------------------


def _rows_to_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [("kind", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def _batches(rows: Iterator[tuple]) -> Iterator:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 60
        if size > 4 << 20:
            yield _rows_to_batch(held)
            held, size = [], 0
    if held:
        yield _rows_to_batch(held)


def _table(rows: Iterator[tuple]):
    import pyarrow as pa

    return pa.Table.from_batches([_rows_to_batch(list(rows))])


def _read_blocks(buckets: int, strings: int, blocks: int, width: int, gram: int):
    """docs (doc, mark, text) to pieces, a block of texts at a time."""

    def rows(batches: Iterator) -> Iterator[tuple]:
        import numpy as np

        texts, ids, marks, size = [], [], [], 0
        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if len(text) < width:
                    continue
                texts.append(text)
                ids.append(doc)
                marks.append(mark)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from block_rows(texts, np.array(ids, np.int64), np.array(marks, np.int32), buckets, strings, blocks, width, gram)
                    texts, ids, marks, size = [], [], [], 0
        if texts:
            yield from block_rows(texts, np.array(ids, np.int64), np.array(marks, np.int32), buckets, strings, blocks, width, gram)

    return lambda batches: _batches(rows(batches))


def _settle(kinds: dict, blocks: int, width: int):
    """One bucket of one kind of pieces; other kinds go through."""

    def settle(key, table):
        kind = key[0].as_py()
        if kind not in kinds:
            return table.select(["kind", "bucket", "data"])
        out = _table(kinds[kind](table.column("data").to_pylist(), blocks, width))
        give_back()
        return out

    return settle


class Entries:
    """Packed entries of one block, by document."""

    def __init__(self, pieces: list[bytes], names: list[str]):
        import numpy as np

        self.at: dict[tuple[int, int], list] = {}
        for p in map(unpack, pieces):
            doc = p["doc"]
            by = np.argsort(doc, kind="stable")
            for a, b in runs_of(doc[by]):
                own = by[a:b]
                d = doc[own[0]]
                self.at.setdefault((int(p["ids"][d]), int(p["marks"][d])), []).append({n: p[n][own] for n in names})

    def of(self, doc: int, mark: int) -> list[dict]:
        return self.at.get((doc, mark), [])


def _fetch(buckets: int, blocks: int, width: int):
    """A block of documents (doc, mark, text) and what is asked of it, to pieces."""

    def rows(own, asked) -> Iterator[tuple]:
        import numpy as np

        entries = Entries(asked.column("data").to_pylist(), ["key", "start", "n", "strings"])
        contexts: dict[int, list] = {}
        strings = []
        for doc, mark, text in zip(own.column("doc").to_pylist(), own.column("mark").to_pylist(), text_bytes(own.column("text").combine_chunks()), strict=True):
            for e in entries.of(doc, mark):
                start, n = e["start"].astype(np.int64), e["n"].astype(np.int64)
                if (hot := e["strings"]).any():
                    first, m = start[hot], n[hot] + 1
                    at = np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    strings.append((doc, mark, Hashes(np.frombuffer(text, np.uint8)).of(at, at + width), at))
                cold = np.flatnonzero(~hot)
                bucket = (e["key"][cold] % np.uint64(buckets)).tolist()
                for b, i in zip(bucket, cold.tolist(), strict=True):
                    contexts.setdefault(b, []).append((doc, mark, start[i], n[i], text[start[i] : start[i] + n[i] + width]))
        for b, found in contexts.items():
            # each context is a document of its own here; ids may repeat
            yield "context", b, pack(
                ids=np.array([f[0] for f in found], np.int64), marks=np.array([f[1] for f in found], np.int32), doc=np.arange(len(found), dtype=np.uint32),
                start=np.array([f[2] for f in found], np.uint32), n=np.array([f[3] for f in found], np.uint8), bytes=np.frombuffer(b"".join(f[4] for f in found), np.uint8),
            )
        if strings:
            ids, marks = np.array([s[0] for s in strings], np.int64), np.array([s[1] for s in strings], np.int32)
            which = np.repeat(np.arange(len(strings)), [len(s[3]) for s in strings])
            yield from string_rows(np.concatenate([s[2] for s in strings]), ids[which], ids, marks, which, np.concatenate([s[3] for s in strings]), buckets, blocks, width)

    def fetch(own, asked):
        out = _table(rows(own, asked) if own.num_rows and asked.num_rows else iter(()))
        give_back()
        return out

    return fetch


def covered_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(docs with doc, mark and block; covered byte ranges packed by block).

    A byte is covered if it lies in a string of `width` bytes that also starts in a document with a
    smaller id. Works in three passes: anchors by bucket; contexts and hot strings by bucket; the rest is
    for the caller. The numbers of buckets and blocks follow the bytes of the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    written = Written(spark, "repeats")
    # the hash tells rows with one id apart; rows alike in both have the same text and get the same ranges
    keyed = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "mark": F.hash("text")})
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, sorts, blocks = max(48, total // 13 // (BUCKET_BYTES // 16)), max(48, total // TEXT_OF_BUCKET), max(48, total // TEXT_OF_BLOCK)
    keyed = keyed.withColumn("block", F.pmod(F.col("doc") % 1_000_003 + F.col("mark"), F.lit(blocks)).cast("int"))
    pieces = keyed.select("doc", "mark", "text").mapInArrow(task(_read_blocks(buckets, sorts, blocks, width, gram)), PIECE)
    one = written.table(_by_bucket(pieces, {"anchor": settle_anchors}, blocks, width), "anchors")
    free_shuffles(spark)
    asked = one.where("kind = 'ask'").select(F.col("bucket").alias("block"), "data")
    fetched = keyed.select("doc", "mark", "text", "block").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_fetch(sorts, blocks, width), PIECE).unionByName(one.where("kind = 'string'"))
    two = written.table(_by_bucket(fetched, {"string": settle_strings, "context": settle_contexts}, blocks, width), "contexts")
    free_shuffles(spark)
    return keyed, one.unionByName(two).where("kind = 'mark'").select(F.col("bucket").alias("block"), "data")


def _by_bucket(pieces: DataFrame, kinds: dict, blocks: int, width: int) -> DataFrame:
    return pieces.groupBy(F.col("kind").alias("k"), F.col("bucket").alias("b")).applyInArrow(_settle(kinds, blocks, width), PIECE)


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept_text.

    Whole texts are treated as UTF-8 bytes. Removed is each byte covered by a string of `width` bytes
    that also starts in a row with a smaller doc_id; strings never cross rows and are judged on the input.
    A null text is empty. A null id is larger than all others; rows that share an id do not cover each
    other. Texts shorter than `width` lose nothing. An empty table gives no rows. Cuts may split a
    character, so kept_text replaces what is left of it.
    """
    keyed, marks = covered_ranges(docs, width)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"][: 7 if with_text else 6]

    def cut(own, ranges):
        import numpy as np
        import pyarrow as pa

        entries = Entries(ranges.column("data").to_pylist(), ["lo", "n"])
        rows = []
        for doc, mark, text in zip(own.column("doc").to_pylist(), own.column("mark").to_pylist(), text_bytes(own.column("text").combine_chunks()), strict=True):
            found = entries.of(doc, mark)
            lo = np.concatenate([f["lo"] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
            hi = lo + (np.concatenate([f["n"] for f in found]).astype(np.int64) if found else 0)
            _, lo, hi = united(np.zeros(len(lo), np.int64), lo, hi)
            lo, hi = lo.tolist(), hi.tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True))
            rows.append((len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in zip(lo, hi, strict=True)], kept.decode(errors="replace")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.table([own.column("doc_id"), *[pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - 1)]], names=names)

    given = keyed.select("doc_id", "doc", "mark", "text", "block").groupBy("block").cogroup(marks.groupBy("block"))
    return given.applyInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>" + ", kept_text string" * with_text)


def op1_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT r, doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE length(h) >= 100)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM w JOIN m USING (s) WHERE doc_id > least
), runs AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit)
), spans AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, g
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r
), k AS (
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN starts IS NULL THEN h ELSE
           array_to_string(list_transform(list_zip(list_prepend(0, ends), list_append(starts, CAST(length(h) // 2 AS BIGINT))), lambda z: substr(h, CAST(2 * z[1] + 1 AS BIGINT), CAST(2 * (z[2] - z[1]) AS BIGINT))), '') END AS kept
  FROM d LEFT JOIN cut USING (r)
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
