"""Scores by a class-based bigram model whose word classes come from exchange clustering (Brown et al.).

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). The most frequent words get their classes by exchange;
every other word of `least` training tokens or more joins the class that raises the likelihood most, by the same
gain, whatever their number; rarer ones have a class by their ending. Counts of all words come from all
training rows, and no vocabulary but the exchanged one goes to a task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, free_shuffles, give_back, task, text_bytes
from leafmill.llm.hashing import Hashes, narrow, pack, runs_of, unpack

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text of a block that is looked at together, and the least number of blocks, buckets and chunks.
BLOCK_BYTES, LEAST = 6 << 20, 48


@dataclass
class Settings:
    """`one_in`: words of at least one in so many training tokens are exchanged, so their number is bounded; `least`: tokens of a word that gets one of the `classes`."""

    classes: int = 64
    endings: int = 32
    one_in: int = 20_000
    least: int = 5
    rounds: int = 6
    alpha: float = 5.0
    delta: float = 0.5


@dataclass
class Tokens:
    """Words of several texts: their hashes, ending classes, and the number of words of each text."""

    hashes: object
    endings: object
    counts: object


def tokens(texts: list[bytes], endings: int) -> Tokens:
    import numpy as np

    words = [t.translate(LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(b" ".join(flat), np.uint8)
    if not len(flat):
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.int64), counts)
    last = text[ends - 1].astype(np.int64)
    before = np.where(sizes > 1, text[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return Tokens(Hashes(text).of(ends - sizes, ends), (last * 31 + before * 17) % endings, counts)


def with_ends(values, counts, end: int):
    """`values` of the words of several texts with `end` before the first text and after each text."""
    import numpy as np

    out = np.full(len(values) + len(counts) + 1, end, np.int64)
    at = np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts) + 1
    out[at] = values
    return out


# ---- Counts ---------------------------------------------------------------------------------------


class Stream:
    """The words of a block of texts as numbers, by frequency, with the hash and ending of each different word."""

    def __init__(self, data: bytes):
        import numpy as np

        p = unpack(data)
        self.words, self.ending, self.counts = p["words"], p["ending"].astype(np.int64), p["counts"].astype(np.int64)
        self.number = p["low"].astype(np.int64) | p["high"].astype(np.int64) << 16
        self.train = np.unpackbits(p["train"])[: len(self.counts)].astype(bool)

    @staticmethod
    def packed(texts: list[bytes], train, endings: int) -> bytes:
        import numpy as np

        t = tokens(texts, endings)
        words, first, number, count = np.unique(t.hashes, return_index=True, return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        number = place[number]
        return pack(words=words[by], ending=t.endings[first][by].astype(np.uint8), low=(number & 0xFFFF).astype(np.uint16), high=(number >> 16).astype(np.uint8), counts=t.counts.astype(np.uint32), train=np.packbits(np.array(train, bool)))

    def line(self, of_word, end: int, train_only: bool = False):
        """Values of the words in their places, with `end` before the first text and after each."""
        import numpy as np

        if not train_only:
            return with_ends(of_word[self.number], self.counts, end)
        return with_ends(of_word[self.number[np.repeat(self.train, self.counts)]], self.counts[self.train], end)

    def by_bucket(self, which, buckets: int) -> Iterator[tuple[int, object]]:
        """(bucket, places of its words) for the words at `which`."""
        import numpy as np

        bucket = (self.words[which] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        for a, b in runs_of(bucket[by]):
            yield int(bucket[by[a]]), which[by[a:b]]

    def symbols(self, often):
        """The number of each word among the exchanged ones (sorted hashes), or after those its ending class."""
        import numpy as np

        if not len(often):
            return self.ending
        at = np.minimum(np.searchsorted(often, self.words), len(often) - 1)
        return np.where(often[at] == self.words, at, len(often) + self.ending)


def _table(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _read(endings: int, buckets: int, kind: str):
    """One block of rows (block, doc_id, train, text): its stream, and for each bucket its words and how often training rows have them."""

    def read(table):
        import numpy as np
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        data = Stream.packed(text_bytes(table.column("text").combine_chunks()), table.column("train").to_pylist(), endings)
        s = Stream(data)
        count = np.bincount(s.number[np.repeat(s.train, s.counts)], minlength=len(s.words))
        rows = [(block, table.column("doc_id").to_pylist(), data, None, None)]
        for b, own in s.by_bucket(np.arange(len(s.words)), buckets):
            rows.append((block, None, None, b, pack(words=s.words[own], count=narrow(count[own]), ending=s.ending[own].astype(np.uint8))))
        out = _table(rows, ["block", "ids", "stream", "bucket", "data"], [pa.int32(), pa.list_(table.schema.field("doc_id").type), pa.binary(), pa.int32(), pa.binary()])
        give_back()
        return out

    return read


def _reply(s: Settings):
    """One bucket of words from all blocks: their counts in all training rows, sent back to each block."""

    def reply(key, table):
        import numpy as np
        import pyarrow as pa

        parts = [unpack(d) for d in table.column("data").to_pylist()]
        words, first, number = np.unique(np.concatenate([p["words"] for p in parts]), return_index=True, return_inverse=True)
        ending = np.concatenate([p["ending"] for p in parts])[first]
        total = np.bincount(number, np.concatenate([p["count"] for p in parts]), minlength=len(words)).astype(np.int64)
        rows, at = [], 0
        for block, p in zip(table.column("block").to_pylist(), parts, strict=True):
            rows.append((block, key[0].as_py(), pack(count=narrow(total[number[at : at + len(p["words"])]])), None, None))
            at += len(p["words"])
        often = (total >= s.least) & (total * s.one_in >= total.sum())  # more than are often in the whole corpus, never fewer
        others = np.bincount(ending[(total > 0) & (total < s.least)], minlength=s.endings)
        rows.append((None, key[0].as_py(), pack(words=words[often], count=total[often], others=others), int((total > 0).sum()), int(total.sum())))
        return _table(rows, ["block", "bucket", "data", "known", "tokens"], [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])

    return reply


def _often(total: int, one_in: int):
    """The words that are exchanged, and the number of words of each ending class."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        others = np.zeros(0, np.int64)
        for batch in batches:
            for p in map(unpack, batch.column(0).to_pylist()):
                own = p["count"] * one_in >= max(1, total)
                others = p["others"] + (others if len(others) else 0)
                yield pa.RecordBatch.from_arrays([pa.array(p["words"][own].view(np.int64)), pa.nulls(int(own.sum()), pa.int32()), pa.nulls(int(own.sum()), pa.int64())], names=["word", "ending", "words"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(others), pa.int64()), pa.array(np.arange(len(others)), pa.int32()), pa.array(others, pa.int64())], names=["word", "ending", "words"])

    return run


def _pairs(shared, endings: int, chunks: int):
    """Streams to counts of pairs of symbols of training texts, by chunk of the left one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        often = shared.value
        held, size = [], 0

        def summed(parts):
            code, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return code, np.bincount(number, np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64)

        for batch in batches:
            for stream in map(Stream, batch.column(0).to_pylist()):
                line = stream.line(stream.symbols(often), len(often) + endings, True)
                held.append(np.unique(line[:-1] << 16 | line[1:], return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield _chunked(*held[0], chunks)
                        held, size = [], 0
        if held:
            yield _chunked(*summed(held), chunks)

    return run


def _chunked(code, count, chunks: int, right: bool = False):
    import numpy as np
    import pyarrow as pa

    chunk = (code & 0xFFFF if right else code >> 16) % chunks
    by = np.argsort(chunk, kind="stable")
    cuts = np.searchsorted(chunk[by], np.arange(chunks + 1))
    rows = [(int(c), pack(code=code[by[cuts[c] : cuts[c + 1]]].astype(np.uint32), count=count[by[cuts[c] : cuts[c + 1]]])) for c in np.flatnonzero(np.diff(cuts))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "data"])


def _sum_chunk(key, table):
    import numpy as np
    import pyarrow as pa

    parts = [unpack(d) for d in table.column("data").to_pylist()]
    code, number = np.unique(np.concatenate([p["code"] for p in parts]), return_inverse=True)
    count = np.bincount(number, np.concatenate([p["count"] for p in parts]), minlength=len(code)).astype(np.int64)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pack(code=code, count=count)], pa.binary())})


def _turned(chunks: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for p in map(unpack, batch.column(1).to_pylist()):
                yield _chunked(p["code"].astype(np.int64), p["count"], chunks, right=True)

    return run


# ---- Exchange clustering --------------------------------------------------------------------------


def plogp(x):
    import numpy as np

    return x * np.log(np.maximum(x, 1))


def class_counts(pairs: DataFrame, of_symbol, n: int):
    """The n * n counts of pairs of classes; each task returns one small matrix."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = np.zeros(n * n, np.int64)
        for batch in batches:
            for p in map(unpack, batch.column(0).to_pylist()):
                code = p["code"].astype(np.int64)
                out += np.bincount(of_symbol[code >> 16] * n + of_symbol[code & 0xFFFF], p["count"], minlength=n * n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["data"])

    rows = pairs.select("ahead").mapInArrow(task(run), "data binary").collect()
    return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(n * n, np.int64)).reshape(n, n)


def moves(pairs: DataFrame, of_symbol, matrix, classes: int, turn: int, turns: int) -> list:
    """For each frequent word of this turn the class that raises the likelihood most: (word, class, gain)."""
    n = len(matrix)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        left_sum, right_sum = matrix.sum(1).astype(float), matrix.sum(0).astype(float)
        rows = []
        for batch in batches:
            for chunk, ahead, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (unpack(x) if x else {"code": np.zeros(0, np.uint32), "count": np.zeros(0, np.int64)} for x in (ahead, behind))
                a_code, b_code = a["code"].astype(np.int64), b["code"].astype(np.int64)
                words = np.unique(np.concatenate([a_code >> 16, b_code & 0xFFFF]))
                words = words[(of_symbol[words] < classes) & (words % turns == turn)]
                if not len(words):
                    continue

                def sums(code, own, other, count, words=words):
                    at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                    ok = words[at] == own
                    flat = np.bincount(at[ok] * n + of_symbol[other[ok]], count[ok], minlength=len(words) * n)
                    return flat.reshape(len(words), n)

                after = sums(a_code, a_code >> 16, a_code & 0xFFFF, a["count"])
                before = sums(b_code, b_code & 0xFFFF, b_code >> 16, b["count"])
                own_pair = np.zeros(len(words))
                twice = np.flatnonzero((a_code >> 16) == (a_code & 0xFFFF))
                at = np.searchsorted(words, a_code[twice] & 0xFFFF)
                fits = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == (a_code[twice] & 0xFFFF))
                own_pair[at[fits]] = a["count"][twice[fits]]
                for w, l, r, s in zip(words.tolist(), before, after, own_pair.tolist(), strict=True):
                    rows.append((w, *best_class(matrix, left_sum, right_sum, int(of_symbol[w]), l.copy(), r.copy(), s, classes)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["word", "to", "gain"])

    return pairs.select("chunk", "ahead", "behind").mapInArrow(task(run), "word long, to long, gain double").where("gain > 0").collect()


def best_class(matrix, left_sum, right_sum, now: int, l, r, s: float, classes: int) -> tuple[int, float]:
    """Where a word with l before and r after it (by class, s times itself) should go, and the gain over staying."""
    import numpy as np

    out, into = r.sum(), l.sum()
    l[now] -= s
    r[now] -= s
    m = matrix.astype(float)
    m[:, now] -= l
    m[now, :] -= r
    m[now, now] -= s
    b = np.arange(classes)
    columns, rows, corner = m[:, :classes], m[:classes, :], m[b, b]
    up = (plogp(columns + l[:, None]) - plogp(columns)).sum(0) + (plogp(rows + r[None, :]) - plogp(rows)).sum(1)
    up -= plogp(corner + l[b]) + plogp(corner + r[b]) - plogp(corner)
    up += plogp(corner + l[b] + r[b] + s)
    ls, rs = left_sum[:classes].copy(), right_sum[:classes].copy()
    ls[now] -= out
    rs[now] -= into
    up -= plogp(ls + out) - plogp(ls) + plogp(rs + into) - plogp(rs)
    best = int(np.argmax(up))
    return best, float(up[best] - up[now])


def cluster(pairs: DataFrame, frequent: int, s: Settings):
    """Class of each symbol, and the matrix of class pairs, after `rounds` rounds of exchange.

    In a round each frequent word moves at most once, a third of them at a time against the counts as they
    are; a step that lowers the likelihood is undone. Endings and the end of a text keep classes of their own.
    """
    import numpy as np

    n = s.classes + s.endings + 1
    of_symbol = np.concatenate([np.arange(frequent) % s.classes, s.classes + np.arange(s.endings + 1)])

    def likelihood(m):
        return plogp(m.astype(float)).sum() - plogp(m.sum(0).astype(float)).sum() - plogp(m.sum(1).astype(float)).sum()

    matrix = class_counts(pairs, of_symbol, n)
    for step in range(s.rounds * 3 if frequent else 0):
        found = moves(pairs, of_symbol, matrix, s.classes, step % 3, 3)
        if not found:
            continue
        found.sort(key=lambda r: (-r["gain"], r["word"]))
        for share in (1, 4):
            trial = of_symbol.copy()
            for r in found[: -(-len(found) // share)]:
                trial[r["word"]] = r["to"]
            counted = class_counts(pairs, trial, n)
            if likelihood(counted) > likelihood(matrix):
                of_symbol, matrix = trial, counted
                break
    return of_symbol, matrix


# ---- Words that are not exchanged -----------------------------------------------------------------


class Answers:
    """What buckets have sent to a block: one value for each of the words that it asked for."""

    def __init__(self, table, kind: str, name: str):
        kinds = table.column("kind").to_pylist()
        found = zip(kinds, table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True)
        self.of = {b: unpack(d)[name] for k, b, d in found if k == kind}

    def put(self, stream: Stream, which, buckets: int, out):
        for b, own in stream.by_bucket(which, buckets):
            out[own] = self.of[b]
        return out


def joins_classes(stream: Stream, count, often, s: Settings):
    """Places of the words that are not exchanged but get a class by the corpus."""
    import numpy as np

    return np.flatnonzero((count >= s.least) & (stream.symbols(often) >= len(often)))


def _ask_classes(model, s: Settings, buckets: int):
    """A block and the counts of its words, to the classes beside those of its words that join classes, by bucket."""

    def ask(own, answers):
        import numpy as np
        import pyarrow as pa

        rows = []
        if own.num_rows:
            often, of_symbol, _ = model.value
            stream, n = Stream(own.column("stream")[0].as_py()), s.classes + s.endings + 1
            every = np.arange(len(stream.words))
            count = Answers(answers, "count", "count").put(stream, every, buckets, np.zeros(len(every), np.int64))
            classes, which = of_symbol[stream.symbols(often)], joins_classes(stream, count, often, s)
            line, at = stream.line(classes, n - 1, True), stream.line(every, -1, True)
            asks = np.zeros(len(every) + 1, bool)
            asks[which] = True
            here = np.flatnonzero(asks[at])  # the end of a text is at the last place, which never asks
            word = np.concatenate([at[here], at[here]])
            beside = np.concatenate([line[here - 1], n + line[here + 1]])
            code, seen = np.unique(word * (2 * n) + beside, return_counts=True)
            begin, end = np.searchsorted(code, every * (2 * n)), np.searchsorted(code, (every + 1) * (2 * n))
            for b, mine in stream.by_bucket(which, buckets):
                size = end[mine] - begin[mine]
                entry = np.repeat(begin[mine], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rows.append((b, own.column("block")[0].as_py(), pack(words=stream.words[mine], size=narrow(size), beside=(code[entry] % (2 * n)).astype(np.uint8), count=narrow(seen[entry]))))
        out = _table(rows, ["bucket", "block", "data"], [pa.int32(), pa.int32(), pa.binary()])
        give_back()
        return out

    return ask


def best_classes(word, beside, count, words: int, matrix, classes: int):
    """For each of `words` words, with `count` neighbours of a class before it (beside) or after it (n + beside), the class that it should join.

    The entries are in order of `word`. A class gains by what its row and column of the matrix gain in likelihood.
    """
    import numpy as np

    n, m = len(matrix), matrix.astype(float)
    up, twice = np.zeros((words, classes)), np.zeros((2, words, classes))
    tables = np.concatenate([m[:, :classes], m[:classes, :].T])
    for part in np.array_split(np.arange(len(word)), -(-len(word) // (1 << 15)) or 1):
        if not len(part):
            continue
        base, more = tables[beside[part]], count[part].astype(float)[:, None]
        first = np.flatnonzero(np.concatenate([[True], word[part][1:] != word[part][:-1]]))
        up[word[part][first]] += np.add.reduceat(plogp(base + more) - plogp(base), first)
    own = (beside % n) < classes
    twice[(beside[own] >= n).astype(int), word[own], beside[own] % n] = count[own]
    corner = np.diag(m)[:classes]
    up += plogp(corner + twice[0] + twice[1]) - plogp(corner + twice[0]) - plogp(corner + twice[1]) + plogp(corner)
    sides = np.bincount(word * 2 + (beside >= n), count, minlength=2 * words).reshape(words, 2)
    for total, at in ((m.sum(0)[:classes], 0), (m.sum(1)[:classes], 1)):
        up -= plogp(total + sides[:, at : at + 1]) - plogp(total)
    return up.argmax(1)


def _give_classes(model, s: Settings):
    """One bucket of words that join classes, from all blocks: their classes, sent back to each block, and the number of words of each."""

    def give(key, table):
        import numpy as np
        import pyarrow as pa

        n, parts = s.classes + s.endings + 1, [unpack(d) for d in table.column("data").to_pylist()]
        words, number = np.unique(np.concatenate([p["words"] for p in parts]), return_inverse=True)
        owner = np.repeat(number, np.concatenate([p["size"] for p in parts]).astype(np.int64))
        code, which = np.unique(owner * (2 * n) + np.concatenate([p["beside"] for p in parts]).astype(np.int64), return_inverse=True)
        count = np.bincount(which, np.concatenate([p["count"] for p in parts]), minlength=len(code))
        best = best_classes(code // (2 * n), code % (2 * n), count, len(words), model.value[2], s.classes)
        rows, at = [], 0
        for block, p in zip(table.column("block").to_pylist(), parts, strict=True):
            rows.append((block, key[0].as_py(), pack(best=best[number[at : at + len(p["words"])]].astype(np.uint8)), None, None))
            at += len(p["words"])
        rows += [(None, None, None, c, int(k)) for c, k in enumerate(np.bincount(best, minlength=s.classes)) if k]
        out = _table(rows, ["block", "bucket", "data", "class", "words"], [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64()])
        give_back()
        return out

    return give


def _resolve(model, s: Settings, buckets: int):
    """A block, the counts and the classes of its words: what scores need, and its counts of pairs of classes."""

    def resolve(own, answers):
        import numpy as np
        import pyarrow as pa

        rows = []
        if own.num_rows:
            often, of_symbol, _ = model.value
            stream, n = Stream(own.column("stream")[0].as_py()), s.classes + s.endings + 1
            every = np.arange(len(stream.words))
            count = Answers(answers, "count", "count").put(stream, every, buckets, np.zeros(len(every), np.int64))
            classes = Answers(answers, "class", "best").put(stream, joins_classes(stream, count, often, s), buckets, of_symbol[stream.symbols(often)])
            line = stream.line(classes, n - 1, True)
            code, seen = np.unique(line[:-1] * n + line[1:], return_counts=True)
            low, high = (stream.number & 0xFFFF).astype(np.uint16), (stream.number >> 16).astype(np.uint8)
            data = pack(low=low, high=high, counts=stream.counts.astype(np.uint32), train=np.packbits(stream.train), count=count.astype(np.uint32), classes=classes.astype(np.uint8))
            rows = [(own.column("ids")[0].as_py(), data, None, None), *[(None, None, c, k) for c, k in zip(code.tolist(), seen.tolist(), strict=True)]]
        out = _table(rows, ["ids", "data", "code", "seen"], [own.schema.field("ids").type, pa.binary(), pa.int32(), pa.int64()])
        give_back()
        return out

    return resolve


# ---- The model ------------------------------------------------------------------------------------


@dataclass
class Model:
    """log10 of P(class | class before), and of what counts plus delta are divided by in each class; sizes of the training rows."""

    transition: object
    emitted: object
    delta: float
    tokens: int
    vocabulary: int
    ends: int


def fit(docs: DataFrame, train: Column, s: Settings) -> tuple[DataFrame, Model]:
    """(blocks of all rows with counts and classes of their words, the model learnt from rows for which `train` holds).

    Rows are dealt out in blocks by a hash of id and text. A block becomes a stream of numbers once; blocks ask
    for the counts and classes of their different words, by bucket of the word, and the answers meet them again.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    written, kind = Written(spark, "brown"), dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("train"), 1))).first()
    blocks, buckets, ends = max(LEAST, (size[0] or 0) // BLOCK_BYTES), max(LEAST, (size[0] or 0) // (16 << 20)), size[1] or 0
    rows = rows.withColumn("block", F.pmod(F.hash("doc_id", "text"), F.lit(blocks)))
    asked = rows.groupBy("block").applyInArrow(_read(s.endings, buckets, kind), f"block int, ids array<{kind}>, stream binary, bucket int, data binary")
    asked = written.table(asked.withColumn("part", F.when(F.col("bucket").isNull(), "stream").otherwise("words")), "asked", "part")
    free_shuffles(spark)
    streams = asked.where("part = 'stream'").select("block", "ids", "stream")
    asked = asked.where("part = 'words'").select("bucket", "block", "data")
    replies = written.table(asked.groupBy("bucket").applyInArrow(_reply(s), "block int, bucket int, data binary, known long, tokens long"), "replies")
    written.drop("asked/part=words")
    free_shuffles(spark)

    stats = replies.where("block IS NULL")
    known, words = (x or 0 for x in stats.agg(F.sum("known"), F.sum("tokens")).first())
    total, vocabulary = words + ends, known + (1 if ends else 0)
    listed = stats.select("data").mapInArrow(task(_often(total, s.one_in)), "word long, ending int, words long")
    often = np.array(sorted(r[0] & (1 << 64) - 1 for r in listed.where("word IS NOT NULL").select("word").collect()), np.uint64)
    others = np.zeros(s.endings)
    for r in listed.where("word IS NULL").groupBy("ending").agg(F.sum("words")).collect():
        others[r[0]] = r[1]

    chunks = 2 * LEAST
    shared = spark.sparkContext.broadcast(often)
    ahead = streams.select("stream").mapInArrow(task(_pairs(shared, s.endings, chunks)), "chunk int, data binary")
    ahead = written.table(ahead.groupBy("chunk").applyInArrow(_sum_chunk, "chunk int, data binary"), "ahead")
    behind = ahead.mapInArrow(task(_turned(chunks)), "chunk int, data binary").groupBy("chunk").applyInArrow(_sum_chunk, "chunk int, data binary")
    pairs = ahead.withColumnRenamed("data", "ahead").join(behind.withColumnRenamed("data", "behind"), "chunk", "full")
    pairs = written.table(pairs.repartition(chunks, "chunk"), "pairs")
    of_symbol, matrix = cluster(pairs, len(often), s)
    written.drop("ahead", "pairs")
    free_shuffles(spark)

    exchanged = spark.sparkContext.broadcast((often, of_symbol, matrix))
    counts = replies.where("block IS NOT NULL").select("block", "bucket", F.lit("count").alias("kind"), "data")
    by_block = streams.groupBy("block")
    wanted = by_block.cogroup(counts.groupBy("block")).applyInArrow(_ask_classes(exchanged, s, buckets), "bucket int, block int, data binary")
    given = wanted.groupBy("bucket").applyInArrow(_give_classes(exchanged, s), "block int, bucket int, data binary, class int, words long")
    given = written.table(given, "given")
    free_shuffles(spark)
    answers = counts.unionByName(given.where("block IS NOT NULL").select("block", "bucket", F.lit("class").alias("kind"), "data"))
    resolved = by_block.cogroup(answers.groupBy("block")).applyInArrow(_resolve(exchanged, s, buckets), f"ids array<{kind}>, data binary, code int, seen long")
    resolved = written.table(resolved, "resolved")
    written.drop_others("resolved", "given")
    free_shuffles(spark)

    n = len(matrix)
    matrix = np.zeros(n * n)
    for r in resolved.where("code IS NOT NULL").groupBy("code").agg(F.sum("seen")).collect():
        matrix[r[0]] = r[1]
    matrix, in_class = matrix.reshape(n, n), matrix.reshape(n, n).sum(0)
    transition = np.log10((matrix + s.alpha * (in_class + 1) / (in_class.sum() + n)) / (matrix.sum(1, keepdims=True) + s.alpha))
    kinds = np.bincount(of_symbol[: len(often)], minlength=n).astype(float)  # different words of each class
    for r in given.where("class IS NOT NULL").groupBy("class").agg(F.sum("words")).collect():
        kinds[r[0]] += r[1]
    kinds[s.classes : s.classes + s.endings] = others
    kinds[n - 1] = 1
    model = Model(transition, np.log10(in_class + s.delta * (kinds + 1)), s.delta, total, vocabulary, ends)
    return resolved.where("code IS NULL").select("ids", "data"), model


def score_corpus(docs: DataFrame, train: Column, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Rows for which `train` holds are learnt from, all rows are scored. Words are lower-cased in A-Z and split
    at ASCII white space; each text has one end after its words. base_score sums log10 of add-one unigram
    probabilities; score that of the class model, which backs transitions off to class frequencies (weight
    alpha) and keeps delta for each word and one unseen word of a class. Null texts are empty: one end. A
    null id is scored like any other; repeated rows are learnt from and scored each; a very long text is read whole
    in one task; classes that gain alike go to the first. Without training rows every class counts nothing and the
    smoothing alone decides; an empty table gives no rows. Other columns are only seen by `train`.
    """
    s, kind = s or Settings(), dict(docs.dtypes)["doc_id"]
    blocks, model = fit(docs, train, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = shared.value
        base, end = np.log10(m.tokens + m.vocabulary + 1.0), len(m.emitted) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                p = unpack(batch.column(1)[i].as_py())
                number, counts = p["low"].astype(np.int64) | p["high"].astype(np.int64) << 16, p["counts"].astype(np.int64)
                line = with_ends(p["classes"][number], counts, end)
                seen = with_ends(p["count"][number], counts, m.ends)[1:].astype(float)
                each = m.transition[line[:-1], line[1:]] + np.log10(seen + m.delta) - m.emitted[line[1:]]
                cuts = np.cumsum(counts + 1) - counts - 1
                sums = [np.add.reduceat(x, cuts) for x in ((seen > 0).astype(np.int64), np.log10(seen + 1) - base, each)]
                held = ~np.unpackbits(p["train"])[: len(counts)].astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(held), pa.array(counts + 1), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = blocks.mapInArrow(task(score), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_brown(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return score_corpus(docs, train)
