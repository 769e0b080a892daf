"""Periodic runs of words, found by block convolution.

A run with period q holds aligned blocks of B words, B the power of two with
B <= q < 2B, that stand again q words further on.  At each dyadic scale the
texts of a batch are cut into blocks; the sum of squared differences of the
word codes between a block and every place at distance B to 2B - 1 is computed
for all blocks at once, as a cross-correlation by number-theoretic transforms.
They are exact modulo a prime, so that a true occurrence always has the sum
zero.  Neighbouring blocks with the same distance are joined, and what is long
enough for a run is compared word by word (which also settles sums that are
only zero modulo the prime) and extended to both sides by less than a block.

Each task works on its own rows, in groups of texts of about a megabyte or of
one text; nothing is shuffled or gathered.  Work grows as n log^2 n in the
words of a text, whatever it holds: multiples of a period already found, in the
interior of its run, are left out by one binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import let, ship

ship(__name__)

PRIME, ROOT, LOG_SIZE = 2013265921, 31, 27  # 15 * 2^27 + 1 and a generator: transforms of up to 2^27 numbers
TEXT_BYTES = 1 << 20  # texts of a group
CELLS = 1 << 20  # numbers of a transform's matrix at a time, or one row
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place; division by a constant is faster than a remainder."""
    x -= x // np.uint64(PRIME) * np.uint64(PRIME)
    return x


class Transform:
    """Number-theoretic transforms of the rows of a matrix, of one size."""

    def __init__(self, size: int):
        half, w = size // 2, pow(ROOT, (PRIME - 1) // size, PRIME)
        powers = np.ones(max(half, 1), np.uint64)
        have = 1
        while have < half:  # by doubling
            powers[have:2 * have] = _mod(powers[:have] * np.uint64(pow(w, have, PRIME)))
            have *= 2
        back = np.concatenate([powers[:1], np.uint64(PRIME) - powers[:0:-1]])  # w^-k = -w^(half - k)
        self.forward, self.back = powers, back
        self.shrink = np.uint64(pow(size, PRIME - 2, PRIME))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Transform in bit-reversed order, in place."""
        n, h = rows.shape[1], rows.shape[1] // 2
        while h:
            x = rows.reshape(len(rows), -1, 2, h)
            a, b = x[:, :, 0], x[:, :, 1]
            rest = a + np.uint64(PRIME)
            rest -= b
            a += b
            np.minimum(a, a - np.uint64(PRIME), out=a)  # below the prime already: the difference wraps and is larger
            if h > 1:
                rest *= self.forward[::n // (2 * h)][:h]
            b[...] = _mod(rest)
            h //= 2
        return rows

    def inverse(self, rows: np.ndarray) -> np.ndarray:
        """What bit-reversed transforms stand for, in place."""
        n, h = rows.shape[1], 1
        while h < n:
            x = rows.reshape(len(rows), -1, 2, h)
            a, b = x[:, :, 0], x[:, :, 1]
            t = _mod(b * self.back[::n // (2 * h)][:h]) if h > 1 else b.copy()
            np.add(a, np.uint64(PRIME), out=b)
            b -= t
            np.minimum(b, b - np.uint64(PRIME), out=b)
            a += t
            np.minimum(a, a - np.uint64(PRIME), out=a)
            h *= 2
        rows *= self.shrink
        return _mod(rows)


def zero_mismatches(x: np.ndarray, starts: np.ndarray, size: int, transform: Transform) -> tuple[np.ndarray, np.ndarray]:
    """(block's start, distance) wherever the ``size`` words from a start on stand again at a distance of size to
    2 size - 1, and at a few places more where the sum of squares is only zero modulo the prime.

    ``x`` has 3 size words at least from every start on."""
    blocks, distances = [], []
    step = max(1, CELLS // (2 * size))
    span = np.arange(2 * size)
    for at in range(0, len(starts), step):
        s = starts[at:at + step]
        block = np.zeros((len(s), 2 * size), np.uint64)
        block[:, :size] = x[s[:, None] + span[None, :size]]
        window = x[s[:, None] + size + span[None, :]]
        squares = _mod(window * window)
        own = _mod(block * block).sum(axis=1)
        total = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(squares, axis=1, dtype=np.uint64)], axis=1)
        there = total[:, size:2 * size] - total[:, :size]
        # the correlation is a cyclic convolution with the block reversed: word i of the block stands at -i
        block[:, 1:] = block[:, :0:-1].copy()
        cross = transform.of(block)
        cross *= transform.of(window)
        cross = transform.inverse(_mod(cross))[:, :size]
        lhs = _mod(there + own[:, None])
        cross *= np.uint64(2)
        j, d = np.nonzero(lhs == _mod(cross))
        blocks.append(s[j])
        distances.append(d + size)
    return np.concatenate(blocks), np.concatenate(distances)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Known:
    """Runs found so far, to tell whether an interval lies inside one of them."""

    def __init__(self):
        self.l = self.r = self.q = np.zeros(0, np.int64)

    def add(self, l, r, q) -> None:
        l, r, q = (np.concatenate(both) for both in ((self.l, l), (self.r, r), (self.q, q)))
        order = np.lexsort((q, -r, l))
        self.l, self.r, self.q = l[order], r[order], q[order]
        reach = np.maximum.accumulate(self.r)
        self.best = np.maximum.accumulate(np.where(self.r == reach, np.arange(len(reach)), 0))

    def holds(self, start, stop, period) -> np.ndarray:
        """Whether a run of a divisor of ``period`` holds [start, stop).

        Intervals are longer than two periods: two runs that both hold one overlap so far that they are one
        and the same, so only the run that reaches farthest has to be looked at."""
        at = np.searchsorted(self.l, start, "right") - 1
        ok = at >= 0
        if ok.any():
            k = self.best[at[ok]]
            ok[ok] = (self.r[k] >= stop[ok]) & (period[ok] % self.q[k] == 0)
        return ok


def all_runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, stop, period) of every run of every text, by first and period; ``codes`` are the words of the texts
    one after the other, text k those from bounds[k] to bounds[k + 1], and places count over all of them."""
    lengths = np.diff(bounds)
    longest = int(lengths.max()) if len(lengths) else 0
    behind = np.full(longest + 1, len(codes), np.uint64)  # no word's code: codes are smaller than their number
    x = np.concatenate([codes.astype(np.uint64), behind])
    known = Known()
    size = 1
    while 4 * size <= longest and 2 * size <= 1 << LOG_SIZE:
        texts = np.flatnonzero(lengths >= max(6, 4 * size))
        if not len(texts):
            size *= 2
            continue
        n_blocks = lengths[texts] // size - 1  # the word after the block must be in the text
        starts = np.repeat(bounds[texts], n_blocks) + size * (_ragged(np.zeros(len(texts), np.int64), n_blocks))
        stop = np.repeat(bounds[texts + 1], n_blocks)
        first = np.repeat(bounds[texts], n_blocks)
        s, q = zero_mismatches(x, starts, size, Transform(2 * size))
        at = np.searchsorted(starts, s)
        s_stop, s_first = stop[at], first[at]
        inside = s + size + q <= s_stop
        s, q, s_stop, s_first = s[inside], q[inside], s_stop[inside], s_first[inside]
        # neighbouring blocks of one text with the same distance are one stretch
        order = np.lexsort((s, q))
        s, q, s_stop, s_first = s[order], q[order], s_stop[order], s_first[order]
        new = np.ones(len(s), bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1] + size) | (s_first[1:] != s_first[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head, len(s))[1:] - 1
        u, v, q, stop, first = s[head], s[tail] + size, q[head], s_stop[head], s_first[head]
        least = np.maximum(6, 4 * q) - q  # words that agree with the one a period on
        fits = v - u + 2 * (size - 1) >= least
        if len(known.l):
            fits &= ~known.holds(u, v + q, q)
        u, v, q, stop, first = u[fits], v[fits], q[fits], stop[fits], first[fits]
        found = [np.zeros((0, 3), np.int64)]
        lo, hi = np.maximum(u - size, first), np.minimum(v + size, stop - q)
        at = 0
        while at < len(u):
            n = max(1, int(np.searchsorted(np.cumsum((hi - lo)[at:at + CELLS]), CELLS, "right")))
            found.append(_stretches(x, lo[at:at + n], hi[at:at + n], q[at:at + n]))
            at += n
        runs = np.unique(np.concatenate(found), axis=0)
        if len(runs):
            # of one stretch's periods the smallest counts; the others are its multiples
            order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
            runs = runs[order]
            one = np.ones(len(runs), bool)
            one[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
            runs = runs[one]
            if len(known.l):
                runs = runs[~known.holds(*runs.T)]
            known.add(*runs.T)
        size *= 2
    order = np.lexsort((known.q, known.l))
    return known.l[order], known.r[order], known.q[order]


def _stretches(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(first, stop, period) of the runs among the places lo to hi - 1 that agree with those a period on."""
    n = hi - lo
    places = _ragged(lo, n)
    same = np.zeros(len(places) + 1, bool)
    same[:-1] = x[places] == x[places + np.repeat(q, n)]
    edge = np.cumsum(n)[:-1]  # stretches end with their range
    change = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)))
    cuts = np.zeros(len(same) + 1, bool)
    cuts[change] = True
    cuts[edge] = True
    at = np.flatnonzero(cuts)
    at = np.append(at, len(places)) if not len(at) or at[-1] < len(places) else at
    a, b = at[:-1], at[1:]
    keep = same[a]
    a, b = a[keep], b[keep]
    period = np.repeat(q, n)[a]
    long_enough = b - a >= np.maximum(6, 4 * period) - period
    a, b, period = a[long_enough], b[long_enough], period[long_enough]
    return np.stack([places[a], places[b - 1] + 1 + period, period], axis=1)


def _words(batch_texts) -> tuple:
    """(words, bounds): every word of the texts as one Arrow array, text k holding those from bounds[k] on.

    Words are what stands between white space bytes (space and U+0009 to U+000D)."""
    import pyarrow as pa
    offsets = np.frombuffer(batch_texts.buffers()[1], np.int32)[batch_texts.offset:][:len(batch_texts) + 1].astype(np.int64)
    data = np.frombuffer(batch_texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    upto = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begins)
    kept = np.ascontiguousarray(data[inside])
    ends = np.append(upto[starts], len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    return words, np.searchsorted(starts, offsets)


def _groups(texts) -> Iterator:
    """Parts of an Arrow array of about TEXT_BYTES, or of one text."""
    import pyarrow.compute as pc
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), TEXT_BYTES, "right")))
        yield texts.slice(at, n)
        at += n


def _found(texts):
    """Arrow columns n_words, runs and collapsed of an Arrow array of texts without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc
    words, bounds = _words(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first, stop, period = all_runs(codes, bounds)
    text = np.searchsorted(bounds, first, "right") - 1
    ends = np.searchsorted(text, np.arange(len(bounds)))
    fields = [pa.array(c.astype(np.int64)) for c in (first - bounds[text], stop - first, period)]
    runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                    pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    # a word goes if a run holds it behind its first period: places covered by [first + period, stop)
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, first + period, 1)
    np.add.at(depth, stop, -1)
    kept = np.cumsum(depth[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(upto), words.filter(pa.array(kept)))
    return [pa.array(np.diff(bounds).astype(np.int64)), runs, pc.binary_join(lists, " ")]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text and any other columns).

    ``doc`` is the row without its text; ``runs`` are its runs (start, length, period) in words from 0, by start
    and period; ``collapsed`` are the words that no run holds behind its first period, joined by one space.  A run
    is a stretch of words with smallest period q and max(6, 4q) words at least that no neighbour extends.

    A null, empty or blank text has 0 words, no run and an empty collapsed text.  Repeated rows each get the same
    result, an empty table gives no rows; further columns may have any name.
    """
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1).cast(pa.string())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *_found(texts)],
                                                 names=["doc", "n_words", "runs", "collapsed"])
                at += len(texts)

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("n_words", T.LongType()),
                                              T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which the query's rule makes one text in ten periodic from some word on.

    With h the crc32 of the decimal doc_id, g = h / 10 and h % 10 = 0, word i >= a of n becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8), whole divisions.  A null doc_id or text
    is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeat(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10)

        def from_place(a):
            p = 1 + F.floor((n - a) / (3 + g % 8))
            later = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
            return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), later), " ")
        return let(g % n, from_place)
    changed = let(words, lambda w: F.when(F.size(w) > 0, repeat(w)))
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of what ``periodic_runs`` returns: the number of runs, the run of the greatest exact
    length / period, and digests of the list of runs and of the collapsed text."""
    def better(best, run):
        """Runs come by start and period, so that of equals the first stays; products of lengths stay exact."""
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
