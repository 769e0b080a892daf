"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its training documents into shards of half a million words or one document and
sorts the shard's suffixes; every test suffix (a window of a benchmark item)
is binary-searched in every shard.  Suffixes are compared to the depth of the
longest window, and those that begin with no word sequence of the benchmark
are left out of the array, since no test suffix can be found at them.  Window
matches that follow each other in item and document join to the longest
verbatim matches, with their places.

Documents never leave their task: nothing is shuffled.  The test side is sent
to the tasks in blocks of bounded size; a benchmark that outgrows one block is
searched block by block, all of them against every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import packed, ship

ship(__name__)

BLOCK_BYTES = 16 << 20  # benchmark text in one block, the bound of what is broadcast
SHARD_WORDS = 500_000
PIECE = 1 << 20
HEAD = 3  # words by which suffixes are left out
MATCH = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "item_start", "doc_start", "n_words")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
                      T.StructField("items", T.ArrayType(T.LongType())),
                      T.StructField("matches", T.ArrayType(MATCH))])


def word_table() -> bytes:
    """Byte by byte: A-Z to a-z; ASCII letters and digits and all of a multi-byte character stay; the rest separates."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def split_words(text: str | None, to_space: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about a megabyte."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(to_space)
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def test_side(rows: list[tuple[int | None, str | None]], window: int) -> dict:
    """What the tasks search for: a word index and the distinct windows, each with its items and places."""
    to_space, index = word_table(), {}
    starts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    ids = sorted({i for i, _ in rows if i is not None}) + [None] * any(i is None for i, _ in rows)
    at = {i: k for k, i in enumerate(ids)}
    for item, text in rows:
        words = [index.setdefault(w, len(index) + 1) for part in split_words(text, to_space) for w in part]
        for k in range(max(1, len(words) - window + 1) if words else 0):
            starts.setdefault(tuple(words[k:k + window]), []).append((at[item], k))
    keys = sorted(starts)
    head = min([HEAD, *map(len, keys)])
    padded = np.zeros((len(keys), window), dtype=">u4")
    for k, key in enumerate(keys):
        padded[k, :len(key)] = key
    places = [sorted(set(starts[k])) for k in keys]
    heads = np.unique(_head_hash([padded[:, d].astype(np.uint64) for d in range(head)])) if keys else np.zeros(0, np.uint64)
    return {"index": index, "ids": ids, "window": window, "length": np.array([len(k) for k in keys], np.int64),
            "low": padded, "head": head, "heads": heads,
            "place_at": np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64),
            "place": np.array([x for p in places for x in p], np.int64).reshape(-1, 2)}


def _head_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian word numbers as byte strings, which compare alike."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def search(words: np.ndarray, side: dict) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a test window in a shard's word numbers.

    Word number 0 stands for any word that the benchmark lacks and for the
    ends of documents, so no match crosses one.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    window, head = side["window"], side["head"]
    if not len(side["length"]) or not len(words):
        return none
    padded = np.concatenate([words, np.zeros(window, words.dtype)])
    starts = np.nonzero(words)[0]
    for d in range(1, head):
        starts = starts[padded[starts + d] != 0]
    hashed = _head_hash([padded[starts + d].astype(np.uint64) for d in range(head)])
    spot = np.minimum(np.searchsorted(side["heads"], hashed), len(side["heads"]) - 1)
    starts = starts[side["heads"][spot] == hashed]
    if not len(starts):
        return none
    rows = padded[starts[:, None] + np.arange(window)]
    gone = np.cumsum(rows == 0, axis=1) > 0  # what follows a border is no part of the suffix
    rows[gone] = 0
    suffixes = _keys(rows.astype(">u4"))
    order = np.argsort(suffixes, kind="stable")  # the suffix array of the shard
    suffixes, starts = suffixes[order], starts[order]
    first = np.searchsorted(suffixes, _keys(side["low"]), "left")
    # the end of the range: after the last suffix that has the window as its first words
    high = side["low"].copy()
    high[np.arange(window)[None, :] >= side["length"][:, None]] = 0xFFFFFFFF
    last = np.searchsorted(suffixes, _keys(high), "right")
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[first[which] + inside], which


def spans(position: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Union of [position, position + length) as disjoint rows (start, end); ends that touch join."""
    order = np.argsort(position, kind="stable")
    start, end = position[order], np.maximum.accumulate((position + length)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.nonzero(new)[0]
    return np.stack([start[at], np.concatenate([end[at[1:] - 1], end[-1:]])], axis=1)


def longest(position: np.ndarray, which: np.ndarray, side: dict) -> list[tuple]:
    """Longest verbatim matches (item_id, item_start, doc_start, n_words) from a document's window matches."""
    n = side["place_at"][which + 1] - side["place_at"][which]
    src = np.repeat(np.arange(len(which)), n)
    place = side["place"][np.repeat(side["place_at"][which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    item, at, doc, size = place[:, 0], place[:, 1], position[src], side["length"][which[src]]
    order = np.lexsort((at, at - doc, item))
    item, at, doc, size = item[order], at[order], doc[order], size[order]
    new = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 1)])
    k = np.nonzero(new)[0]
    stop = np.concatenate([k[1:], [len(item)]]) - 1
    return [(side["ids"][i], int(a), int(d), int(b)) for i, a, d, b
            in zip(item[k], at[k], doc[k], at[stop] + size[stop] - at[k])]


def matcher(side_sent) -> Column:
    """pandas UDF from a text to struct(n_words, n_hit, hits, items, matches)."""
    @F.pandas_udf(FOUND)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        side, to_space = side_sent.value, word_table()
        number = side["index"].get

        def shard(docs: list[list[np.ndarray]]) -> list[tuple]:
            """Results of documents whose words stand one after the other, a border after each."""
            flat = [x for d in docs for x in (*d, np.zeros(1, np.uint32))]
            sizes = np.array([sum(map(len, d)) for d in docs], np.int64)
            border = np.cumsum(sizes + 1) - sizes - 1
            position, which = search(np.concatenate(flat), side)
            order = np.argsort(position, kind="stable")
            position, which = position[order], which[order]
            cut = np.searchsorted(position, border)
            out = []
            for k, n in enumerate(sizes):
                p = position[cut[k]:cut[k + 1] if k + 1 < len(cut) else None] - border[k]
                w = which[cut[k]:cut[k + 1] if k + 1 < len(cut) else None]
                if not len(p):
                    out.append((int(n), 0, [], [], []))
                    continue
                hit = spans(p, side["length"][w])
                found = longest(p, w, side)
                items = sorted({m[0] for m in found if m[0] is not None})
                out.append((int(n), int((hit[:, 1] - hit[:, 0]).sum()), hit.tolist(), items, found))
            return out

        for texts in batches:
            out, docs, held = [], [], 0
            for t in texts:
                parts = [np.fromiter((number(w, 0) for w in p), np.uint32, len(p)) for p in split_words(t, to_space)]
                docs.append(parts)
                held += sum(map(len, parts)) + 1
                if held >= SHARD_WORDS:
                    out += shard(docs)
                    docs, held = [], 0
            if docs:
                out += shard(docs)
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "hits", "items", "matches"])

    return match


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[dict]:
    """Test sides of at most about ``block_bytes`` of text each; items are dealt to blocks by hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield test_side([tuple(r) for r in (items.filter(block == k) if n > 1 else items).collect()], window)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``found`` (in place of one of that name): struct(n_words, n_hit, hits, items, matches).

    hits are the disjoint spans of document words that lie in an occurrence
    of a window, items the item_ids with an occurrence, matches the longest
    verbatim matches and their places (in words).  An item of fewer words
    than ``window`` is one window; one without words is none.  Null texts
    have no words.  Repeated items count once; those without item_id hit
    words but aren't listed in items.  An empty benchmark hits nothing.
    """
    context = docs.sparkSession.sparkContext
    sides = [context.broadcast(s) for s in blocks(benchmark, window, block_bytes)]
    if len(sides) == 1:
        return docs.withColumn("found", matcher(sides[0])("text"))
    each = docs.withColumn("found", F.array(*[matcher(s)("text") for s in sides]))

    @F.pandas_udf("array<array<long>>")
    def union(rows: pd.Series) -> pd.Series:
        def one(lists):
            both = [x for part in lists for x in part]
            if not both:
                return []
            s = np.array([[a, b] for a, b in both], np.int64)
            return spans(s[:, 0], s[:, 1] - s[:, 0]).tolist()
        return rows.map(one)

    each = each.withColumn("found_hits", union(F.transform("found", lambda f: f["hits"])))
    return each.withColumn("found", F.struct(
        F.col("found")[0]["n_words"].alias("n_words"),
        F.aggregate("found_hits", F.lit(0).cast("long"), lambda s, h: s + h[1] - h[0]).alias("n_hit"),
        F.col("found_hits").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"])))).alias("items"),
        F.flatten(F.transform("found", lambda f: f["matches"])).alias("matches"))).drop("found_hits")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``matched`` returns."""
    items = F.array_join(F.array_sort(F.col("found.items").cast("array<string>")), ",")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(items, 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without those that hold a benchmark window."""
    return matched(packed(docs), benchmark, window).filter("found.n_hit = 0").select("doc.*")
