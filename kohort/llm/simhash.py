"""Near-duplicate documents by 64-bit SimHash fingerprints.

Fingerprints are compared exactly, tile against tile.  A tile holds the
distinct fingerprints whose four 16-bit parts have the same population
counts.  Two fingerprints that differ in d bits have population counts that
differ by at most d in sum, so a tile meets only the tiles whose counts lie
within the radius; all other tile pairs are skipped.  A tile that outgrows
``tile_rows`` is split by hash and its pieces meet one by one.  Within a pair
of tiles numpy takes the exclusive or and counts the bits, and what leaves
the task is a spanning forest of the links found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import ROW_ID, packed, row_id, ship
from kohort.llm.graph import connected_components
from kohort.session import materialize

ship(__name__)

PARTS = 4
PIECE = 1 << 20


def _bits(hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, dtype="<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer; 0 without words.

    bytes.lower and bytes.split do just what the definition asks: A-Z only,
    and the separators 0x20 and 0x09-0x0D.  Hashes are counted in pieces, so
    that memory follows the text and not its number of shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, PIECE):
        if n == 1:
            part = [digest(b" ".join(words), 42)]
        else:
            stop = min(n, at + PIECE)
            part = [digest(b" ".join(s), 42) for s in zip(*(words[at + j:stop + j] for j in range(width)))]
        ones += _bits(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(row identity, doc_id, fp) for every row of ``docs``."""
    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", *row_id(), fp("text").alias("fp"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links within ``radius`` between two tiles (or inside one)."""
    nodes = a if same else np.concatenate([a, b])
    first = 0 if same else len(a)
    label = np.arange(len(nodes))
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + first
        while len(i):
            li, lj = label[i], label[j]
            open_ = li != lj
            i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
            if not len(i):
                break
            # each larger root hooks onto one smaller root; the link that did it is kept
            high, low = np.maximum(li, lj), np.minimum(li, lj)
            _, pick = np.unique(high, return_index=True)
            kept.append((nodes[i[pick]], nodes[j[pick]]))
            label[high[pick]] = low[pick]
            while not np.array_equal(label, up := label[label]):
                label = up
    if not kept:
        return nodes[:0], nodes[:0]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair d, -d."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]


def links(fps: DataFrame, radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """Edges (a, b) that span the links of at most ``radius`` bits among distinct ``fps`` (fp).

    Exact: every pair of distinct fingerprints within the radius is compared.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int")
              for k in range(PARTS)]
    each = fps.select("fp", F.array(*counts).alias("tile"))
    split = each.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("pieces"))
    tiles = materialize(each.join(split, "tile")
                        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int").alias("piece"))
                        .agg(F.collect_list("fp").alias("fps")))  # about tile_rows at most
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _neighbours(radius)])
    left = (tiles.select("tile", "piece", F.col("fps").alias("a"), F.explode(steps).alias("step"))
            .select(F.zip_with("tile", "step", lambda x, d: x + d).alias("other"),
                    F.aggregate("step", F.lit(0), lambda s, d: s + F.abs(d)).alias("far"), "piece", "a"))
    right = tiles.select(F.col("tile").alias("other"), F.col("piece").alias("piece_b"), F.col("fps").alias("b"))
    pairs = left.join(right, "other").filter("far > 0 or piece <= piece_b")
    pairs = pairs.select("a", "b", F.expr("far = 0 and piece = piece_b").alias("same"))

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            cols = [batch.column(k) for k in range(3)]
            out = []
            for k in range(batch.num_rows):
                a, b = (np.asarray(c[k].values).view(np.uint64) for c in cols[:2])
                u, v = _forest(a, b, radius, cols[2][k].as_py())
                if len(u):
                    out.append((u, v))
            if out:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return pairs.mapInArrow(meet, "a long, b long")


def components(fps: DataFrame, radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """``fps`` (any columns with doc_id, fp) with component_id: the smallest doc_id of the group.

    Documents are in one group when a chain of fingerprints, each within
    ``radius`` bits of the next, ties them.  A group without any doc_id has a
    null component_id.  ``group_fp`` names the group and is never null.
    """
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(firsts.select("fp"), radius, tile_rows))
    named = (firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("group_fp"), "first_id"))
    named = materialize(named)
    ids = named.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    return fps.join(named.select("fp", "group_fp").join(ids, "group_fp"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """(row identity, doc_id, fp, group_fp, component_id) for every row of ``docs`` (doc_id, text).

    A null or empty text, or one without words, has fingerprint zero and is
    linked like any other; fewer than ``width`` words make one shingle.
    Repeated rows get equal results.  An empty table gives no rows.
    """
    return components(materialize(fingerprints(docs, width)), radius, tile_rows)


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without near duplicates: of each group the document with the smallest
    doc_id stays (nulls last, then the smallest text hash), once."""
    found = near_duplicates(docs, width, radius)
    kept = found.groupBy("group_fp").agg(F.min(F.struct(*ROW_ID)).alias("k")).select("k.*")
    keyed = packed(docs).select("doc", *row_id())
    return keyed.join(kept, ROW_ID).dropDuplicates(ROW_ID).select("doc.*")


def hex_fp(c: str):
    return F.lpad(F.lower(F.hex(c)), 16, "0")
