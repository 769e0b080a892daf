"""Approximate nearest neighbours by cosine, on shifted Hilbert orderings.

Each ordering projects the unit vectors at random to a few dimensions, shifts
and quantises them, and takes the position on a Hilbert curve as key.  An
ordering is cut into key windows of about the same number of vectors; a query
meets the vectors of its own window and of the two beside it.  In Spark these
are groups of one window each, split into pieces of bounded size where the
table is large, so that vectors are compared where they lie and only each
query's nearest leave the task.  The nearest of all orderings are merged and
ranked by the exact cosine of the original vectors.

Equal vectors are one point: they are searched once, and stand in the result
by their smallest ids, which are all that can rank.  Cosines that agree to 12
decimals are ties, which go to the smaller id: multiples of one vector differ in
their last digits only.  Every tie at the border stays until ids are compared.

Cosine is defined between vectors of one length, and each length is searched by
itself: the most frequent lengths on orderings of their own, any others by
comparing all vectors of a length.

The share of vectors that a query meets follows from the number of orderings
and windows and not from the table's size, and recall with it.  For vectors
without structure, where the nearest are hardly nearer than others, the
defaults look at about half of the table for 0.95; that is what this method
needs there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.llm.common import ship
from kohort.session import materialize

ship(__name__)

DIMS, BITS = 12, 4  # a key of 48 bits
SAMPLE = 20_000  # vectors that window borders are fitted on
MIN_WINDOW = 64
PIECE = 4096
LENGTHS = 8  # vector lengths that get orderings
TIE = 12  # decimals
CHUNK = 1 << 21  # scores held at a time


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells``, by Skilling's transposition."""
    x = [c.astype(np.uint64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint64(b)) & np.uint64(1), turn ^ np.uint64((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << np.uint64(1)) | (((x[i] ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def fit(sample: np.ndarray, curves: int, windows: int, seed: int) -> dict:
    """Projections, shifts and window borders, from a sample of vectors."""
    rng, points = np.random.default_rng(seed), unit(sample)
    plan = {"project": [], "centre": [], "scale": [], "borders": []}
    for _ in range(curves):
        project = rng.standard_normal((points.shape[1], DIMS))
        flat = points @ project
        spread = flat.std(axis=0)
        plan["project"].append(project)
        plan["scale"].append(np.where(spread > 0, spread, 1.0))
        plan["centre"].append(flat.mean(axis=0) + plan["scale"][-1] * rng.uniform(-1, 1, DIMS))
        keys = np.sort(ordering(points, plan, len(plan["project"]) - 1))
        plan["borders"].append(keys[[len(keys) * k // windows for k in range(1, windows)]])
    return plan


def ordering(points: np.ndarray, plan: dict, curve: int) -> np.ndarray:
    flat = (points @ plan["project"][curve] - plan["centre"][curve]) / plan["scale"][curve]
    return hilbert_keys(np.clip((flat / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: with an id, and a vector that is not null, empty or zero and has finite
    components only.  Repeated rows count once; of different vectors with one id the smallest counts."""
    v = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()
                          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                          & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def nearest(scores: np.ndarray, most: int) -> list[np.ndarray]:
    """For each row, the places of its ``most`` largest scores and of all that tie with the last of them."""
    if scores.shape[1] <= most:
        return [np.arange(scores.shape[1])] * len(scores)
    least = np.partition(scores, -most, axis=1)[:, -most] - 10.0 ** -(TIE - 1)
    return [np.flatnonzero(row >= x) for row, x in zip(scores, least)]


def search(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = 32, windows: int = 128,
           seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose vec_id is divisible by ``every``.

    Nearest first, ties to the smaller vec_id; a query never finds itself, nor
    vectors of another length.  See ``usable`` for the rows that take part; an
    empty table gives no rows.
    """
    context = vectors.sparkSession.sparkContext
    rows = materialize(usable(vectors))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    points = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                         .select(F.col("ids")[0].alias("p"), "ids", "v"))
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).join(points.select("v", "p"), "v")
                          .select(F.col("vec_id").alias("query_id"), F.col("p").alias("q")))
    lengths = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS + 1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def shape(n: int, cut: int) -> dict:
        return {"windows": cut, "pieces": -(-n // (cut * PIECE)), "parts": -(-3 * n // (every * cut * PIECE))}

    plans = {}
    frequent = lengths[:LENGTHS]
    for d, n in frequent:
        cut = max(1, min(windows, n // MIN_WINDOW))
        sample = (points.filter(F.size("v") == d).select("v").orderBy(F.xxhash64("v"), "v")
                  .limit(SAMPLE // len(frequent)).collect())
        plans[d] = shape(n, cut) | {"curves": curves, "fit": fit(np.array([r.v for r in sample]), curves, cut, seed)}
    plan = context.broadcast((plans, shape(lengths[-1][1], 1) | {"curves": 1}))  # the latter for lengths without orderings

    asked = points.join(queries.select(F.col("q").alias("p")).distinct(), "p", "left_semi").withColumn("asks", F.lit(True))
    both = points.withColumn("asks", F.lit(False)).unionByName(asked).select("p", "v", "asks")

    def deal_length(part: pd.DataFrame, d: int) -> Iterator[pd.DataFrame]:
        at = plan.value[0].get(d, plan.value[1])
        cut, pieces, parts = at["windows"], at["pieces"], at["parts"]
        asks, ids = part["asks"].to_numpy(bool), part["p"].to_numpy()
        points_1 = unit(np.stack(part["v"].to_numpy())) if "fit" in at else None
        mixed = (ids * 0x2545F4914F6CDD1D >> 20) & 0x7FFFFFFF
        for c in range(at["curves"]):
            spot = np.zeros(len(ids), np.int64)
            if points_1 is not None:
                spot = np.searchsorted(at["fit"]["borders"][c], ordering(points_1, at["fit"], c), "right")
            out = []
            for step in (-1, 0, 1):  # a query goes to three windows and all their pieces
                for piece in range(pieces):
                    out.append((asks, spot + step, np.full(len(ids), piece), mixed % parts))
            for query_part in range(parts):
                out.append((~asks, spot, mixed % pieces, np.full(len(ids), query_part)))
            for take, window, piece, query_part in out:
                take = take & (window >= 0) & (window < cut)
                if take.any():
                    yield pd.DataFrame({"d": d, "window": (c * cut + window)[take], "piece": piece[take],
                                        "part": query_part[take], "p": ids[take], "asks": asks[take],
                                        "v": part["v"][take]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at:at + 2048]
                for d, same in part.groupby(part["v"].map(len)):
                    yield from deal_length(same, int(d))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        out = []
        if asks.any() and not asks.all():
            q_ids, c_ids = pdf["p"].to_numpy()[asks], pdf["p"].to_numpy()[~asks]
            q, c = unit(np.stack(pdf["v"][asks].to_numpy())), unit(np.stack(pdf["v"][~asks].to_numpy()))
            step = max(1, CHUNK // len(c_ids))
            for at in range(0, len(q), step):
                for row, found in enumerate(nearest(q[at:at + step] @ c.T, k + 1)):
                    exact = np.einsum("ij,j->i", c[found], q[at + row])
                    best = np.lexsort((c_ids[found], -exact.round(TIE)))[:k + 1]
                    out.append(pd.DataFrame({"q": q_ids[at + row], "p": c_ids[found][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "p": [], "score": []})

    element = dict(points.dtypes)["v"]
    dealt = both.mapInPandas(deal, f"d long, window long, piece long, part long, p long, asks boolean, v {element}")
    near = dealt.groupBy("d", "window", "piece", "part").applyInPandas(meet, "q long, p long, score double")
    near = near.groupBy("q", "p").agg(F.max("score").alias("score"))
    level = F.round("score", TIE).desc()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(level, "p"))).filter(F.col("r") <= k + 1)
    told = near.join(points.select("p", "ids"), "p").select("q", F.explode("ids").alias("vec_id"), "score")
    told = told.join(queries, "q").filter("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(level, "vec_id")
    return (told.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
