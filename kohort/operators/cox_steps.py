"""Newton steps of a Cox fit on packed moments (survey K10).

The collapsed table ``(t, x..., d, m)`` is range-partitioned once by falling time
and written, each partition sorted.  A step then needs no shuffle:

1. every partition adds up its packed moments S0, S1, S2 (one array, whatever the
   number of covariates) and those of its first and last time;
2. the driver turns the totals into what lies behind each partition.  A time
   with very many rows may stretch over several partitions; such border times are
   settled there, from their sums;
3. every partition walks its other times from the last to the first with a
   running risk set and yields its share of the log likelihood, score and
   information as one array.

A table of one partition skips 1 and 2.  Efron's d steps of a time with d deaths
need sums over k of 1/q, 1/q^2 and their products with k/d only, q being the risk
set's sum less k/d of the deaths'; the moments enter once for each time.  A task
holds one Arrow batch and a few p x p matrices; the driver 1 + p + p^2 numbers for
each partition and border.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.session import materialize

ROWS_PER_PART = 200_000
MAX_PARTS = 512


def laid_out(suf: DataFrame, cols: list[str], rows: int) -> tuple[DataFrame, int]:
    """The table in falling order of time over so many range partitions, written once."""
    parts = int(min(MAX_PARTS, -(-max(rows, 1) // ROWS_PER_PART)))
    t = F.col("t").cast("double") if dict(suf.dtypes)["t"] not in ("date", "timestamp") else F.col("t").cast("timestamp").cast("double")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols]) if cols else F.array().cast("array<double>")
    packed = suf.select(t.alias("t"), x.alias("x"), F.col("d").cast("double").alias("d"), F.col("m").cast("double").alias("m"))
    if parts == 1:
        return materialize(packed.coalesce(1).sortWithinPartitions(F.desc("t"))), 1
    # the hash lets Spark's borders cut a time that holds many rows
    spread = packed.repartitionByRange(parts, F.desc("t"), F.xxhash64("x"))
    return materialize(spread.sortWithinPartitions(F.desc("t"))), parts


def _functions():
    """Functions of a step, as closures that travel to the tasks by value."""
    import numpy as np

    def moments(batches, beta):
        """(t, [S0, S1, S2] of its rows, its deaths' [D0, D1, D2], XD, DE, d) for every time, from the last on."""
        p = len(beta)
        held = None
        for batch in batches:
            t, d, m = (batch.column(c).to_numpy() for c in ("t", "d", "m"))
            x = batch.column("x").flatten().to_numpy().reshape(len(t), p)
            eta = x @ beta
            w = np.exp(eta)
            cut = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]])
            mw, dw = m * w, d * w
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if i == j:
                    continue
                part = x[i:j]
                a = mw[i:j]
                risk = [a.sum(), a @ part, (part * a[:, None]).T @ part]
                dead = d[i:j]
                number = dead.sum()
                if number > 0:
                    b = dw[i:j]
                    gone = [b.sum(), b @ part, (part * b[:, None]).T @ part, dead @ part, dead @ eta[i:j], number]
                else:
                    gone = None
                if held is not None and held[0] == t[i]:
                    held[1] = [u + v for u, v in zip(held[1], risk)]
                    held[2] = gone if held[2] is None else held[2] if gone is None else [u + v for u, v in zip(held[2], gone)]
                else:
                    if held is not None:
                        yield held
                    held = [t[i], risk, gone]
        if held is not None:
            yield held

    def share(risk, gone):
        """(log likelihood, score, information) of one time with deaths."""
        s0, s1, s2 = risk
        d0, d1, d2, xd, de, number = gone
        ll, u, info = de, xd.astype(float), np.zeros_like(s2)
        sums = np.zeros(5)
        for at in range(0, int(number), 1 << 20):  # Efron's steps, as sums of numbers alone
            f = np.arange(at, min(at + (1 << 20), int(number))) / number
            q = s0 - f * d0
            ll -= np.log(q).sum()
            sums += [(1 / q).sum(), (f / q).sum(), (1 / q**2).sum(), (f / q**2).sum(), (f**2 / q**2).sum()]
        a, b, a2, b2, c2 = sums
        u = u - s1 * a + d1 * b
        cross = np.outer(s1, d1)
        info = s2 * a - d2 * b - (np.outer(s1, s1) * a2 - (cross + cross.T) * b2 + np.outer(d1, d1) * c2)
        return ll, u, info

    return moments, share


def _totals(beta: np.ndarray):
    moments, _ = _functions()
    p = len(beta)
    n = 1 + p + p * p

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        first = last = total = None
        for t, risk, gone in moments(batches, beta):
            entry = np.concatenate([[t], [risk[0]], risk[1], risk[2].ravel(), np.zeros(n + p + 2) if gone is None else
                                    np.concatenate([[gone[0]], gone[1], gone[2].ravel(), gone[3], [gone[4], gone[5]]])])
            first = entry if first is None else first
            last = entry
            total = entry[1:1 + n] if total is None else total + entry[1:1 + n]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              **{k: pa.array([v.tobytes()], pa.binary()) for k, v in
                                                 (("total", total), ("first", first), ("last", last))}})
    return run


def _shares(beta: np.ndarray, behind):
    """``behind``: broadcast of what lies behind each partition, or None for a table of one partition."""
    moments, share = _functions()
    p = len(beta)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        s = [0.0, np.zeros(p), np.zeros((p, p))]
        ends = ()
        if behind is not None:
            # a partition without rows has no entry
            offset, ends = behind.value.get(TaskContext.get().partitionId(), (np.zeros(1 + p + p * p), ()))
            s = [offset[0], offset[1:1 + p], offset[1 + p:].reshape(p, p)]
        ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
        for t, risk, gone in moments(batches, beta):
            s = [a + b for a, b in zip(s, risk)]
            if gone is not None and t not in ends:
                one = share(s, gone)
                ll, u, info = ll + one[0], u + one[1], info + one[2]
        out = np.concatenate([[ll], u, info.ravel()])
        yield pa.RecordBatch.from_pydict({"v": pa.array([out.tobytes()], pa.binary())})
    return run


def newton_parts(table: DataFrame, parts: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information at ``beta``, from a table of :func:`laid_out`."""
    p = len(beta)
    beta = np.asarray(beta, float)
    n = 1 + p + p * p
    result = np.zeros(n)
    behind = None
    if parts > 1:
        sums = table.mapInArrow(_totals(beta), "part int, total binary, first binary, last binary").collect()
        rows = [(r.part, *(np.frombuffer(r[c]) for c in ("total", "first", "last"))) for r in sorted(sums, key=lambda r: r.part)]
        offsets, before, borders = {}, np.zeros(n), {}
        for part, total, first, last in rows:
            offsets[part] = (before, (first[0], last[0]))
            for entry, above in ((first, before), (last, before + total - last[1:1 + n])):
                if entry is last and first[0] == last[0]:
                    continue
                if entry[0] in borders:  # the time goes on from the partition before
                    borders[entry[0]][1] = borders[entry[0]][1] + entry[1:]
                else:
                    borders[entry[0]] = [above, entry[1:]]
            before = before + total
        _, share = _functions()
        for above, sums in borders.values():
            if sums[-1] <= 0:
                continue
            s = above + sums[:n]
            g = sums[n:]
            one = share([s[0], s[1:1 + p], s[1 + p:].reshape(p, p)],
                        [g[0], g[1:1 + p], g[1 + p:n].reshape(p, p), g[n:n + p], g[n + p], g[n + p + 1]])
            result += np.concatenate([[one[0]], one[1], one[2].ravel()])
        behind = table.sparkSession.sparkContext.broadcast(offsets)
    for r in table.mapInArrow(_shares(beta, behind), "v binary").collect():  # one row a partition
        result += np.frombuffer(r.v)
    if behind is not None:
        behind.destroy()
    return float(result[0]), result[1:1 + p].copy(), result[1 + p:].reshape(p, p).copy()
