"""Exact laws of small samples: r x c tables (Fisher) and rank sums (survey J8, J9, J11).

**Tables.**  The exact test adds up the probabilities of all tables with the
observed margins that are no likelier than the observed one.  It runs as a
network over the columns, one stage each: a node is the vector of row margins
that the columns not yet filled have left, the state of a path is the product of
1 / x! over the cells filled so far.  A stage spreads each node over the ways to
fill its column (bounded so that the rest can still be filled), then merges
paths that meet: same remaining margins, whose order does not matter, and same
product.  A column is filled cell by cell.  With the other cells filled so far
given, the longest continuation falls from some value of a cell on to either
side, and so does a bound on it by duality; where it is below the observed table
the cell's values are not walked through, but settled with the closed sum of all
their continuations, which is a tail of a hypergeometric law.  In the last column
to choose, what is left between the two tails of the last two cells is above the
observed table.  So the work goes with the tables that are likelier than the
observed one, less two cells, not with all tables.  A path whose shortest
continuation is above the observed table is dropped.  All variables go through
the stages together; nodes are rows of a table, which Spark deals out over tasks;
a node with more ways than a task should take goes out in pieces, each with its
own range of the cells.  The ways of a batch of nodes are walked through in
numpy, in parts of bounded size.

**Rank sums.**  Without ties, the number of ways in which samples of m and n have
the statistic w follows f(m, n, w) = f(m - 1, n, w - n) + f(m, n - 1, w).  The
recursion runs in array functions, one row a variable.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.stats import lgamma_sql
from kohort.session import materialize

TOLERANCE = math.log1p(1e-7)  # tables are as likely as the observed one up to this, as is customary
MAX_SIDE = 12        # levels that a node's vector has at most, if the table's other side allows
MAX_STAGES = 400     # with a bound on paths: levels of the other side, one stage each
MAX_ARCS = 50_000_000  # bound for callers that have another test: paths that one stage of one variable spreads to
ARCS_PER_PART, MAX_PARTS = 200_000, 2000  # a stage's work is dealt out over tasks of about so many paths
EXACT_BELOW = 50     # rank sums: the exact law holds for samples smaller than this


def _ways(total: int, places: int) -> float:
    return math.lgamma(total + places) - math.lgamma(total + 1) - math.lgamma(places)


def _sides(rows: list[int], cols: list[int]) -> tuple[list[int], list[int]]:
    """(node's vector, stages): the orientation with fewer paths; the largest stage comes last, as it is forced."""
    def cost(vector, stages):
        return sum(_ways(c, len(vector)) for c in sorted(stages)[:-1]), len(vector)
    vector, stages = min(((rows, cols), (cols, rows)), key=lambda o: (len(o[0]) > MAX_SIDE, cost(*o)))
    return sorted(vector), sorted(stages)


def fisher_rxc(cells: DataFrame, max_arcs: int | None = None) -> DataFrame:
    """Exact test of every variable's table: ``variable, n, p_value``, from cells ``(variable, level, grp, o)``.

    p adds the probabilities of the tables that are at most as likely as the observed one, relative tolerance
    1e-7.  A table with one row or column has p = 1.  No variables give no rows.

    Every table gets its p, whatever work that is.  For callers that have another test at hand, ``max_arcs``
    bounds it: p is then NULL for more than 12 levels on the smaller side, 400 on the other, or a stage of more
    paths than that.
    """
    spark = cells.sparkSession
    rows = cells.groupBy("variable", "level").agg(F.sum("o").alias("m"))
    cols = cells.groupBy("variable", "grp").agg(F.sum("o").alias("m"))
    # levels are counted before any list of them is made
    size = rows.groupBy("variable").agg(F.count("*").alias("nr"), F.sum("m").alias("n")).join(
        cols.groupBy("variable").agg(F.count("*").alias("nc")), "variable")
    within = F.lit(True) if max_arcs is None else (F.least("nr", "nc") <= MAX_SIDE) & (F.greatest("nr", "nc") <= MAX_STAGES)
    fits = materialize(size.withColumn("fits", within & (F.least("nr", "nc") > 1)))
    small = fits.filter("fits").select("variable")
    lists = [t.join(small, "variable").groupBy("variable").agg(F.collect_list("m").alias(c)) for t, c in ((rows, "r"), (cols, "c"))]
    seen = cells.join(small, "variable").groupBy("variable").agg(
        F.expr(f"-SUM({lgamma_sql('CAST(o AS DOUBLE) + 1D')})").alias("lobs"))
    tables = lists[0].join(lists[1], "variable").join(seen, "variable").collect()  # one row a variable, with its margins

    start, facts = [], []
    width = max([len(_sides(t.r, t.c)[0]) for t in tables], default=1)
    log_f = lambda values: sum(math.lgamma(v + 1) for v in values)
    for t in tables:
        vector, stages = _sides(t.r, t.c)
        k = len(vector)
        whole = math.lgamma(sum(vector) + 1) - log_f(vector) - log_f(stages)
        start.append((t.variable, [0] * (width - k) + vector, 0.0, 1.0))
        facts += [{} for _ in range(len(stages) - len(facts))]
        for i, c in enumerate(stages):
            later = Counter(stages[i + 1:])
            facts[i][t.variable] = (k, c, [*later], [*later.values()], t.lobs + TOLERANCE, whole)
    state = spark.createDataFrame(start, "variable string, v array<bigint>, past double, paths double")
    p = {}
    for known in facts:
        sums = spark.createDataFrame([(v, f[1], sum(f[3])) for v, f in known.items()], "variable string, c bigint, m int")
        state = state.join(F.broadcast(sums), "variable")  # a row a variable
        ways = F.expr(f"IF(m = 1, {_fewer(2)}, {_fewer(1)})")
        load = state.groupBy("variable").agg(F.sum(F.expr(_spread(1))).alias("arcs"), F.sum(ways).alias("work"),
                                             F.max(ways).alias("most")).collect()
        over = [r.variable for r in load if max_arcs is not None and r.arcs > max_arcs]
        if over:  # a variable that is given up keeps no part of its sum
            p |= dict.fromkeys(over)
            state = state.filter(~F.col("variable").isin(over))
        if len(load) == len(over):
            break
        load = [r for r in load if r.variable not in over]
        work = sum(r.work for r in load)
        share = max(ARCS_PER_PART, int(work // MAX_PARTS))
        if max(r.most for r in load) > share:
            pieces = _pieces(state.filter("m > 1"), width, share).unionByName(_pieces(state.filter("m = 1"), width, share, 2))
        else:
            pieces = state.selectExpr("*", *_whole(width))
        done = materialize(_stage(pieces, width, known, min(MAX_PARTS, int(work // ARCS_PER_PART) + 1)))
        for r in done.filter("settled").collect():  # a row a variable
            p[r.variable] = p.get(r.variable, 0.0) + r.total
        state = done.filter("not settled").select("variable", "v", "past", F.col("total").alias("paths"))
    found = spark.createDataFrame([(v, None if x is None else min(1.0, x)) for v, x in p.items()], "variable string, p double")
    return fits.join(found, "variable", "left").select("variable", F.col("n").cast("bigint").alias("n"), F.when(
        F.least("nr", "nc") == 1, F.lit(1.0)).otherwise(F.col("p")).alias("p_value"))


def _spread(forced: int, behind: str = "v", left: str = "c") -> str:
    """SQL: ways to fill the cells ``behind`` with ``left``, at most, where so many of the largest are not counted."""
    cells = f"slice(sort_array({behind}), 1, greatest(0, size({behind}) - {forced}))"
    return f"aggregate({cells}, 1D, (kq_a, kq_x) -> kq_a * (1D + least(kq_x, {left})))"


def _fewer(forced: int) -> str:
    """SQL: :func:`_spread`, or the ways to deal ``c`` out to as many cells without margins where these are fewer."""
    cells = f"greatest(0, size(filter(v, kq_x -> kq_x > 0)) - {forced})"
    return f"least({_spread(forced)}, aggregate(slice(sequence(1, {cells} + 1), 1, {cells}), 1D, (kq_a, kq_x) -> kq_a * (c + kq_x) / kq_x))"


def _whole(width: int) -> list[str]:
    return [f"array_repeat(0L, {width}) AS lo", f"array_repeat(c, {width}) AS hi"]


def _pieces(state: DataFrame, width: int, share: int | None = None, forced: int = 1) -> DataFrame:
    """``state`` with ``lo`` and ``hi``, bounds of each cell of the column to fill: a node of more than ``share``
    ways (``ARCS_PER_PART``) is cut into pieces of fewer, by ranges of the first cell, where need be by its single
    values and ranges of the next, and so on.  Together the pieces have the node's ways, each once.  The largest
    cell is not counted, as it is forced; of the last column to choose, whose two largest cells are settled
    together, two are not."""
    share = share or ARCS_PER_PART
    whole = state.filter(f"{_fewer(forced)} <= {share}").selectExpr("*", *_whole(width))
    out = state.filter(f"{_fewer(forced)} > {share}").selectExpr("*", *_whole(width), "c AS kq_left", "false AS kq_done")
    for i in range(width - forced):
        behind = _spread(forced, f"slice(v, {i + 2}, {width})", "kq_left")
        out = out.selectExpr("*", f"{behind} AS kq_behind", f"least(v[{i}], kq_left) AS kq_to",
                             f"greatest(0L, kq_left - aggregate(slice(v, {i + 2}, {width}), 0L, (kq_a, kq_x) -> kq_a + kq_x)) AS kq_from")
        out = out.selectExpr("*", f"CAST(greatest(1D, floor(least(kq_to + 1D, {share} / kq_behind))) AS BIGINT) AS kq_step")
        out = out.selectExpr("*", "explode(IF(kq_done, array(0L), sequence(least(kq_from, kq_to), kq_to, kq_step))) AS kq_at")
        out = out.withColumns({
            "lo": F.expr(f"IF(kq_done, lo, transform(lo, (kq_x, kq_i) -> IF(kq_i = {i}, kq_at, kq_x)))"),
            "hi": F.expr(f"IF(kq_done, hi, transform(hi, (kq_x, kq_i) -> IF(kq_i = {i}, least(kq_at + kq_step - 1, kq_to), kq_x)))"),
            "kq_left": F.expr("IF(kq_done, kq_left, kq_left - kq_at)"),
            "kq_done": F.expr(f"kq_done OR kq_behind <= {share}")}).drop("kq_behind", "kq_to", "kq_from", "kq_step", "kq_at")
    return whole.unionByName(out.drop("kq_left", "kq_done"))


def _spreader(width: int, facts: dict):
    """Task code of a stage, as a closure that travels by value: nodes in, the nodes that they lead to out.
    ``facts`` has of each variable the number of its cells, the column's sum, the sums of the later columns and how
    often each occurs, the observed table's bar and the logarithm of all tables' sum."""
    import itertools
    import math

    import numpy as np

    part = 1 << 15
    small = np.array([math.lgamma(x + 1) for x in range(256)])

    def lgamma(z):
        """log Gamma of positive numbers: Stirling's series behind a shift by 10."""
        w = z + 10.0
        series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
        return (w - 0.5) * np.log(w) - w + 0.9189385332046728 + series - sum(np.log(z + k) for k in range(10))

    def log_factorial(x):
        w = np.maximum(x, 255).astype(float)
        large = (w + 0.5) * np.log(w) - w + 0.9189385332046728 + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
        return np.where(x < 256, small[np.minimum(x, 255)], large)

    def held(f, lo, hi):
        """``f`` of the integers from ``lo`` to ``hi``, looked up unless there are many."""
        if hi - lo >= 1 << 18:
            return f
        values = f(np.arange(lo, hi + 1))
        return lambda x: values[x - lo]

    def conjugate(theta):
        """The largest theta y - log y! of any count y."""
        y = np.floor(np.exp(theta))
        return y * theta - log_factorial(y.astype(np.int64))

    def tails(w, x, stop, a, b, left):
        """Sum of w over x, x - 1, .., stop, where w goes with 1 / (x! (left - x)! (a - x)! (b - left + x)!) and falls:
        to 0 where that has no value, below stop otherwise by force."""
        short = (stop > np.maximum(left - b, 0)).any()
        room, least = (x - stop).astype(float), w * 1e-13
        up, down = [t.astype(float) for t in (x, b - left + x)], [t + 1.0 for t in (left - x, a - x)]
        total = w.sum()
        for step in itertools.count(1):
            w = w * ((up[0] * up[1]) / (down[0] * down[1]))
            for t in up:
                t -= 1
            for t in down:
                t += 1
            if short:
                w[room < step] = 0
            total += w.sum()
            if step % 8 == 0:
                on = w > least
                if not on.any():
                    return total
                if on.mean() < 0.8:
                    w, room, least = w[on], room[on], least[on]
                    up, down = [t[on] for t in up], [t[on] for t in down]

    def turn(lo, hi, guess, holds):
        """Where between ``lo`` and ``hi``, false and true, ``holds`` comes to be so; it looks from ``guess`` on in
        doubled steps, then halves."""
        way = np.where(hi < lo, -1, 1)
        lo, hi = lo * way, hi * way
        at, step = np.clip(guess * way, lo, hi), np.ones(len(lo), np.int64)
        first = None  # did it hold at the guess?
        while True:
            open_ = hi - lo > 1
            if not open_.any():
                return hi * way
            at = np.where(open_, np.clip(at, lo + 1, hi - 1), hi)
            yes = holds(at * way)
            if first is None:
                first, far = yes, np.ones(len(lo), bool)
            lo, hi = np.where(open_ & ~yes, at, lo), np.where(open_ & yes, at, hi)
            far &= yes == first
            at, step = np.where(far, np.where(first, at - step, at + step), (lo + hi) >> 1), step * 2

    def fill(v, least, most, past, paths, k, c, later, many, bar, whole):
        """Parts of the ways to fill a column with c under the margins v, a row a node, as (rest, product, paths); at the
        end the probability of the ways that are settled.  Cells are filled one by one: the longest continuation
        falls from some value on to either side, and what is below the observed table there is settled at once."""
        later, many = np.array(later, float), np.array(many, float)
        m, n = many.sum(), (later * many).sum()
        tilt = np.log((later + k / 2) / (n + m * k / 2))  # multipliers of the later columns' sums
        outside = (many * later * tilt).sum()
        low = -(many * log_factorial(later.astype(np.int64))).sum()
        high = -(many * k * lgamma(later / k + 1)).sum()

        def bound(u):  # a row's part of the bound on continuations that leave it u, by duality
            at = np.log(u + m / 2)
            return sum((w * conjugate(at + t) for w, t in zip(many, tilt)), -u * at)

        tail = np.cumsum(v[:, ::-1], axis=1)[:, ::-1]
        close = np.cumsum(log_factorial(v)[:, ::-1], axis=1)[:, ::-1]
        # a way may be settled only behind the last cell that the piece has a part of
        apart = np.where((least > 0) | (most < np.minimum(v, c)), np.arange(k), -1).max(axis=1)
        near = lambda f, u: held(f, max(0, int(u.min()) - c), int(u.max()))
        filled = held(log_factorial, 0, c)
        rests, bounds = [near(log_factorial, v[:, i]) for i in range(k)], [near(bound, v[:, i]) for i in range(k)]
        done = 0.0

        def parts(rows, rest, left, was, top, each, lo, hi):
            """The next cell gets each value from lo to hi: ways so far, in parts of bounded size."""
            i = rest.shape[1]
            while (hi - lo).max(initial=0) >= part:  # a long range is cut in two
                middle = (lo + hi) // 2
                rows, rest, left, was, top, each = (np.concatenate([t, t]) for t in (rows, rest, left, was, top, each))
                lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
            count = np.maximum(hi - lo + 1, 0)
            ends = np.cumsum(count)
            at = 0
            while at < len(count):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part, "right")))
                some = count[at:stop]
                h = np.repeat(np.arange(at, stop), some)
                x = np.arange(len(h)) - np.repeat(np.cumsum(some) - some, some) + lo[h]
                u = v[rows[h], i] - x
                if len(h):
                    yield (rows[h], np.concatenate([rest[h], u[:, None]], axis=1), left[h] - x, was[h] - filled(x),
                           top[h] + bounds[i](u), each[h] - rests[i](u))
                at = stop

        zero = np.zeros(len(v))
        todo = [iter([(np.arange(len(v)), np.zeros((len(v), 0), np.int64), np.full(len(v), c), past, zero, zero)])]
        while todo:
            rows, rest, left, was, top, each = next(todo[-1], (None,) * 6)
            if rows is None:
                todo.pop()
                continue
            i = rest.shape[1]
            if i == k - 1:  # the last cell is forced
                u = v[rows, i] - left
                rest, was = np.concatenate([rest, u[:, None]], axis=1), was - filled(left)
                each, top = each - rests[i](u), top + bounds[i](u) - outside
                # longest: by duality, or the later columns or the rows' rests shared out evenly (log x! is convex);
                # shortest: all in one cell, by columns or rows
                top = np.minimum(np.minimum(top, high), -m * lgamma(rest / m + 1.0).sum(axis=1))
                under, over = was + top <= bar, was + np.maximum(low, each) > bar
                done += (paths[rows] * np.exp(was + math.lgamma(n + 1) + each + low - whole))[under].sum()
                keep = ~under & ~over
                if keep.any():
                    yield np.sort(rest[keep], axis=1), was[keep], paths[rows[keep]]
                continue
            a, b = v[rows, i], tail[rows, i + 1]
            lo, hi = np.maximum(np.maximum(least[rows, i], left - b), 0), np.minimum(np.minimum(a, left), most[rows, i])
            some = lo <= hi
            if not some.all():
                rows, rest, left, was, top, each, a, b, lo, hi = (t[some] for t in (rows, rest, left, was, top, each, a, b, lo, hi))
            if not len(rows):
                continue

            def longest(x):
                """Bound on the longest continuation with x in this cell, and the factors that the bound's linear part
                puts on the cell and the rest of the column: where they fall, so does the bound, from x on."""
                u, l = a - x, left - x
                if i == k - 2:
                    out = was - filled(x) - filled(l)
                    if m == 1:  # the last column is forced: no bound, but its value, which is concave
                        return out + each - rests[i](u) - rests[i + 1](b - l), None, None
                    return out + top + bounds[i](u) + bounds[i + 1](b - l) - outside, u + m / 2, b - l + m / 2
                still, cells = (b - l) / np.maximum(b, 1), k - 1 - i
                free = (l + cells / 2) / (b - l + cells * m / 2)
                out = was - filled(x) + top + bounds[i](u) - outside - l * np.log(free)
                for j in range(i + 1, k):
                    w = v[rows, j]
                    guess = np.rint(w * still).astype(np.int64)
                    at = np.log(guess + m / 2)
                    out = out + bounds[j](guess) - (w - guess) * at + conjugate(at + np.log(free))
                return out, (u + m / 2) * free, None

            def below(x):
                """Is every way with x here, or less, under the observed table?"""
                x = np.clip(x, lo, hi)
                out, mine, other = longest(x)
                falls = True if mine is None else x <= mine if other is None else x * other <= (left - x + 1) * mine
                return (out <= bar) & falls

            def above(x):
                x = np.clip(x, lo, hi)
                out, mine, other = longest(x)
                falls = True if mine is None else mine <= x + 1 if other is None else (left - x) * mine <= (x + 1) * other
                return (out <= bar) & falls

            mode = np.clip((left + 1.0) * (a + 1) // (a + b + 2), lo - 1, hi).astype(np.int64)
            may = apart[rows] <= i
            # near the mode the logarithm falls with the square of the distance
            reach = np.sqrt(2 * np.maximum(longest(np.clip(mode, lo, hi))[0] - bar, 0) / (
                1 / (mode + 1.0) + 1 / (left - mode + 1.0) + 1 / (a - mode + 1.0) + 1 / (b - left + mode + 1.0)))
            reach = np.minimum(reach, hi - lo + 1).astype(np.int64)
            first = np.where(may, turn(mode + 1, lo - 1, mode - reach, below), lo - 1)
            last = np.where(may, turn(np.maximum(mode, first), hi + 1, mode + reach, above), hi + 1)
            # the closed sum of all continuations, in the values of this cell
            base = was + each + log_factorial(b) - close[rows, i + 1] + math.lgamma(n + 1) + low - whole
            other = rests[i + 1] if i == k - 2 else log_factorial
            for up in (False, True):
                on = np.flatnonzero(last <= hi if up else first >= lo)
                x, l, one, two = (last if up else first)[on], left[on], a[on], b[on]
                w = paths[rows[on]] * np.exp(base[on] - filled(x) - filled(l - x) - rests[i](one - x) - other(two - l + x))
                if len(on):
                    done += tails(w, l - x, l - hi[on], two, one, l) if up else tails(w, x, lo[on], one, two, l)
            if m > 1 or i < k - 2:
                todo.append(parts(rows, rest, left, was, top, each, first + 1, last - 1))
        yield done

    def run(batches):
        import pyarrow as pa

        def nodes(name, settled, v, past, total):
            lists = np.concatenate([np.zeros((len(v), width - v.shape[1]), np.int64), v], axis=1).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(lists) + 1, width, dtype=np.int32)), pa.array(lists))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array([settled] * len(v)), vectors,
                                               pa.array(past), pa.array(total)], names=["variable", "settled", "v", "past", "total"])
        for batch in batches:
            names = batch.column("variable").dictionary_encode()
            of = names.indices.to_numpy()
            v, least, most = (batch.column(x).flatten().to_numpy().reshape(-1, width) for x in ("v", "lo", "hi"))
            past, paths = (batch.column(x).to_numpy() for x in ("past", "paths"))
            for code, name in enumerate(names.dictionary.to_pylist()):
                mine, k = np.flatnonzero(of == code), facts[name][0]
                for found in fill(v[mine, -k:], least[mine, -k:], most[mine, -k:], past[mine], paths[mine], *facts[name]):
                    if isinstance(found, float):
                        yield nodes(name, True, np.zeros((1, k), np.int64), np.zeros(1), np.array([found]))
                        continue
                    rest, was, ways = found
                    key = np.concatenate([rest, (np.round(was, 10) + 0.0).view(np.int64)[:, None]], axis=1)
                    _, at, same = np.unique(key, axis=0, return_index=True, return_inverse=True)
                    yield nodes(name, False, rest[at], was[at], np.bincount(same.ravel(), weights=ways, minlength=len(at)))
    return run


def _stage(state: DataFrame, width: int, facts: dict, parts: int) -> DataFrame:
    """(variable, settled, v, past, total): the nodes that a column's ways lead to, with the paths that meet in each;
    where ``settled``, the probability that the stage decided."""
    rows = state.select("variable", "v", "past", "paths", "lo", "hi")
    rows = rows.repartition(parts, "variable", "v", "past", "lo") if parts > 1 else rows
    out = rows.mapInArrow(_spreader(width, facts), "variable string, settled boolean, v array<bigint>, past double, total double")
    # products are the same up to rounding; the one that goes on is not rounded, as its errors would add up
    return out.groupBy("variable", "settled", "v", F.round("past", 10).alias("kq_past")).agg(
        F.min("past").alias("past"), F.sum("total").alias("total"))


def rank_sum_exact_sql(w: str, n1: str, n2: str) -> str:
    """Two-sided exact p of the statistic ``w`` of untied samples of ``n1`` and ``n2``: twice the smaller tail, 1 at
    most.  SQL text over row values; the counts are kept as far as the tail reaches."""
    low, high = f"CAST(least({n1}, {n2}) AS INT)", f"CAST(greatest({n1}, {n2}) AS INT)"
    tail = f"CAST(least({w}, {n1} * {n2} - {w}) AS INT)"
    one = f"concat(array(1D), array_repeat(0D, {tail}))"
    shifted = f"slice(concat(array_repeat(0D, kq_j), kq_f[kq_j]), 1, {tail} + 1)"
    inner = (f"aggregate(sequence(1, {high}), array({one}), (kq_g, kq_j) -> concat(kq_g, array("
             f"zip_with({shifted}, kq_g[kq_j - 1], (kq_x, kq_y) -> kq_x + kq_y))))")
    ways = f"aggregate(sequence(1, {low}), array_repeat({one}, {high} + 1), (kq_f, kq_i) -> {inner}, kq_f -> kq_f[{high}])"
    choices = f"aggregate(sequence(1, {low}), 1D, (kq_a, kq_i) -> kq_a * ({high} + kq_i) / kq_i)"
    return f"least(1D, 2D * aggregate({ways}, 0D, (kq_a, kq_x) -> kq_a + kq_x) / {choices})"
