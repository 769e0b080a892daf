"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One inserted or deleted letter moves a word's vector of letter counts by 1 (L1
distance), one replaced letter by 2, and a word's length by at most one.  So the
words near a word of length L lie within 2 of its vector among the words of length
L and within 1 among those of length L + 1 (or L - 1, seen from the other side).

The search has two levels.  The upper tree splits the space of (length, letter
counts) into cells of about PER_CELL words; its planes come from a bounded
sample of words, and nothing else does.  Every word lies in one cell and asks all
cells whose box its balls reach.  In a cell, one task builds a tree for every
length, asks it with the words of that length and of the one below, prunes by the
boxes, compares letter counts in the leaves and then the order of the letters.
Cells are cut into pieces of a bounded number of letters on either side, so that a
task's memory does not depend on how many words share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import ascii_lower, hash_share, ship
from kohort.session import materialize

ship(__name__)

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 90  # a-z, then 64 classes for all other characters; equal classes only make boxes wider
PER_CELL = 32768  # words of a cell, as far as the sample tells
SAMPLE = 65536  # words that the upper tree's planes are read from, at most
MAX_CELLS = 16384
POINT_LETTERS, QUERY_LETTERS = 1 << 21, 1 << 22  # letters of a piece's points and queries, about
LEAF = 96
QUERIES_AT_ONCE = 32768
LONGEST = 4000  # in the upper tree, longer words count as so long
FAR = 8  # what one letter of length is worth there: more than any radius


# --- words --------------------------------------------------------------------

def occurrences(docs: DataFrame, pattern: str = RUN) -> DataFrame:
    """(doc_id, run): every maximal run of letters of every text, A-Z lower-cased; null texts have none."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(pattern), F.lit(0))).alias("run"))


def thinned(doc_id: Column, run: Column) -> Column:
    """The query's rule: with h the crc32 of ``doc_id:run``, a run loses its code point h % length if 97 divides h;
    runs without a doc_id stay as they are."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of the column ``word`` with that length and count at least; null is none."""
    return (words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))


# --- trees --------------------------------------------------------------------

def code_points(words: list[str], length: int) -> np.ndarray:
    """Matrix of the code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Vector of letter counts of every row."""
    column = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 64).astype(np.int64)
    rows = np.arange(len(codes))[:, None] * LETTERS
    return np.bincount((rows + column).ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS)


class Tree:
    """k-d tree over rows of whole numbers, with a box for every node.

    ``unit`` is the least distance of two different values in each column.  Tight boxes bound the rows of a
    node; the others, which together fill the space, are what the planes above leave."""

    def __init__(self, rows: np.ndarray, leaf: int, unit: np.ndarray | None = None):
        kind = rows.dtype
        limits = np.iinfo(kind)
        self.lo, self.hi, self.child, self.rows = [], [], [], []
        todo = [(np.arange(len(rows)), np.full(rows.shape[1], limits.min, kind), np.full(rows.shape[1], limits.max, kind), -1, 0)]
        while todo:
            held, lo, hi, parent, side = todo.pop()
            here = len(self.lo)
            if parent >= 0:
                self.child[parent][side] = here
            part = rows[held]
            if unit is None and len(held):
                lo, hi = part.min(axis=0), part.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([-1, -1])
            self.rows.append(held)
            if len(held) <= leaf:
                continue
            column = int(part.var(axis=0).argmax())
            values = part[:, column]
            low, high = values.min(), values.max()
            if low == high:
                continue
            at = np.sort(values)[(len(values) - 1) // 2]
            if at == high:
                at = values[values < high].max()
            left = values <= at
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[column] = at
            right_lo[column] = at + (1 if unit is None else unit[column])
            self.rows[here] = None
            todo.append((held[left], lo, left_hi, here, 0))
            todo.append((held[~left], right_lo, hi, here, 1))
        self.lo, self.hi, self.child = np.array(self.lo), np.array(self.hi), np.array(self.child)

    def reached(self, queries: np.ndarray, radius: int, beyond: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``queries`` within ``radius`` of its box); ``beyond`` is a distance that counts everywhere."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, held = todo.pop()
            x = queries[held]
            away = np.abs(x - np.clip(x, self.lo[node], self.hi[node])).sum(axis=1, dtype=np.int32)
            if beyond is not None:
                away += beyond[held]
            held = held[away <= radius]
            if not len(held):
                continue
            if self.child[node, 0] < 0:
                yield node, held
            else:
                todo += [(self.child[node, 0], held), (self.child[node, 1], held)]


def place(words: list[str], add: int = 0) -> np.ndarray:
    """Rows of the upper tree's space: the length (plus ``add``) and the letter counts."""
    out = np.zeros((len(words), 1 + LETTERS), np.int32)
    lengths = np.array([len(w) for w in words], np.int64)
    out[:, 0] = FAR * np.minimum(lengths + add, LONGEST)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at, 1:] = letter_counts(code_points([words[k] for k in at], int(length)))
    return out


def upper_tree(words: DataFrame, total: int) -> Tree:
    """The cells, from the SAMPLE words with the smallest hash, of about twice as many."""
    few = words.select("word").filter(hash_share(F.col("word"), SAMPLE, total))
    some = [r.word for r in few.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    cells = min(MAX_CELLS, -(-total // PER_CELL))
    unit = np.ones(1 + LETTERS, np.int32)
    unit[0] = FAR
    return Tree(place(some), max(1, -(-len(some) // max(1, cells))), unit)


def routed(words: DataFrame, tree: Tree) -> DataFrame:
    """(cell, asks, word, n): each word once in its cell (asks = false), and once in every cell that it asks."""
    sent = words.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        tree = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                words = part.column(0).to_pylist()
                own, longer = place(words), place(words, 1)

                def rows(node, held, asks):
                    word, n = part.take(pa.array(held)).columns
                    return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), node, np.int32)),
                                                       pa.array(np.full(len(held), asks)), word, n], names=names)
                for node, held in tree.reached(own, 0):
                    yield rows(node, held, False)
                asked = {}
                for places, radius in ((own, 2), (longer, 1)):
                    for node, held in tree.reached(places, radius):
                        asked[node] = np.union1d(asked[node], held) if node in asked else held
                for node, held in asked.items():
                    yield rows(node, held, True)

    names = ["cell", "asks", "word", "n"]
    return words.select("word", "n").mapInArrow(run, "cell int, asks boolean, word string, n long")


# --- one piece of a cell --------------------------------------------------------

class Side:
    """Words of one length: their places in the piece, code points and letter counts."""

    def __init__(self, words: list[str], at: np.ndarray, length: int):
        self.at = at
        self.codes = code_points([words[k] for k in at], length)
        if self.codes.max(initial=0) < 1 << 16:
            self.codes = self.codes.astype(np.uint16)
        counts = letter_counts(self.codes)
        self.counts = counts.astype(np.int8 if length < 120 else np.int32)


def _unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Each count c as c ones and then zeros, ``most`` numbers for each column: a dot product is the size of the
    letters that two words share."""
    column = np.repeat(np.arange(len(most)), most)
    step = np.arange(len(column)) - np.repeat(np.cumsum(most) - most, most)
    return (counts[:, column] > step).astype(np.float32)


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of b is the row of a with one more letter."""
    same, shifted = a == b[:, :-1], a == b[:, 1:]
    upto = np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))
    return (shifted | (np.arange(a.shape[1]) < upto[:, None])).all(axis=1)


def near_pairs(points: Side, asking: Side, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asking, rows of points) one edit apart; points are as long (radius 2) or one longer (radius 1)."""
    length = asking.codes.shape[1]
    used = points.counts.any(axis=0)
    spots, queries = points.counts[:, used], asking.counts[:, used]
    beyond = asking.counts[:, ~used].sum(axis=1, dtype=np.int32)
    tree = Tree(np.ascontiguousarray(spots), LEAF)
    most = np.maximum(spots.max(axis=0), 0).astype(np.int64)
    shared = length if radius == 1 else length - 1  # letters, or classes, that the two words have in common at least
    test = _one_inserted if radius == 1 else _one_replaced
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[start:start + QUERIES_AT_ONCE]
        for node, held in tree.reached(part, radius, beyond[start:start + QUERIES_AT_ONCE]):
            leaf = tree.rows[node]
            for lo in range(0, len(leaf), 4096):
                some = leaf[lo:lo + 4096]
                right = _unary(spots[some], most).T
                step = max(1, (1 << 20) // len(some))
                for k in range(0, len(held), step):
                    q = held[k:k + step]
                    i, j = np.nonzero(_unary(part[q], most) @ right >= shared)
                    i, j = q[i] + start, some[j]
                    size = max(1, (1 << 22) // max(1, length))
                    for m in range(0, len(i), size):
                        a, b = i[m:m + size], j[m:m + size]
                        ok = test(asking.codes[a], points.codes[b])
                        yield a[ok], b[ok]


def searched(words: list[str], n: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have words near, how many, row of the best of them): what one piece of a cell adds to its words."""
    lengths = np.array([len(w) for w in words])
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def tell(a, b):
        near[:] += np.bincount(a, minlength=len(words))
        np.minimum.at(best, a, rank[b])
    for length in np.unique(lengths[~asks]):
        points = Side(words, np.flatnonzero(~asks & (lengths == length)), int(length))
        for shorter, radius in ((length, 2), (length - 1, 1)):
            at = np.flatnonzero(asks & (lengths == shorter))
            if not len(at) or not shorter:
                continue
            asking = Side(words, at, int(shorter))
            for i, j in near_pairs(points, asking, radius):
                a, b = asking.at[i], points.at[j]
                tell(a, b)
                if radius == 1:  # a word of the same length asks back by itself, a longer one doesn't
                    tell(b, a)
    hit = np.flatnonzero(near)
    return hit, near[hit], np.array(order, np.int64)[best[hit]]


# --- the operator -------------------------------------------------------------

def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) for every word of ``words`` (word, n; each word once) that has words one edit
    away: how many, and the one of the largest n (ties: the smallest in code-point order)."""
    total = words.count()
    asked = routed(words, upper_tree(words, total))
    sizes = asked.groupBy("cell").agg(*[F.sum(F.when(F.col("asks") == k, F.length("word")).otherwise(0)).alias(c)
                                        for k, c in ((False, "p"), (True, "q"))]).collect()  # MAX_CELLS rows or a few more
    cut = [(r.cell, -(-r.p // POINT_LETTERS), -(-r.q // QUERY_LETTERS)) for r in sizes if r.p]
    pieces = F.broadcast(words.sparkSession.createDataFrame(cut, "cell int, n_points int, n_queries int"))
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("n_queries")).otherwise(F.col("n_points"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("n_points")).otherwise(F.col("n_queries")) - 1))
    dealt = asked.join(pieces, "cell").filter("n_queries > 0").withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("cell", F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")).alias("point_piece"),
                         F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other")).alias("query_piece"), "asks", "word", "n")

    def one(piece):
        import pyarrow as pa
        word, n = piece["word"].combine_chunks(), piece["n"].combine_chunks()
        hit, near, best = searched(word.to_pylist(), n.to_numpy(), piece["asks"].to_numpy())
        return pa.table({"word": word.take(pa.array(hit)), "n_near": near, "near_n": n.take(pa.array(best)),
                         "near": word.take(pa.array(best))})
    found = dealt.groupBy("cell", "point_piece", "query_piece").applyInArrow(
        one, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by(
        F.struct("near_n", "near"), F.struct(-F.col("near_n"), F.col("near"))).alias("b")).select("word", "n_near", "b.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form), without circles: the last form that is reached from a word.

    Each turn doubles the steps that every word has gone, so chains of 2^k forms take k turns."""
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("then"))
        state = materialize(state.join(ahead, "root", "left").select(
            "word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        if state.filter("moved").limit(1).count() == 0:
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every row of ``words`` (word, n; each word once).

    n_near counts the words one edit away (one code point inserted, deleted or replaced).  ``form`` is the one
    with the largest n, ties the smallest in code-point order, if that n is at least ``ratio`` (2 or more) times
    the word's; else null, as is form_n.  ``root`` is the last form that is reached from the word; n grows at
    each step, so there is one.  An empty table gives no rows; words have a letter at least.
    """
    words = materialize(words.select("word", "n"))
    found = words.join(neighbours(words), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.when(fits, F.col("near")).alias("form"),
                                     F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n")))
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
