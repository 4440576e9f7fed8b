"""Periodic runs of words, by suffix trees of texts and of their reversal."""

from itertools import compress, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A run is at least so many words long, and so many times its period.
SHORTEST = 6
REPEATS = 4
# Shingles by which stretches that may hold runs are found. With period q a run has at least
# max(6, 4q) words; so of each of its shingles of three words there are three in it at least,
# q words apart.
_SHINGLE = 3
_OCCURRENCES = 3
# Times that the shingles of a stretch are counted anew; what is left goes to the trees.
_ROUNDS = 12


def repetitive_stretches(ids):
    """(start, end) of all stretches that may hold a run, as arrays; `ids` numbers the words.

    A run consists of shingles that occur several times in it. So it lies whole in a stretch
    of consecutive shingles that are frequent, first in the text, then in the stretch itself.
    Nothing else is dropped: in a stretch that cannot be cut further every run is found.
    """
    import numpy as np

    least = SHORTEST - _SHINGLE + 1  # shingles of the shortest run
    starts, ends = np.zeros(1, dtype=np.int64), np.array([len(ids)], dtype=np.int64)
    frequent = np.bincount(ids, minlength=1)[ids] > _OCCURRENCES  # of words by themselves there are four
    done = []
    for _ in range(_ROUNDS):
        long_enough = ends - starts >= SHORTEST
        starts, ends = starts[long_enough], ends[long_enough]
        if not len(starts):
            break
        sizes = ends - starts
        stretch = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(stretch)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[stretch]
        # shingles within their stretch; a key for (stretch, word, word, word) by ranks
        whole = at + _SHINGLE <= ends[stretch]
        at, stretch = at[whole], stretch[whole]
        if frequent is not None:
            good = frequent[at]
            for k in range(1, _SHINGLE):
                good = good & frequent[at + k]
            at, stretch, frequent = at[good], stretch[good], None
        key = stretch
        for k in range(_SHINGLE):
            key = np.unique(key * (len(ids) + 1) + ids[at + k], return_inverse=True)[1]
        good = np.bincount(key, minlength=1)[key] >= _OCCURRENCES if len(key) else np.zeros(0, dtype=bool)
        at, stretch = at[good], stretch[good]
        # consecutive shingles make the new stretches
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
        last = np.r_[first[1:], len(at)] - 1 if len(first) else first
        new_starts, new_ends, parent = at[first], at[last] + _SHINGLE, stretch[first]
        same = (new_starts == starts[parent]) & (new_ends == ends[parent])
        done.append((new_starts[same], new_ends[same]))
        new = ~same & (last - first + 1 >= least)
        starts, ends = new_starts[new], new_ends[new]
    done.append((starts, ends))
    return np.concatenate([s for s, _ in done]), np.concatenate([e for _, e in done])


class SuffixTree:
    """The suffix tree of a sequence of numbers from 1 on, grown by Ukkonen's algorithm, with
    an Euler tour for the longest common extensions of any two places."""

    def __init__(self, symbols: list[int], width: int):
        """`width` is larger than every symbol. The end is marked by 0, the smallest."""
        self.size, self.width = len(symbols), width
        self._grow([*symbols, 0])
        self._walk()

    def _grow(self, s: list[int]) -> None:
        width, endless = self.width, len(s)
        start, end, link = [0], [0], [0]  # of the edge into each node; node 0 is the root
        to: dict[int, int] = {}  # node * width + first symbol of the edge -> node
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = to.get(key)
                if below is None:
                    to[key] = len(start)
                    start.append(i)
                    end.append(endless)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    at = start[below]
                    span = min(end[below], i + 1) - at
                    if length >= span:  # walk down
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[at + length] == c:  # already there: the rest waits
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    to[key] = split
                    to[split * width + c] = split + 1
                    to[split * width + s[at + length]] = below
                    start += (at, i)
                    end += (at + length, endless)
                    link += (0, 0)
                    start[below] = at + length
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.to = start, end, to

    def _walk(self) -> None:
        """The Euler tour: string depths of the nodes in the order of a walk, children by
        ascending symbols, that returns to a node after each child; and where the leaf of
        each suffix stands in it, which also ranks the suffixes."""
        import numpy as np

        keys = np.fromiter(self.to.keys(), dtype=np.int64, count=len(self.to))
        order = np.argsort(keys)
        below = np.fromiter(self.to.values(), dtype=np.int64, count=len(self.to))
        nodes, n = len(self.start), self.size + 1
        self.children = below[order].tolist()
        self.borders = np.searchsorted(keys[order] // self.width, np.arange(nodes + 1)).tolist()
        self.ends = keys[order] % self.width == 0
        span = (np.array(self.end) - np.array(self.start)).tolist()
        del self.start, self.end, self.to, keys, order, below
        children, borders = self.children, self.borders
        depth = self.depth = [0] * nodes
        tour, first = [], [0] * n
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            d = depth[node]
            low, high = borders[node], borders[node + 1]
            if low == high:
                first[n - d] = len(tour)
            tour.append(d)
            for at in range(high - 1, low - 1, -1):
                child = children[at]
                depth[child] = d + span[child]
                stack += (~node, child)
        self.tour = np.array(tour, dtype=np.int32)
        self.first = np.array(first, dtype=np.int64)

    def opposite_ranks(self) -> list[int]:
        """Ranks of the suffixes by descending symbols, an end still before all."""
        n, children, borders, depth, ends = self.size + 1, self.children, self.borders, self.depth, self.ends.tolist()
        ranks, rank, stack = [0] * n, 0, [0]
        while stack:
            node = stack.pop()
            low, high = borders[node], borders[node + 1]
            if low == high:
                ranks[n - depth[node]] = rank
                rank += 1
            elif ends[low]:
                stack += children[low + 1 : high]
                stack.append(children[low])
            else:
                stack += children[low:high]
        return ranks

    def common(self, a, b):
        """Lengths of the longest common beginnings of the suffixes at a and at b (arrays of
        unequal places): the depth of the lowest common ancestor, which is the least depth of
        the tour between the leaves. Minima over 2**k places are made level by level; each
        question takes two of one level, and no level is kept."""
        import numpy as np

        low, high = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        by_level = np.argsort(level, kind="stable")
        borders = np.searchsorted(level[by_level], np.arange(level.max(initial=0) + 2))
        found = np.zeros(len(low), dtype=np.int64)
        table = self.tour
        for k in range(len(borders) - 1):
            asked = by_level[borders[k] : borders[k + 1]]
            if len(asked):
                found[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k)])
            if (1 << k) < len(table):
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return found


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the end."""
    n = len(ranks)
    following = [n] * n
    open_places: list[int] = []
    for i, rank in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > rank:
            following[open_places.pop()] = i
        open_places.append(i)
    return following


def maximal_runs(ids):
    """(start, length, period) of all runs of a stretch of numbers, as rows.

    Under one of two opposite orders of the symbols, every run holds a Lyndon word as long
    as its smallest period, and the longest Lyndon word that begins there is that one; it
    ends before the next smaller suffix. So the longest Lyndon words of all places under
    both orders are the candidates. Each is extended to the right as far as the text agrees
    with itself a period later, by the tree of the text, and to the left by that of the
    reversal. What is long enough then is a run with this smallest period.
    """
    import numpy as np

    n = len(ids)
    symbols = np.unique(ids, return_inverse=True)[1] + 1
    width = int(symbols.max(initial=0)) + 1
    tree = SuffixTree(symbols.tolist(), width)
    root = np.tile(np.arange(n), 2)
    period = np.array(next_smaller(tree.first[:n].tolist()) + next_smaller(tree.opposite_ranks()[:n])) - root
    root, period = root[period * REPEATS <= n], period[period * REPEATS <= n]
    right = tree.common(root, root + period)
    del tree
    back = SuffixTree(symbols[::-1].tolist(), width)
    left = back.common(n - root, n - root - period)
    length = left + period + right
    long_enough = length >= np.maximum(SHORTEST, REPEATS * period)
    return np.unique(np.stack([root - left, length, period], axis=1)[long_enough], axis=0)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    import numpy as np

    if len(words) < SHORTEST:
        return []
    # a word's number is the place where it stands first
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))
    found = []
    for start, end in zip(*(x.tolist() for x in repetitive_stretches(ids))):
        for at, length, period in maximal_runs(ids[start:end]).tolist():
            found.append((start + at, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words, of each run the first period only."""
    import numpy as np

    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


_RUNS = "array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, runs (start, length, period), collapsed.

    Words stand between ASCII white space and are numbered from 0. A run is a stretch of
    consecutive words with smallest period q, at least max(6, 4q) of them, that no
    neighbouring word extends keeping the period; runs may overlap and come by start, then
    period. `collapsed` are the words, joined by one space, that no run contains after its
    first period. Texts are whole; the trees are grown of the stretches that can hold a run,
    those of repeated shingles.

    Null, empty and blank texts have no runs and collapse to an empty text. Repeated rows are
    rows of their own, a null id is passed on. An empty table gives no rows. Other columns
    are not looked at.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for batch in batches:
            for at in range(0, len(batch), 256):
                block = batch.slice(at, 256)
                texts = [(t or b"").split() for t in block.column(1).to_pylist()]
                runs = [runs_of(words) for words in texts]
                collapsed = [b" ".join(collapse(words, found)) for words, found in zip(texts, runs)]
                shown = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                columns = [block.column(0), pa.array(shown, pa.list_(run)), pa.array(collapsed, pa.binary()).view(pa.string())]
                yield pa.record_batch(columns, ["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return texts.mapInArrow(find, f"doc_id {id_type}, runs {_RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones of the smallest start, then period. Null
    without runs."""
    ordered = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ordered)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))
