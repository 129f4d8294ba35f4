"""Stretches of consecutive words that repeat with a period, and the text without their repetitions.

Words become numbers, and a batch of texts one array in which every text ends with a number of its own, so that no
match crosses a text. Questions for the longest common extension of two places are answered from a sample: only
suffixes at the places of a difference cover are sorted. Two places compare a few words until both stand on the
sample, from where the least common prefix between their ranks is the answer (a sparse table over neighbours).

A run of period q that is three periods long holds two neighbours of the grid 0, q, 2q ... of its text, so the grids of
all periods, n/1 + n/2 + ... places, meet every run. The first grid place inside a run tells its end by one extension
and its start by a few more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import text_slices

_SLICE_BYTES = 1 << 20
_GRID_PLACES = 1 << 18
#: every difference modulo 13 is one of two of these
_MODULUS, _COVER = 13, (0, 1, 3, 9)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class CommonExtensions:
    """Longest common extensions in an array of numbers from 0 whose last one occurs once."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.symbols = np.concatenate([symbols, np.zeros(2 * _MODULUS, np.int64)])
        # the sampled places class by class, so that the next place of a class is one row on
        classes = [np.arange(c, self.size, _MODULUS) for c in _COVER]
        self.row_of_class = np.zeros(_MODULUS, np.int64)
        self.row_of_class[list(_COVER)] = np.cumsum([0, *map(len, classes[:-1])])
        self.first = np.array([next(d for d in _COVER if (d + k) % _MODULUS in _COVER) for k in range(_MODULUS)])
        self.places = np.concatenate(classes)
        self._sort()
        self._neighbours()

    def _keys(self) -> list[np.ndarray]:
        """The first words of every sampled suffix, several to a number."""
        bits = int(self.symbols.max()).bit_length()
        per = max(1, 62 // max(1, bits))
        keys = []
        for a in range(0, _MODULUS, per):
            key = self.symbols[self.places + a]
            for t in range(a + 1, min(a + per, _MODULUS)):
                key = (key << bits) | self.symbols[self.places + t]
            keys.append(key)
        return keys

    def _sort(self) -> None:
        """Sort the sample by its first words, then by twice as many while suffixes are equal. Ranks of all rounds stay."""
        keys = self._keys()
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        new[:1] = True
        heads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = heads
        self.ranks, step = [rank], 1
        while True:
            last = np.append(new[1:], True)
            tied = np.flatnonzero(~(new & last))  # in groups of two or more
            if not len(tied):
                break
            rows = order[tied]
            head, then = rank[rows], rank[rows + step]  # equal words hold no last word of a text: a next row exists
            by = np.lexsort((then, head))
            order[tied] = rows = rows[by]
            head, then = head[by], then[by]
            new[tied[1:]] |= (then[1:] != then[:-1]) & (head[1:] == head[:-1])
            heads = np.maximum.accumulate(np.where(new[tied], tied, 0))
            rank = rank.copy()
            rank[rows] = heads
            self.ranks.append(rank)
            step *= 2
        self.order, self.rank = order, rank

    def _neighbours(self) -> None:
        """Common prefixes of neighbours in rank, and their minima over spans of 1, 2, 4 ... of them."""
        a, b = self.order[:-1], self.order[1:]
        rows = np.zeros(len(a), np.int64)
        for h in reversed(range(len(self.ranks))):
            equal = np.flatnonzero(self.ranks[h][a + rows] == self.ranks[h][b + rows])
            rows[equal] += 1 << h
        common = rows * _MODULUS
        left, right = self.places[a] + common, self.places[b] + common
        common += self._few(left, right, np.full(len(left), _MODULUS))[0]
        self.minima, span = [common], 1
        while 2 * span <= len(common):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-span], below[span:]))
            span *= 2

    def _few(self, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from two places on, up to ``most``; and which pairs reached it."""
        found, at, t = np.zeros(len(left), np.int64), np.arange(len(left)), 0
        reached = []
        while len(at):
            full = most[at] == t
            reached.append(at[full])
            at = at[~full]
            at = at[self.symbols[left[at] + t] == self.symbols[right[at] + t]]
            t += 1
            found[at] = t
        return found, np.concatenate(reached) if reached else at

    def _row(self, places: np.ndarray) -> np.ndarray:
        return self.row_of_class[places % _MODULUS] + places // _MODULUS

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of equal words from ``left`` and ``right`` on, which are unlike places."""
        shift = (self.first[(right - left) % _MODULUS] - left) % _MODULUS
        found, synced = self._few(left, right, shift)
        if len(synced):
            a = self.rank[self._row(left[synced] + shift[synced])]
            b = self.rank[self._row(right[synced] + shift[synced])]
            low, span = np.minimum(a, b), np.abs(a - b)
            level = np.frexp(span.astype(np.float64))[1] - 1
            least = np.empty(len(synced), np.int64)
            for h in np.unique(level):
                at = np.flatnonzero(level == h)
                table = self.minima[h]
                least[at] = np.minimum(table[low[at]], table[low[at] + span[at] - (1 << h)])
            found[synced] += least
        return found


def _grids(starts: np.ndarray, sizes: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, start of its text) in parts: places x of each grid with x, x + q and x + 2q in the text."""
    most = sizes // repeats
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - 1) // period - 1
    ends = np.cumsum(count)
    done, a = 0, 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, done + _GRID_PLACES)))
        here = count[a:b]
        q, base = np.repeat(period[a:b], here), np.repeat(starts[text[a:b]], here)
        step = np.arange(len(q)) - np.repeat(ends[a:b] - here - done, here)
        yield base + step * q, q, base
        a, done = b, int(ends[b - 1])


def runs_of(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *, least_words: int, repeats: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted; places count over the whole array.

    ``symbols`` holds the texts one after another, each followed by a number that occurs nowhere else.
    """
    if repeats < 3:
        raise ValueError("grids meet every run from three periods on")
    sizes = np.where(sizes >= least_words, sizes, 0)
    common, found = None, []
    for x, q, base in _grids(starts, sizes, repeats):
        at = np.flatnonzero(symbols[x] == symbols[x + q])
        at = at[symbols[x[at] + q[at]] == symbols[x[at] + 2 * q[at]]]
        if not len(at):
            continue
        common = common or CommonExtensions(symbols)
        x, q, base = x[at], q[at], base[at]
        ahead = common.of(x, x + q)
        at = np.flatnonzero(ahead > q)
        x, q, base, ahead = x[at], q[at], base[at], ahead[at]
        # only the first grid place of a run goes on
        inner = np.flatnonzero(x > base)
        later = inner[common.of(x[inner] - q[inner], x[inner]) >= q[inner]]
        at = np.setdiff1d(np.arange(len(x)), later, assume_unique=True)
        x, q, base, ahead = x[at], q[at], base[at], ahead[at]
        # its start: the least y from which the words up to x repeat q words on
        low, high = np.where(x > base, x - q + 1, x), x.copy()
        while len(open_ := np.flatnonzero(low < high)):
            y = (low[open_] + high[open_]) // 2
            fits = common.of(y, y + q[open_]) >= x[open_] - y
            high[open_[fits]] = y[fits]
            low[open_[~fits]] = y[~fits] + 1
        end = x + q + ahead
        long = end - low >= np.maximum(least_words, repeats * q)
        found.append(np.stack([low, end, q], axis=1)[long])
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # the same stretch is found again with multiples of its smallest period
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers, every text closed by one of its own; starts and sizes of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    ends = starts + sizes
    symbols = np.empty(int(sizes.sum()) + len(texts), np.int64)
    closing = np.zeros(len(symbols), bool)
    closing[ends] = True
    symbols[~closing] = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    symbols[ends] = len(number) + np.arange(len(texts))
    return symbols, starts, sizes


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, by one blank."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(
    docs: DataFrame, *, text_col: str = "text", out: str = "periodic", least_words: int = 24, repeats: int = 3,
) -> DataFrame:
    """The rows with ``out``: a struct of ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text without what repeats.

    Words are what stands between blanks (tab to carriage return, space), told apart byte by byte. A run is a stretch
    of at least ``least_words`` words and ``repeats`` (3 or more) of its smallest period, that neither neighbour extends.
    ``collapsed`` has the words that no run holds behind its first period, by one blank each.

    A null or empty text has no words, no runs and an empty ``collapsed``. Equal rows are treated alike; an input column
    called ``out`` is replaced, others stay; an empty table stays empty. Texts are worked on whole, one at least at a
    time: memory is some hundred bytes a word of about 1 MB of text or of the longest text.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    if not isinstance(docs.schema[text_col].dataType, T.StringType):
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    kind = T.StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, collapsed string")
    run_arrow = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), _SLICE_BYTES):
                words = [(t or "").encode("utf-8").split() for t in texts]
                symbols, starts, sizes = _numbered(words)
                runs = runs_of(symbols, starts, sizes, least_words=least_words, repeats=repeats)
                bounds = np.searchsorted(runs[:, 0], [*starts, len(symbols)])
                local = runs.copy()
                local[:, :2] -= np.repeat(starts, np.diff(bounds))[:, None]
                collapsed = [
                    _collapsed(w, local[i:j]).decode("utf-8") for w, i, j in zip(words, bounds[:-1], bounds[1:], strict=True)
                ]
                listed = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(local[:, 0]), pa.array(local[:, 1] - local[:, 0]), pa.array(local[:, 2])], fields=list(run_arrow)
                    ),
                )
                struct = pa.StructArray.from_arrays(
                    [pa.array(sizes), listed, pa.array(collapsed, pa.string())], names=["n_words", "runs", "collapsed"]
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, out])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))
