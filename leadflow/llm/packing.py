"""Pack token sequences into fixed windows with best-fit decreasing.

A document is its token ids and an end id. Documents longer than a window are first cut into full windows;
what is left over is packed, longest piece first, into the open window that it fills most tightly. A segment
tree over the remaining capacities finds that window in a few steps. Every task packs its own rows in
buffers of bounded size, so nothing is shuffled and no task or driver holds more than a buffer.
"""

from __future__ import annotations

import operator
import os
import re
from collections.abc import Iterator
from itertools import compress, pairwise, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import give_back, process_cache, slice_bounds

_SLICE_CHARS = 2_000_000
_SLICE_BYTES = 8_000_000
_CACHED_WORDS = 400_000
_CACHED_STEMS = 100_000
#: characters for each string that a cache may hold
_CACHED_CHARS = 32
_TAIL = ".,!?;:()[]{}\"'*$%&#|-"
_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
_BLANK, _LETTER, _SIGN, _REST = range(4)
_KINDS = [_BLANK if b in b" \t\n\r\x0b\x0c" else _REST if b > 127 else _LETTER if chr(b).isalpha() else _SIGN for b in range(256)]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree that counts the windows under each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity that is ``need`` or more."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of piece numbers; no length is over ``window``."""
    windows: list[list[int]] = []
    open_windows = OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        found = open_windows.take_tightest(lengths[i])
        if found is None:
            capacity, w = window, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(i)
        if capacity > lengths[i]:
            open_windows.add(capacity - lengths[i], w)
    return windows


class _Recent:
    """Ids of recent strings, as bytes: two generations of a dict, so that memory is bounded and common ones stay."""

    def __init__(self, limit: int, encode):
        self.limit, self.encode, self.held = limit, encode, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, strings: list[str]) -> list[bytes]:
        """The ids of each of ``strings``."""
        if len(self.young) > self.limit or self.held > _CACHED_CHARS * self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        found = list(map(self.young.get, strings))
        places = [i for i, ids in enumerate(found) if ids is None]
        if places:
            missing = dict.fromkeys(strings[i] for i in places)
            self.held += sum(map(len, missing))
            kept = {s: self.old[s] for s in missing if s in self.old}
            self.young.update(kept)
            unseen = [s for s in missing if s not in kept]
            if unseen:
                self.young.update(self.encode(unseen))
            for i in places:
                found[i] = self.young[strings[i]]
        return found


class _Words:
    """Token ids of whole texts by way of their words.

    The tokenizer drops blanks and never merges over them, so a text's ids are its words' ids in order; each
    distinct word is encoded once. Special strings hold no blank and are met inside words as in whole texts.
    It also splits letters from what follows, so letters and the signs behind them are words of their own.
    """

    def __init__(self, path: str, cached: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: for runs of a to z, which no normalizer changes and no pattern cuts
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        #: tokens that end a run of letters, digits or signs
        self.final = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [s.lower().encode() for s in special]
        #: what a byte is, to cut words; inside special strings none is cut
        inside = {b for s in special for a, b in pairwise(s.encode()) if _KINDS[a] == _LETTER}
        self.kinds = bytes(_REST if b in inside and kind == _SIGN else kind for b, kind in enumerate(_KINDS))
        self.words = _Recent(cached or _CACHED_WORDS, self._encode_words)
        self.stems = _Recent(_CACHED_STEMS, self._encode_stems)
        self.tails = _Recent(_CACHED_STEMS, self._encode_any)

    def _encode_any(self, strings: list[str]):
        encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return zip(strings, (np.array(e.ids, "<u4").tobytes() for e in encoded), strict=True)

    def _encode_stems(self, stems: list[str], tokenizer=None):
        """Runs of letters: one call for all, cut behind each token that ends a run."""
        tokenizer = tokenizer or self.tokenizer
        ids = np.array(tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(stems):  # letters that this Python and the tokenizer class differently
            return self._encode_any(stems)
        raw, bounds = ids.tobytes(), (ends * 4).tolist()
        return zip(stems, (raw[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)), strict=True)

    def _encode_words(self, words: list[str]):
        plain = [w.isascii() and w.isalpha() and w.islower() for w in words]
        some = list(compress(words, plain))
        if some:
            yield from self._encode_stems(some, self.plain)
            words = list(compress(words, map(operator.not_, plain)))
        heads = list(map(str.rstrip, words, repeat(_TAIL)))
        # folding each letter is what the tokenizer does; a final sigma would fold by its place
        stems = ["".join(map(str.lower, h)) if "\u03a3" in h else h.lower() for h in heads]
        # a letter that is folded or taken apart may bring a mark of its own
        split = [h.isalpha() and s.isalpha() and (h.isascii() or normalize("NFC", s).isalpha()) for h, s in zip(heads, stems, strict=True)]
        odd = list(compress(words, map(operator.not_, split)))
        if odd:
            yield from self._encode_any(odd)
            words, heads, stems = (list(compress(some, split)) for some in (words, heads, stems))
        if words:
            tails = list(map(str.removeprefix, words, heads))
            yield from zip(words, map(operator.add, self.stems.of(stems), self.tails.of(tails)), strict=True)

    def ids(self, text: str) -> np.ndarray:
        return next(self.ids_of_column(pa.array([text], pa.string())))

    def _cut(self, raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that lie in ``raw`` one behind the other, and where each text's words begin and end.

        Cut at ASCII blanks and between an ASCII letter and an ASCII sign or digit. ASCII letters are folded, but not
        before a byte beyond ASCII, which may be a mark that only joins one of both cases.
        """
        data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(self.kinds), np.uint8)
        first = np.ones(len(data), bool)
        first[1:] = (kind[:-1] == _BLANK) | ((kind[:-1] == _LETTER) & (kind[1:] == _SIGN))
        first[bounds[bounds < len(data)]] = True
        kept = kind != _BLANK
        first &= kept
        lower = raw.lower()
        if not any(s in lower for s in self.special):  # they are told from their other cases
            whole, data = data, np.frombuffer(bytearray(lower), np.uint8)
            marked = np.flatnonzero(whole[1:] >= 128)
            data[marked] = whole[marked]
        data = data[kept]
        starts = np.append(np.flatnonzero(first[kept]), len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        return words, np.searchsorted(np.flatnonzero(first), bounds)

    def ids_of_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column without nulls. Numpy cuts the words and Arrow numbers them; only distinct
        ones become strings."""
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words, bounds = self._cut(b"".join(texts.cast(pa.binary()).to_pylist()), bounds)
        numbered = words.dictionary_encode()
        # words hold no line feed; one call and a split are quicker than a call for each
        distinct = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary)
        raw = self.words.of(pc.binary_join(distinct, "\n")[0].as_py().split("\n") if len(words) else [])
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, starts = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
        places = numbered.indices.to_numpy()
        counts = sizes[places]
        ends = np.cumsum(counts)
        # each id's place: that of its word's first id, and how far it is from it
        flat = ids[np.repeat(starts[places] - (ends - counts), counts) + np.arange(counts.sum())]
        bounds = np.concatenate([[0], ends])[bounds].tolist()
        return (flat[a:b] for a, b in pairwise(bounds))

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """The ids in parts, cut at blanks, so that a huge text never has all its ids in memory."""
        start = 0
        while len(text) - start > _SLICE_CHARS:
            cut = _BLANKS.search(text, start + _SLICE_CHARS)
            if cut is None:
                break
            yield self.ids(text[start : cut.start()])
            start = cut.start()
        yield self.ids(text[start:] if start else text)


def _words(path: str, cached: int | None = None) -> _Words:
    cache = process_cache("word ids")
    key = ("packing", path, cached)
    if key not in cache:
        cache[key] = _Words(path, cached)
    return cache[key]


class _Packer:
    """Pieces are (row, start, ids); emits (piece, window number, offset)."""

    def __init__(self, window: int, max_padding: int, buffer_tokens: int, base: int):
        self.window, self.max_padding, self.buffer_tokens = window, max_padding, buffer_tokens
        self.next_id, self.pieces, self.held, self.out = base, [], 0, []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((piece, self.next_id, offset))
            offset += len(piece[2])
        self.next_id += 1

    def add(self, piece: tuple) -> None:
        if len(piece[2]) == self.window:
            self.emit([piece])
            return
        self.pieces.append(piece)
        self.held += len(piece[2])
        if self.held >= self.buffer_tokens:
            self.flush()

    def flush(self, last: bool = False) -> None:
        """Pack the buffer. Windows left with much room are filled by cutting pieces at the window's end."""
        pieces, self.pieces, self.held = self.pieces, [], 0
        loose = []
        for members in best_fit_decreasing([len(p[2]) for p in pieces], self.window):
            filled = sum(len(pieces[i][2]) for i in members)
            if self.window - filled <= self.max_padding or not filled & (filled - 1):
                self.emit([pieces[i] for i in members])
            else:
                loose += [pieces[i] for i in members]
        rest = sum(len(p[2]) for p in loose)
        while rest:
            if rest < self.window and not last:
                self.pieces, self.held = loose, rest
                return
            # the very last window becomes windows of powers of two, which need no padding
            size = self.window if rest >= self.window else 1 << (rest.bit_length() - 1)
            taken, room = [], size
            while room:
                info, start, ids = loose[0]
                if len(ids) <= room:
                    taken.append(loose.pop(0))
                else:
                    taken.append((info, start, ids[:room]))
                    loose[0] = (info, start + room, ids[room:])
                room -= len(taken[-1][2])
            self.emit(taken)
            rest -= size

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    window: int = 4096, max_padding: int = 32, buffer_tokens: int = 4_194_304,
    slice_bytes: int = _SLICE_BYTES, cached_words: int | None = None,
) -> DataFrame:
    """One row per piece: the id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    The pieces of a sequence lie there without gaps from offset 0. A sequence lacks at most ``max_padding``
    tokens of a full window unless its length is a power of two. ``sequence_id`` is unique, not dense.

    A null or empty text has the end id alone. Rows with equal or null ids are separate documents. Other
    columns are left out; an empty table gives no rows. Very long texts are read in parts cut at blanks; their
    full windows go out as they fill, so memory is bounded by ``buffer_tokens`` and one text. Work follows the
    input's own partitions and order, so a task that runs again packs alike. ``slice_bytes`` of texts are cut into words
    at once and about twice ``cached_words`` words kept (400,000 unless given): less of either takes less memory and more time, the rows are the same.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path, cached_words)
        packer = _Packer(window, max_padding, buffer_tokens, TaskContext.get().partitionId() << 36)
        id_arrow = None

        def made(placed: list[tuple]) -> pa.RecordBatch:
            # info is [id, tokens of the whole document], complete by the time its pieces go out
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0][0] for p, _, _ in placed], id_arrow),
                    pa.array([p[1] for p, _, _ in placed], pa.int64()),
                    pa.array([len(p[2]) for p, _, _ in placed], pa.int64()),
                    pa.array([p[2].tobytes() for p, _, _ in placed], pa.binary()),
                    pa.array([p[0][1] for p, _, _ in placed], pa.int64()),
                    pa.array([w for _, w, _ in placed], pa.int64()),
                    pa.array([o for _, _, o in placed], pa.int64()),
                ],
                names=schema.names,
            )

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for a, b in slice_bounds(batch.column(1), slice_bytes):
                for piece in _pieces(words, names[a:b], pc.fill_null(batch.column(1).slice(a, b - a), ""), window, end_id):
                    packer.add(piece)
                if packer.out:
                    yield made(packer.drain())
        packer.flush(last=True)
        if packer.out:
            yield made(packer.drain())
        give_back()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(rows, schema)


def _pieces(words: _Words, names: list, texts: pa.Array, window: int, end_id: int) -> Iterator[tuple]:
    """The pieces of a slice of documents; a text too long for a slice comes alone."""
    if len(texts) == 1:
        yield from _cut(words, [names[0], 0], texts[0].as_py(), window, end_id)
        return
    end = np.array([end_id], "<u4")
    for name, ids in zip(names, words.ids_of_column(texts), strict=True):
        ids = np.concatenate([ids, end])
        info = [name, len(ids)]
        for i in range(0, len(ids), window):
            yield info, i, ids[i : i + window]


def _cut(words: _Words, info: list, text: str, window: int, end_id: int) -> Iterator[tuple]:
    if len(text) > _SLICE_CHARS:  # a first pass for the length, which every piece carries
        info[1] = sum(len(part) for part in words.stream(text)) + 1
    held, start = np.empty(0, "<u4"), 0
    for part in words.stream(text):
        held = np.concatenate([held, part]) if len(held) else part
        full = len(held) // window * window if len(text) > _SLICE_CHARS else 0
        for i in range(0, full, window):
            yield info, start + i, held[i : i + window]
        held, start = held[full:], start + full
    held = np.append(held, np.uint32(end_id)).astype("<u4")
    info[1] = start + len(held)
    for i in range(0, len(held), window):
        yield info, start + i, held[i : i + window]
