"""Encoding of a corpus with a byte-level BPE vocabulary (problem 7).

Texts of a batch are laid end to end as an array of code points. Each code point gets a class, classes get
one or two code points of lookahead folded in, and the boundaries of pre-tokens are the states of a small
automaton. The states come from an associative scan: transition functions are composed along the columns of
a matrix for all its rows at once, the rows' functions are chained, and the states are filled in. Slices are
merged pairwise once per distinct slice and cached. No regular expression is involved.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points of one scan, and distinct slices kept by a worker before the cache starts anew.
CHUNK, CACHED = 1 << 20, 400_000

# Code points with the Unicode property White_Space.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Symbols of the automaton. A blank that is the last of its run (something follows) differs from others.
OTHER, LETTER, NUMBER, BLANK_LAST, BLANK, SPACE_LAST, SPACE, QUOTE_2, QUOTE_3, END = range(10)
# States: fresh (text start or after a contraction), after a letter, number or other, after U+0020,
# after other white space, one and two letters of a contraction to come.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES, SYMBOLS = 8, 10


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by symbol and state."""
    step, start = np.zeros((SYMBOLS, STATES), np.uint8), np.zeros((SYMBOLS, STATES), bool)
    for s in range(STATES):
        for sym, inside in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (QUOTE_2, IN_OTHER), (QUOTE_3, IN_OTHER)):
            start[sym, s] = s not in (inside, AFTER_BLANK, ONE_MORE, TWO_MORE)
            step[sym, s] = FRESH if s == ONE_MORE else ONE_MORE if s == TWO_MORE else inside
        for sym, state in ((QUOTE_2, ONE_MORE), (QUOTE_3, TWO_MORE)):
            if s not in (IN_OTHER, AFTER_BLANK):
                step[sym, s] = state
        for sym, after in ((BLANK_LAST, AFTER_BLANK), (BLANK, AFTER_BLANK), (SPACE_LAST, AFTER_SPACE), (SPACE, AFTER_SPACE)):
            step[sym, s] = after
            start[sym, s] = sym in (BLANK_LAST, SPACE_LAST) or s not in (AFTER_BLANK, AFTER_SPACE)
    return step, start


STEP, START = _automaton()
_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """Class of every code point; built once from the Unicode tables."""
    global _classes
    if _classes is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        category = unicodedata.category
        for cp in range(sys.maxunicode + 1):
            c = category(chr(cp))[0]
            if c == "L":
                table[cp] = LETTER
            elif c == "N":
                table[cp] = NUMBER
        table[_SPACES] = SPACE
        table[0x20] = BLANK
        _classes = table
    return _classes


def scan_states(symbols: np.ndarray, step: np.ndarray = STEP, first: int = FRESH, width: int = 256) -> np.ndarray:
    """State before each symbol, by composing transition functions (an associative scan in two levels)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    width = min(width, n)
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, k = step.ravel().astype(np.uint8), step.shape[1]
    function = np.broadcast_to(np.arange(k, dtype=np.uint8), (rows, k)).copy()
    for column in grid:
        function = flat[(column.astype(np.intp) * k)[:, None] + function]
    begin, at = np.empty(rows, np.uint8), first
    for r, f in enumerate(function.tolist()):
        begin[r] = at
        at = f[at]
    out, now = np.empty((width, rows), np.uint8), begin
    for c, column in enumerate(grid):
        out[c] = now
        now = flat[column.astype(np.intp) * k + now]
    return out.T.ravel()[:n]


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points laid end to end; ``ends`` are the positions where texts end (exclusive)."""
    cls = code_point_classes()[points]
    last = np.zeros(len(points), bool)
    last[ends[ends > 0] - 1] = True
    white = (cls == SPACE) | (cls == BLANK)
    solid_next = np.r_[~white[1:], False] & ~last
    sym = cls.copy()
    sym[white & solid_next & (cls == BLANK)] = BLANK_LAST
    sym[white & solid_next & (cls == SPACE)] = SPACE_LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        text_end = ends[np.searchsorted(ends, quotes, "right")]
        pad = np.r_[points, 0, 0]
        one, two = np.where(quotes + 1 < text_end, pad[quotes + 1], 0), np.where(quotes + 2 < text_end, pad[quotes + 2], 0)
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_2
        pairs = np.isin(one * 256 + np.where(two < 128, two, 0), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        sym[quotes[pairs]] = QUOTE_3
    return sym


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of all texts."""
    sym = symbols_of(points, ends)
    # A text's first symbol meets the state FRESH whatever was before, so texts are scanned with END between them.
    starts = np.r_[0, ends[:-1]]
    order = np.arange(len(points)) + np.searchsorted(starts[1:], np.arange(len(points)), "right")
    spaced = np.full(len(points) + len(ends), END, np.uint8)
    spaced[order] = sym
    states = scan_states(spaced)[order]
    return np.flatnonzero(START[sym, states])


class Vocabulary:
    """Ranks of a byte-level BPE; ids are ranks. Merged slices are cached as (offset, length) of one array."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.used = [], 0
        self.size: list[int] = []

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one slice: the pair of lowest rank is merged again and again, leftmost first."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.pairs.get, 1 << 30
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap of candidate pairs and linked positions, for slices of any length."""
        n, get = len(ids), self.pairs.get
        after, behind, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                behind[after[i]] = i
                if (x := get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (h := behind[i]) >= 0 and (x := get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _add(self, word: bytes) -> int:
        ids = self.merge(word)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin.append(self.used)
        self.size.append(len(ids))
        self.used += len(ids)
        self.index[word] = code = len(self.begin) - 1
        return code

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = boundaries(points, ends)
        data = joined.encode("utf-8", "surrogatepass")
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.r_[0, np.cumsum(width)]
        cuts = np.r_[at[starts], len(data)].tolist()
        if len(self.index) > CACHED:
            self._forget()
        get, add = self.index.get, self._add
        codes = np.fromiter((c if (c := get(w)) is not None else add(w) for w in (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))), np.int64, len(starts))
        begin, size = np.array(self.begin, np.int64)[codes], np.array(self.size, np.int64)[codes]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
        text_of = np.searchsorted(ends, starts, "right")
        return ids, np.bincount(text_of, size, len(texts)).astype(np.int64)

    def token_bytes(self, ids: np.ndarray) -> np.ndarray:
        lengths = np.zeros(len(self.ranks), np.int64)
        for i, b in self.tokens.items():
            lengths[i] = len(b)
        return lengths[ids]

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are; invalid bytes become U+FFFD."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary per worker process and content."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def in_chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of about CHUNK code points; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least three tasks a core, for work whose time by far outweighs a shuffle of its rows."""
    n = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def encode(df: DataFrame, key: str, text: str, vocabulary_file: str = DEFAULT_VOCABULARY, *, offsets: bool = False, counts: bool = False) -> DataFrame:
    """(key, ids): token ids of each text, without special tokens.

    Null and empty texts have an empty list; strings of special tokens are ordinary text. Repeated rows and
    keys, also null ones, each give a row; other columns are left out; no text is too long. With ``offsets``
    also ``ends``, the byte offset at which each token ends, so that spans can be mapped back; with
    ``counts`` only (key, n_tokens). The vocabulary, at most a few MB, is sent to the workers once.
    """
    with open(vocabulary_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, " + ("n_tokens long" if counts else "ids array<int>" + ", ends array<int>" * offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            done, keys = 0, batch.column(0)
            for part in in_chunks(batch.column(1).to_pylist()):
                ids, n = v.encode(part)
                own = keys.slice(done, len(part))
                done += len(part)
                if counts:
                    yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64())], [key, "n_tokens"])
                    continue
                cuts = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                out = [own, pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))]
                if offsets:
                    size = v.token_bytes(ids)
                    ends = np.cumsum(size)
                    before = np.r_[0, ends][np.r_[0, np.cumsum(n)][:-1]]
                    out.append(pa.ListArray.from_arrays(cuts, pa.array((ends - np.repeat(before, n)).astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [key, "ids", "ends"][: len(out)])

    return spread(df.select(key, F.col(text).cast("string").alias("_text"))).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, vocabulary_file: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids); an empty or null list gives an empty text."""
    with open(vocabulary_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            texts = [v.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
