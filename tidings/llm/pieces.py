"""Operator 10, encoding with a sub-word model of merge type under seeded merge dropout, and lossless decoding.

A text is cut before each run of spaces (no piece of such a model has a space after another character). Inside a cut the
agenda holds the adjacent symbols whose union is a piece; the best-scored merge goes first, the leftmost of equal ones.
A candidate merge is skipped for good if a hash keyed by the seed, the document, the word's occurrence in it, the candidate's
place and its piece falls below the dropout rate. So every occurrence of a word has a draw of its own, and a rerun gives the
same pieces. At rate 0 the result is that of the model's own library.

Words of a batch are encoded together: one array step makes the next merge of every word. Distinct words are merged without
dropout first, and the candidates they offer on the way are noted; an occurrence that skips none of these gets that result, all
others are merged one by one. Words above
``LONG_WORD`` characters go through a heap, with the same result. Characters outside the vocabulary, and the model's
own space mark where it stands in a text, are written as bytes, so decoding gives back every text exactly.

Defined results: null counts as empty; an empty text has no piece; repeated rows with the same doc_id get the same
pieces; a null doc_id counts as 0; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import prepare, ship_file
from tidings.llm.words import mix, span_hashes

DROPOUT = 0.1
SEED = 20240229
LONG_WORD = 96
#: Characters of the words that are merged together.
PART_CHARS = 1 << 17
SPACE_MARK = "▁"
NO_MERGE = np.int64(1 << 62)
FREE = np.int64(-1)
# Bits of a slot that hold the piece.
PIECE_BITS = 21
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


class Model:
    """The pieces of a model, and which two pieces make which third."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ids = {m.id_to_piece(i): i for i in plain}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in ids):
            raise ValueError("a piece reaches across words")
        by_score = sorted(plain, key=lambda i: (-m.get_score(i), i))
        self.rank = np.zeros(n, np.int64)
        self.rank[by_score] = np.arange(len(by_score))
        self.of_rank = np.array(by_score, np.int64)
        self.byte0 = m.piece_to_id("<0x00>")
        self.bytes = [m.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(n)]
        for b in range(256):
            self.bytes[self.byte0 + b] = bytes([b])
        self.bytes_array = pa.array(self.bytes, pa.binary())
        merges = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        if n >= 1 << PIECE_BITS - 1:
            raise ValueError("more pieces than a slot has room for")
        self.size, self.merges = n, merges
        self.drawn = mix(np.arange(1, n + 1, dtype=_U))
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        self._index(self._key(pairs[:, 0], pairs[:, 1]), np.array(list(merges.values()), np.int64))
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE_MARK)]
        self.of_char[ord(SPACE_MARK)] = -1

    def _index(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """Pairs by hashed slot, a taken slot's pair in the next free one; at most half of the slots is used. A slot holds the pair
        and its piece as one number."""
        self.slots = 1 << (2 * len(keys)).bit_length()
        self.shift = _U(64 - self.slots.bit_length() + 1)
        self.slot = np.full(self.slots, FREE)
        at = self._slot(keys)
        while len(keys):
            free = self.slot[at] == FREE
            self.slot[at[free]] = keys[free] << PIECE_BITS | pieces[free]
            placed = self.slot[at] >> PIECE_BITS == keys
            keys, pieces, at = keys[~placed], pieces[~placed], (at[~placed] + 1) % self.slots

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs as numbers. An unknown symbol (-1) gives one that no pair of pieces has."""
        return left * (2 * self.size) + right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(_U) * _ODD) >> self.shift).view(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = self._key(left, right)
        at = self._slot(key)
        seen = self.slot[at]
        same = seen >> PIECE_BITS == key
        out = np.where(same, seen & ((1 << PIECE_BITS) - 1), -1)
        on = np.flatnonzero(~same & (seen != FREE))
        at = at[on]
        while len(on):
            at = (at + 1) % self.slots
            seen = self.slot[at]
            same = seen >> PIECE_BITS == key[on]
            out[on[same]] = seen[same] & ((1 << PIECE_BITS) - 1)
            more = ~same & (seen != FREE)
            on, at = on[more], at[more]
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _candidates(model: Model, places: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """What tells a word's candidates apart, as one number each."""
    return places.view(_U) * _ODD + model.drawn[pieces]


def _skipped(keys: np.ndarray, candidates: np.ndarray, rate: float) -> np.ndarray:
    if rate <= 0:
        return np.zeros(len(keys), bool)
    return mix(keys + candidates) < _U(min(int(rate * 2.0**64), 2**64 - 1))


def merge_one(model: Model, symbols: list[int], key: int, rate: float) -> list[int]:
    """One word by the agenda: symbols in a linked list, candidates in a heap."""
    n = len(symbols)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        piece = model.merges.get((sym[i], sym[j])) if j < n else None
        if piece is not None and not _skipped(np.array([key], _U), _candidates(model, np.array([i]), np.array([piece])), rate)[0]:
            heapq.heappush(agenda, (int(model.rank[piece]), i, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = model.merges[(a, b)], -2
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [s for s in sym if s != -2]


def merge_all(
    model: Model, symbols: np.ndarray, first: np.ndarray, keys: np.ndarray, rate: float, offered: list[tuple[np.ndarray, ...]] | None = None,
    neighbours: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words at once: ``symbols`` end to end, word ``w`` from ``first[w]`` to ``first[w + 1]``. Each step makes the next
    merge of every word that still has one. Gives the symbols that are left, their places, and
    the piece that each symbol makes with its neighbour at first (``neighbours``, if that is known already). ``offered`` takes the
    words and the numbers of all candidates."""
    n = len(symbols)
    # Behind the last place stands a symbol that joins with none.
    sym = np.append(symbols, -1).astype(np.int64)
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    nxt = np.arange(1, n + 1)
    nxt[first[1:] - 1] = n
    prv = np.arange(-1, n)
    prv[first[:-1]] = -1
    alive = np.ones(n, bool)
    best = np.full(n, NO_MERGE)

    def beside(at: np.ndarray) -> np.ndarray:
        return model.joined(sym[at], sym[nxt[at]])

    def offer(at: np.ndarray, piece: np.ndarray) -> None:
        able = piece >= 0
        best[at] = NO_MERGE
        at, piece = at[able], piece[able]
        if offered is not None or rate > 0:
            w = word[at]
            drawn = _candidates(model, at - first[w], piece)
            if offered is not None:
                offered.append((w, drawn))
            if rate > 0:
                going = ~_skipped(keys[w], drawn, rate)
                at, piece = at[going], piece[going]
        # Rank first, then place: the least value is the next merge.
        best[at] = (model.rank[piece] << 40) + at

    if neighbours is None:
        neighbours = beside(np.arange(n))
    if n:
        offer(np.arange(n), neighbours)
    starts, flat = first[:-1], np.arange(n)
    gone = 0
    while len(starts):
        least = np.minimum.reduceat(best[flat], starts)
        going = least < NO_MERGE
        at = least[going]
        if not len(at):
            break
        rank, at = at >> 40, at & ((1 << 40) - 1)
        right = nxt[at]
        sym[at] = model.of_rank[rank]
        alive[right], best[right] = False, NO_MERGE
        after = nxt[right]
        nxt[at] = after
        # The place behind the last one takes what is written to it and is never read.
        prv[after] = at
        before = prv[at]
        changed = np.concatenate([at, before[before >= 0]])
        offer(changed, beside(changed))
        # Words that are done leave, and merged places with them, when there are enough of either.
        gone += len(at)
        if 8 * gone > len(flat) or 4 * len(at) < 3 * len(starts):
            keep = alive[flat] & np.repeat(going, np.diff(np.append(starts, len(flat))))
            counts = np.add.reduceat(keep, starts, dtype=np.int64)[going]
            flat, gone = flat[keep], 0
            starts = np.cumsum(counts) - counts
    sym = sym[:-1]
    return sym[alive], np.flatnonzero(alive), neighbours


def merge_parts(
    model: Model, symbols: np.ndarray, first: np.ndarray, keys: np.ndarray, rate: float, offered: list[tuple[np.ndarray, ...]] | None = None,
    neighbours: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merge_all``, of as many words at a time as a processor's cache has room for."""
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1], PART_CHARS)), len(first) - 1))
    parts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = slice(first[a], first[b])
        noted: list[tuple[np.ndarray, ...]] | None = None if offered is None else []
        sym, places, beside = merge_all(model, symbols[at], first[a : b + 1] - first[a], keys[a:b], rate, noted, None if neighbours is None else neighbours[at])
        parts.append((sym, places + first[a], beside))
        if offered is not None:
            offered.extend((w + a, drawn) for w, drawn in noted or [])
    if not parts:
        return merge_all(model, symbols, first, keys, rate, offered, neighbours)
    sym, places, beside = (np.concatenate(x) for x in zip(*parts, strict=True))
    return sym, places, beside


def _with_bytes(model: Model, sym: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as pieces, unknown characters as the pieces of their bytes; and how many pieces each symbol has."""
    unknown = sym < 0
    width = np.where(unknown, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
    out = np.repeat(sym, width)
    at = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else width
    for w, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        those = np.flatnonzero(unknown & (width == w))
        for k in range(w):
            bits = chars[those] >> (6 * (w - 1 - k))
            out[at[those] + k] = model.byte0 + (bits | lead if k == 0 else (bits & 0x3F) | 0x80)
    return out, width


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its distinct word, and for each of those one occurrence.
    Words are told apart by a 64-bit hash of their bytes, and that all words equal their chosen one is then checked."""
    _, chosen, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    lengths = end - start
    same = np.array_equal(lengths[chosen][which], lengths)
    if same:
        source = np.repeat(start[chosen][which] - start, lengths) + np.arange(len(data))
        same = np.array_equal(data[source], data)
    if not same:
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        chosen = np.unique(which, return_index=True)[1]
    return which, chosen


def _dropping(offered: list[tuple[np.ndarray, ...]], n_words: int, which: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
    """Whether each occurrence skips any of the candidates that its word offers without dropout."""
    of, drawn = (np.concatenate(x) for x in zip(*offered, strict=True)) if offered else (np.zeros(0, np.int64), np.zeros(0, _U))
    drawn = drawn[np.argsort(of, kind="stable")]
    counts = np.bincount(of, minlength=n_words)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(len(which), bool)
    # As many occurrences at a time as bound the memory.
    for a in range(0, len(which), 1 << 16):
        words = which[a : a + (1 << 16)]
        n = counts[words]
        at = np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner = np.repeat(np.arange(len(words)), n)
        out[a + owner[_skipped(keys[a + owner], drawn[at], rate)]] = True
    return out


def _merged(
    model: Model, data: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float, offered: list[tuple[np.ndarray, ...]] | None = None,
    neighbours: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all words end to end, and how many each word has; where each word's characters begin, and what
    each of them makes with its neighbour. The words' bytes stand end to end in ``data``."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    leads = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(leads)])[np.concatenate([[0], np.cumsum(lengths)])]
    symbols = model.of_char[chars].astype(np.int64)
    long = np.flatnonzero(np.diff(first) > LONG_WORD)
    short_symbols = symbols.copy()
    for w in long:
        # Taken out here and merged one by one; unknown symbols never merge.
        short_symbols[first[w] : first[w + 1]] = -1
    sym, places, neighbours = merge_parts(model, short_symbols, first, keys, rate, offered, neighbours)
    owner = np.searchsorted(first, places, side="right") - 1
    pieces, width = _with_bytes(model, sym, chars[places])
    of_word = np.bincount(owner, weights=width, minlength=len(lengths)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(of_word)])
    special = {}
    for w in long:
        own = symbols[first[w] : first[w + 1]]
        left = merge_one(model, own.tolist(), int(keys[w]), rate)
        unknown_chars = iter(chars[first[w] : first[w + 1]][own < 0].tolist())
        special[int(w)] = np.concatenate([
            np.array([s]) if s >= 0 else model.byte0 + np.frombuffer(chr(next(unknown_chars)).encode(), np.uint8).astype(np.int64) for s in left
        ])
    if special:
        parts = [special.get(w, pieces[at[w] : at[w + 1]]) for w in range(len(lengths))]
        pieces = np.concatenate(parts)
        of_word = np.array([len(x) for x in parts])
    return pieces, of_word, first, neighbours


def encode_batch(model: Model, texts: list[str], doc_ids: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all texts end to end, and where each text's begin (one place more at the end)."""
    encoded = [b" " + t.encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    per_doc = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(per_doc))
    keys = mix(mix(doc_ids.astype(np.int64).view(_U) + _U(seed))[doc] + (np.arange(len(start)) - per_doc[doc]).astype(_U))
    which, chosen = _distinct(data, start, end)
    lengths = end - start

    def bytes_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lengths[at]
        return data[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    offered: list[tuple[np.ndarray, ...]] = []
    pieces, of_word, first, neighbours = _merged(model, *bytes_of(chosen), keys[chosen], 0.0, offered if rate > 0 else None)
    if rate > 0:
        # The heap notes no candidates: occurrences of a long word are all merged.
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        dropping = _dropping(offered, len(chosen), which, keys, rate) | (begun[end] - begun[start] > LONG_WORD)
        own = np.flatnonzero(dropping)
        if len(own):
            # An occurrence begins with the same candidates as its word.
            n = np.diff(first)[which[own]]
            begin = np.repeat(first[which[own]] - (np.cumsum(n) - n), n)
            more, of_more, *_ = _merged(model, *bytes_of(own), keys[own], rate, None, neighbours[begin + np.arange(len(begin))])
            which[own] = len(chosen) + np.arange(len(own))
            pieces, of_word = np.concatenate([pieces, more]), np.concatenate([of_word, of_more])
    at = np.concatenate([[0], np.cumsum(of_word)])
    counts = of_word[which]
    ends = np.cumsum(counts)
    out = pieces[np.repeat(at[which] - (ends - counts), counts) + np.arange(int(ends[-1]))]
    return out, np.concatenate([[0], ends])[per_doc]


def decode(model: Model, pieces: list[int]) -> str:
    """The text of a list of pieces."""
    return b"".join([model.bytes[i] for i in pieces]).decode()[1:]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Documents encoded together; equal words among them that skip nothing are encoded once.
GROUP_CHARS = 1_000_000


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > GROUP_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _encoded(name: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name))
        for batch in batches:
            texts, ids = _texts(batch.column("text")), _ids(batch.column("doc_id"))
            for a, b in _groups(texts):
                flat, first = encode_batch(model, texts[a:b], ids[a:b], rate, seed)
                pieces = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], pieces], [*batch.schema.names, "pieces"])

    return run


def decode_batch(model: Model, pieces: pa.ListArray) -> pa.Array:
    """The texts of a column of pieces, null where there are none."""
    data = model.bytes_array.take(pieces.flatten())
    ends = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1]
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    bounds = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    # The space that stands before every text goes.
    full = np.diff(bounds) > 0
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    raw = np.delete(raw, bounds[:-1][full])
    bounds = bounds - np.concatenate([[0], np.cumsum(full)])
    joined = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
    texts = joined.cast(pa.string())
    return pc.if_else(pieces.is_null(), pa.scalar(None, pa.string()), texts)


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name))
        for batch in batches:
            texts = decode_batch(model, batch.column("pieces"))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return run


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])


def encode(docs: DataFrame, model: str, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` with ``pieces``. ``model`` is the path of a model file; Spark hands it to the workers."""
    prepare(docs.sparkSession)
    ship_file(docs.sparkSession, model)
    picked = docs.select(F.col("doc_id").cast("long"), "text")
    return picked.mapInArrow(_encoded(os.path.basename(model), rate, seed), _schema(picked, "pieces array<int>"))


def decoded(pieces: DataFrame, model: str) -> DataFrame:
    """The table with ``decoded``, the text that each row's ``pieces`` stand for."""
    prepare(pieces.sparkSession)
    ship_file(pieces.sparkSession, model)
    return pieces.mapInArrow(_decoded(os.path.basename(model)), _schema(pieces, "decoded string"))
