"""Operator 4, scoring by a class-based bigram model in the manner of Brown.

``P(word | before) = P(class | class before) * P(word | class)``. Tokens are words (A-Z as a-z) and one end per text, which is a
class of its own and stands before the first word.

- **Counts** of all training words are made by key, over the whole corpus.
- **Classes** come from exchange clustering of all training words. It starts from coarse units: the words that make up at least
  1/``UNIT_SHARE`` of the tokens, each by itself, and buckets of the last three bytes for all others. From there every training word
  has a class of its own. The vocabulary is dealt by hash to parts of about ``PART_WORDS`` words, each a row with its words' bigrams, packed;
  before a sweep parts send each other the classes along the bigrams they share, one byte each, and in a sweep each word goes to
  the class that gains most likelihood: the frequent words one after another on the driver, the class counts following at once, all
  others in tasks against the broadcast class pair counts, half of them (by hash) in each sweep, so that words alike don't swap
  places, and of equally good classes each takes one by hash, so that they don't all crowd into one. The assignment is a table; that of the best likelihood is kept. Suffix buckets decide for words never seen in training only:
  such a word gets the class that most training words of its bucket have.
- **Smoothing**: transitions add ``TRANSITION_PRIOR`` to each class pair; in a class of T tokens and V words a word seen c times
  has (c + 1) / (T + V + 1), which leaves 1 / (T + V + 1) for words never seen.

Scores need a count and a class for every word. Words of at least 1/``KNOWN_SHARE`` of the tokens (at most ``KNOWN_SHARE`` words) go
to the workers as a table of bounded size; all others are asked for in the parts they are in, once per document and word, in packed
questions of a batch of documents to a part. So no part has a frequent word. Words are told apart by 64-bit hashes.

Gains are differences of doubles, and classes within 1e-9 count as equal, so words with nearly equal choices may go elsewhere when the number of parts
changes.

Defined results: null counts as empty; an empty text is one token, its end; repeated rows stay and all count; a null doc_id
is training data; other columns are ignored; without training texts every count is 0 and the one class is all there is; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import BATCH_ROWS, held_by_crc, prepare
from tidings.llm.words import batch_bytes, mix, word_spans
from tidings.session import drop_tables, shuffles_dropped, written

UNIT_SHARE = 1024
SUFFIXES = 512
KNOWN_SHARE = 1 << 16
CLASSES = 32
SWEEPS = 6
TRANSITION_PRIOR = 0.5
#: Tokens counted together in a task before they are handed on.
PENDING = 2_000_000
WORD_PENDING = 1_000_000
#: Words whose moves a task weighs together.
CHUNK = 2048
#: Words of a part of the vocabulary, about.
PART_WORDS = 25_000
#: Places in a word's profile: classes of words before it, classes after it, and, behind them, itself after itself.
OWN = 2 * (CLASSES + 1)

_U = np.uint64
END_HASH = np.uint64(0xE0D)
#: Words of equal class and counts are found by this weighted sum.
_ROW_WEIGHTS = mix(np.arange(1, OWN + 3, dtype=_U)) | _U(1)
END_BUCKET = SUFFIXES


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, suffix bucket and text number of all tokens of a batch in order, each text closed by its end."""
    hashes, suffixes, first = word_spans(*batch_bytes(texts), 3)
    n, per_text = len(texts), np.diff(first)
    ends = np.cumsum(per_text + 1) - 1
    total = int(ends[-1]) + 1 if n else 0
    is_word = np.ones(total, bool)
    is_word[ends] = False
    out, bucket = np.full(total, END_HASH), np.full(total, END_BUCKET, np.int64)
    out[is_word] = hashes
    bucket[is_word] = (suffixes % _U(SUFFIXES)).astype(np.int64)
    return out, bucket, np.repeat(np.arange(n), per_text + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(hashes: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        columns = [hashes[starts].view(np.int64), buckets[order[starts]].astype(np.int64), np.diff(np.append(starts, len(hashes)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "bucket", "n"])

    parts, pending = [], 0
    for batch in batches:
        hashes, buckets, _ = tokens(batch.column("text"))
        parts.append((hashes, buckets.astype(np.uint16)))
        pending += len(hashes)
        if pending > WORD_PENDING:
            yield counted(*map(np.concatenate, zip(*parts, strict=True)))
            parts, pending = [], 0
    if pending:
        yield counted(*map(np.concatenate, zip(*parts, strict=True)))


def word_counts(training: DataFrame) -> DataFrame:
    """``(word, bucket, n)`` over all training tokens."""
    counted = training.select("text").mapInArrow(_counted, "word long, bucket long, n long")
    return counted.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))


class Units:
    """Which unit a token is: a frequent word, or the bucket of its suffix; the end is a unit of its own."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.end = len(frequent) + SUFFIXES
        self.size = self.end + 1

    def of(self, hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        unit = len(self.frequent) + buckets
        if len(self.frequent):
            at = np.searchsorted(self.frequent, hashes)
            at[at == len(self.frequent)] = 0
            unit = np.where(self.frequent[at] == hashes, at, unit)
        return unit


def _before(units: np.ndarray, end: int) -> np.ndarray:
    """The unit before each token; a text's first word stands after an end, as the text before it closed with one."""
    return np.concatenate([[end], units[:-1]]) if len(units) else units


def _paired(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One count for each pair of units: their number is bounded.
        counts = np.zeros(units.size**2, np.int64)
        parts, pending = [], 0

        def count() -> None:
            np.add(counts, np.bincount(np.concatenate(parts), minlength=len(counts)), out=counts)

        for batch in batches:
            hashes, buckets, _ = tokens(batch.column("text"))
            unit = units.of(hashes, buckets)
            parts.append(_before(unit, units.end) * units.size + unit)
            pending += len(unit)
            if pending > PENDING:
                count()
                parts, pending = [], 0
        if pending:
            count()
        pairs = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts[pairs])], ["pair", "n"])

    return run


def unit_bigrams(training: DataFrame, units: Units) -> DataFrame:
    """``(first, second, n)``: at most the square of the number of units."""
    pairs = training.select("text").mapInArrow(_paired(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.expr(f"cast(pair div {units.size} as int)").alias("first"), F.expr(f"cast(pair % {units.size} as int)").alias("second"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    """Of counts, so never of less than 0."""
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """The part of the log likelihood that classes change, from class pair counts."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def exchange_sweep(classes: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """New classes. ``before[u, c]`` and ``after[u, c]`` count tokens of class c before and after unit u, ``own`` u after
    itself, ``n`` class pairs. The last class holds the end alone and takes part as a neighbour only."""
    classes, n = classes.copy(), n.astype(np.float64).copy()
    free = len(n) - 1
    for u in order:
        a, s = classes[u], float(own[u])
        left, right = before[u].astype(np.float64).copy(), after[u].astype(np.float64).copy()
        left[a] -= s
        right[a] -= s
        # Neighbours that moved in this sweep are where they were when it began; the next sweep sees them.
        n[a] -= right
        n[:, a] -= left
        n[a, a] -= s
        np.maximum(n, 0, out=n)
        row, column = n.sum(axis=1), n.sum(axis=0)
        gain = (_xlogx(n + right) - _xlogx(n)).sum(axis=1) + (_xlogx(n + left[:, None]) - _xlogx(n)).sum(axis=0)
        d = np.diag(n)
        gain += _xlogx(d + left + right + s) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
        gain -= _xlogx(row + right.sum() + s) - _xlogx(row) + _xlogx(column + left.sum() + s) - _xlogx(column)
        b = int(np.argmax(gain[:free]))
        if gain[b] <= gain[a] + 1e-9:
            b = a
        classes[u] = b
        n[b] += right
        n[:, b] += left
        n[b, b] += s
    return classes


def _profiles(bigrams: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbour class counts of each unit and class pair counts. Units and classes are bounded, so is what comes back."""
    spark = bigrams.sparkSession
    named = F.broadcast(spark.createDataFrame([(u, int(c)) for u, c in enumerate(classes)], "unit int, class int"))
    second = bigrams.join(named, bigrams["second"] == named["unit"]).groupBy(F.col("first").alias("unit"), "class").agg(F.sum("n").alias("n"))
    first = bigrams.join(named, bigrams["first"] == named["unit"]).groupBy(F.col("second").alias("unit"), "class").agg(F.sum("n").alias("n"))
    size = (len(classes), CLASSES + 1)
    before, after = np.zeros(size), np.zeros(size)
    rows = second.withColumn("side", F.lit(1)).unionByName(first.withColumn("side", F.lit(0))).toPandas()
    for out, side in ((before, 0), (after, 1)):
        part = rows[rows["side"] == side]
        out[part["unit"].to_numpy(), part["class"].to_numpy()] = part["n"].to_numpy()
    pairs = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(pairs, classes, after)
    return before, after, pairs


def cluster(bigrams: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the class pair counts, by exchange."""
    own = np.zeros(units.size)
    for r in bigrams.filter("first = second").collect():
        own[r["first"]] = r["n"]
    totals = np.zeros(units.size)
    for r in bigrams.groupBy("second").agg(F.sum("n").alias("n")).collect():
        totals[r["second"]] = r["n"]
    order = np.argsort(-totals, kind="stable")
    classes = np.empty(units.size, np.int64)
    classes[order] = np.arange(units.size) % CLASSES
    classes[units.end] = CLASSES
    order = order[(order != units.end) & (totals[order] > 0)]
    best = None
    for sweep in range(SWEEPS + 1):
        before, after, pairs = _profiles(bigrams, classes)
        reached = likelihood(pairs)
        if best is None or reached > best[0]:
            best = (reached, classes, pairs)
        if sweep < SWEEPS:
            moved = exchange_sweep(classes, before, after, own, pairs, order)
            if (moved == classes).all():
                break
            classes = moved
    return best[1], best[2]


def class_gains(classes: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each class would gain by each word if it were the only one to move. ``left`` and ``right`` count the classes before and
    after each word; most of their counts are 0, and only the others are looked at."""
    free, each = len(n) - 1, np.arange(len(classes))
    left, right, n = left.astype(np.float64), right.astype(np.float64), n.astype(np.float64)
    left[each, classes] -= own
    right[each, classes] -= own
    is_own = classes[:, None] == np.arange(free)
    gain = np.zeros((len(classes), free))
    for mine, across, cells in ((right, left, n), (left, right, n.T)):
        w, c = np.nonzero(mine)
        add = mine[w, c][:, None]
        # What is left of a class pair's count without the word itself.
        rest = cells[:free, c].T - is_own[w] * add - (classes[w] == c)[:, None] * (across[w, :free] + is_own[w] * own[w][:, None])
        rest = np.maximum(rest, 0)
        part = _xlogx(rest + add) - _xlogx(rest)
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        if len(w):
            gain[w[starts]] += np.add.reduceat(part, starts, axis=0)
    l, r, s = left[:, :free], right[:, :free], own[:, None]
    from_left, from_right = left.sum(axis=1)[:, None], right.sum(axis=1)[:, None]
    d = np.maximum(np.diag(n)[:free] - is_own * (r + l + s), 0)
    gain += _xlogx(d + l + r + s) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + l)
    row = np.maximum(n.sum(axis=1)[:free] - l - is_own * (from_right + s), 0)
    column = np.maximum(n.sum(axis=0)[:free] - r - is_own * (from_left + s), 0)
    gain -= _xlogx(row + from_right + s) - _xlogx(row) + _xlogx(column + from_left + s) - _xlogx(column)
    return gain


def _chosen(gain: np.ndarray, classes: np.ndarray, words: np.ndarray | None) -> np.ndarray:
    """The class of most gain, or the present one where none is better. Of equally good ones the first counts, or that drawn highest for the word."""
    each = np.arange(len(classes))
    best = gain.argmax(axis=1)
    if words is not None:
        good = gain >= gain[each, best][:, None] - 1e-9
        tied = np.flatnonzero(good.sum(axis=1) > 1)
        draw = mix(words[tied][:, None] + np.arange(gain.shape[1], dtype=_U) * _U(0x9E3779B97F4A7C15)) / 2.0**64
        best[tied] = np.where(good[tied], draw, -1.0).argmax(axis=1)
    return np.where(gain[each, best] > gain[each, classes] + 1e-9, best, classes)


def best_classes(classes: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, n: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """For each word the class that ``exchange_sweep`` would move it to if it were the only one to move. Of equally good classes (empty
    ones, say) the first counts, or, if ``words`` names them, the one that is drawn highest for the word. Words of equal class and counts are weighed once."""
    profiles = np.column_stack([classes, left, right, own]).astype(_U)
    _, at, of = np.unique(mix(profiles @ _ROW_WEIGHTS[: profiles.shape[1]]), return_index=True, return_inverse=True)
    out = np.empty(len(classes), np.int64)
    gain = np.empty((len(at), len(n) - 1))
    for a in range(0, len(at), CHUNK):
        w = at[a : a + CHUNK]
        gain[a : a + CHUNK] = class_gains(classes[w], left[w], right[w], own[w], n)
    for a in range(0, len(out), CHUNK):
        rows = slice(a, a + CHUNK)
        out[rows] = _chosen(gain[of[rows]], classes[rows], None if words is None else words[rows])
    return out


def _packed(values: np.ndarray) -> bytes:
    """Counts or places as bytes, in the narrowest width that holds them; the first byte is the width."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


def _joined(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *map(_unpacked, blobs)])


class Vocabulary:
    """The known words in order, at most ``KNOWN_SHARE`` and the end, and in which part each word is: known ones in turn, all others by hash."""

    def __init__(self, known: np.ndarray, frequent: np.ndarray, parts: int):
        self.known, self.frequent, self.parts = known, frequent, parts
        self.each = -(-len(known) // parts)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each known word, -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at, -1)

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % _U(self.parts)).astype(np.int64)

    def home(self, part: int) -> np.ndarray:
        return np.arange(part, len(self.known), self.parts)

    def moving(self, half: int | None) -> np.ndarray:
        """Which known words may move in a sweep of this half; none in no half."""
        return np.zeros(len(self.known), bool) if half is None else self.frequent | ((self.known & _U(1)) == half)


#: What a part is sent of: words behind a known one and before one, two words not known, two known ones (to the part of either), and
#: words with the classes they start from.
KNOWN_REST, REST_KNOWN, REST_REST, SECOND_KNOWN, FIRST_KNOWN, WORD = range(6)
DEALT = "part int, kind int, a binary, b binary, n binary"


def _slices(target: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings rows of a part together, and where each part begins and ends."""
    order = np.argsort(target.astype(np.uint16) if parts <= 1 << 16 else target, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(target, minlength=parts))])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _dealt(vocabulary: Vocabulary, kind: int, target: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[tuple]:
    order, bounds = _slices(target, vocabulary.parts)
    a, b, n = a[order], b[order], n[order]
    return [(int(p), kind, *(_packed(x[bounds[p] : bounds[p + 1]]) for x in (a, b, n))) for p in np.flatnonzero(np.diff(bounds))]


def _summed(first: np.ndarray, second: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs once, with their counts."""
    key = mix(first.astype(_U)) * _U(3) + second.astype(_U)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    del key
    if n is None:
        n = np.diff(np.append(starts, len(order)))
    elif len(order):
        n = np.add.reduceat(n[order].astype(np.int64), starts)
    return first[order[starts]], second[order[starts]], n


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


def _dealt_pairs(sent):
    """The bigrams of a batch of texts, for the parts of their words that are not known."""

    def counted(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        first, second, n = _summed(first, second)
        f, s = v.places(first), v.places(second)
        rows = []
        for kind, rows_of, home in (
            (KNOWN_REST, (f >= 0) & (s < 0), lambda i: (v.part_of(second[i]), second[i], f[i])),
            (REST_KNOWN, (f < 0) & (s >= 0), lambda i: (v.part_of(first[i]), first[i], s[i])),
            (REST_REST, (f < 0) & (s < 0), lambda i: (v.part_of(first[i]), first[i], second[i])),
            (SECOND_KNOWN, (f >= 0) & (s >= 0), lambda i: (s[i] % v.parts, s[i], f[i])),
            (FIRST_KNOWN, (f >= 0) & (s >= 0), lambda i: (f[i] % v.parts, f[i], s[i])),
        ):
            at = np.flatnonzero(rows_of)
            rows += _dealt(v, kind, *home(at), n[at])
        return _rows(rows, DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, pending = [], [], 0
        for batch in batches:
            hashes, _, _ = tokens(batch.column("text"))
            firsts.append(_before(hashes, END_HASH).astype(_U))
            seconds.append(hashes)
            pending += len(hashes)
            if pending > WORD_PENDING:
                yield counted(sent.value, np.concatenate(firsts), np.concatenate(seconds))
                firsts, seconds, pending = [], [], 0
        if pending:
            yield counted(sent.value, np.concatenate(firsts), np.concatenate(seconds))

    return run


def _dealt_words(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        pending: list[pa.RecordBatch] = []

        def dealt() -> pa.RecordBatch:
            words = np.concatenate([b.column("word").to_numpy() for b in pending]).view(_U)
            classes = np.concatenate([b.column("class").to_numpy() for b in pending])
            n = np.concatenate([b.column("n").to_numpy() for b in pending])
            return _rows(_dealt(v, WORD, v.part_of(words), words, classes, n), DEALT)

        for batch in batches:
            pending.append(batch)
            if len(pending) * BATCH_ROWS >= WORD_PENDING:
                yield dealt()
                pending = []
        if pending:
            yield dealt()

    return run


#: A part's words that are not known, and its bigrams: ``node`` is a word's place in the part (its known words come behind all others). Lists
#: of bigrams with a known word name it; those of two other words are in order of the other's part, so that classes can be sent without names.
HALVES = (
    "part int, source int, words binary, classes binary, left_node binary, left_known binary, left_n binary, right_node binary, right_known binary, "
    "right_n binary, first_node binary, first_n binary, first_parts binary, own_node binary, own_n binary"
)
PART = HALVES.replace("source int, ", "") + ", second_node binary, second_n binary, second_parts binary"


def _names(schema: str) -> list[str]:
    return [f.rsplit(" ", 1)[0] for f in schema.split(", ")]


def _halves(sent):
    """A part's own lists from what it was dealt, and its bigrams of two words not known for the parts of the second ones."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        v: Vocabulary = sent.value
        part = key[0].as_py()
        kinds = group.column("kind").to_numpy()
        columns = [group.column(c).to_pylist() for c in "abn"]

        def of(kind: int) -> list[np.ndarray]:
            return [_joined([c[i] for i in np.flatnonzero(kinds == kind)]) for c in columns]

        words, classes, _ = of(WORD)
        words = words.astype(_U)
        order = np.argsort(words)
        words, classes = words[order], classes[order]
        sides = []
        for rest, known in ((KNOWN_REST, SECOND_KNOWN), (REST_KNOWN, FIRST_KNOWN)):
            w, k, n = _summed(*of(rest))
            home, other, m = _summed(*of(known))
            nodes = np.concatenate([np.searchsorted(words, w.astype(_U)), len(words) + home.astype(np.int64) // v.parts])
            sides += [_packed(nodes), _packed(np.concatenate([k, other])), _packed(np.concatenate([n, m]))]
        first, second, n = _summed(*of(REST_REST))
        first, second = first.astype(_U), second.astype(_U)
        order, bounds = _slices(v.part_of(second), v.parts)
        first, second, n = first[order], second[order], n[order]
        nodes = np.searchsorted(words, first)
        own = np.flatnonzero(first == second)
        own_parts = [nodes, n, np.diff(bounds), nodes[own], n[own]]
        rows = [(part, -1, _packed(words), _packed(classes), *sides, *map(_packed, own_parts))]
        empty = [None] * 10
        rows += [(int(q), part, _packed(second[bounds[q] : bounds[q + 1]]), _packed(n[bounds[q] : bounds[q + 1]]), *empty, None) for q in np.flatnonzero(np.diff(bounds))]
        return pa.Table.from_batches([_rows(rows, HALVES)])

    return run


def _whole(sent):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        v: Vocabulary = sent.value
        group = group.sort_by("source")
        sources = group.column("source").to_numpy()
        words, counts = group.column("words").to_pylist(), group.column("classes").to_pylist()
        own = group.slice(0, 1).to_pylist()[0]
        del own["source"]
        got = [_unpacked(w) for w in words[1:]]
        sizes = np.zeros(v.parts, np.int64)
        sizes[sources[1:]] = [len(w) for w in got]
        nodes = np.searchsorted(_unpacked(words[0]).astype(_U), np.concatenate([np.zeros(0, _U), *got]).astype(_U))
        row = (*own.values(), _packed(nodes), _packed(_joined(counts[1:])), _packed(sizes))
        return pa.Table.from_batches([_rows([row], PART)])

    return run


#: What parts send each other before a sweep: classes of words along the bigrams of the two parts, in their order, and counts of classes beside
#: the known words of the part it goes to. A part's own row (source -1) has the classes of its words.
SENT = "part int, source int, classes binary, known_classes binary, first binary, second binary, place binary, n binary"
TOLD = PART + ", now binary, known_now binary, before binary, after binary, beside binary, pairs array<long>, frequent binary"


class Part:
    """A row of parts, unpacked."""

    def __init__(self, row: dict, vocabulary: Vocabulary, known_classes: np.ndarray, classes: np.ndarray):
        for name in _names(PART)[1:]:
            setattr(self, name, _unpacked(row[name]))
        self.part, self.v, self.known_classes = row["part"], vocabulary, known_classes
        self.home = vocabulary.home(self.part)
        self.rest = len(self.words)
        self.classes = np.concatenate([classes.astype(np.int64), known_classes[self.home]])

    def sent(self, moved: np.ndarray, half: int | None) -> list[tuple]:
        """What all parts need to know when the words have the classes ``moved``, for a sweep of this half."""
        rows = {}
        first, second = (moved[x].astype(np.uint8).tobytes() for x in (self.first_node, self.second_node))
        starts = [np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (self.first_parts, self.second_parts)]
        for q in np.flatnonzero((np.diff(starts[0]) > 0) | (np.diff(starts[1]) > 0)):
            rows[int(q)] = [first[starts[0][q] : starts[0][q + 1]], second[starts[1][q] : starts[1][q + 1]], None, None]
        moving, width = self.v.moving(half), 2 * (CLASSES + 1)
        # Counts of known words beside known ones need no sending.
        cells, counts = [], []
        for node, known, n, place in ((self.left_node, self.left_known, self.left_n, CLASSES + 1), (self.right_node, self.right_known, self.right_n, 0)):
            at = np.flatnonzero((node < self.rest) & moving[known])
            k = known[at].astype(np.int64)
            cells.append(((k % self.v.parts) * self.v.each + k // self.v.parts) * width + place + moved[node[at]])
            counts.append(n[at].astype(np.int64))
        cells, counts = _totals(np.concatenate(cells), np.concatenate(counts))
        bounds = np.searchsorted(cells, np.arange(self.v.parts + 1) * self.v.each * width)
        for q in np.flatnonzero(np.diff(bounds)):
            mine = cells[bounds[q] : bounds[q + 1]]
            rows.setdefault(int(q), [None] * 4)[2:] = _packed(mine - q * self.v.each * width), _packed(counts[bounds[q] : bounds[q + 1]])
        own = (self.part, -1, moved[: self.rest].astype(np.uint8).tobytes(), moved[self.rest :].astype(np.uint8).tobytes(), *[None] * 4)
        return [own, *((q, self.part, None, None, *row) for q, row in rows.items())]

    def neighbours(self, before: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All ``(node, place, n)``, a place being the class before a word, or after it, or the word after itself."""
        own = np.flatnonzero((self.left_node >= self.rest) & (self.left_known == self.part + (self.left_node.astype(np.int64) - self.rest) * self.v.parts))
        return [
            (self.left_node, self.known_classes[self.left_known], self.left_n),
            (self.second_node, before, self.second_n),
            (self.right_node, CLASSES + 1 + self.known_classes[self.right_known], self.right_n),
            (self.first_node, CLASSES + 1 + after.astype(np.int64), self.first_n),
            (self.own_node, np.full(len(self.own_node), OWN), self.own_n),
            (self.left_node[own], np.full(len(own), OWN), self.left_n[own]),
        ]

    def profiles(self, nodes: np.ndarray, before: np.ndarray, after: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """The counts of all places, a row for each of the nodes."""
        row = np.full(len(self.classes), -1)
        row[nodes] = np.arange(len(nodes))
        out = np.zeros(len(nodes) * (OWN + 1))
        for node, place, n in self.neighbours(before, after):
            at = row[node]
            mine = np.flatnonzero(at >= 0)
            out += np.bincount(at[mine] * (OWN + 1) + place[mine], n[mine], len(out))
        out = out.reshape(-1, OWN + 1)
        known = np.flatnonzero(nodes >= self.rest)
        out[known, :OWN] += beside.reshape(-1, OWN)[nodes[known] - self.rest]
        return out

    def pairs(self, before: np.ndarray) -> np.ndarray:
        """Class pair counts, each bigram in one part: that of the second word, or of the word that is not known."""
        rest = np.flatnonzero(self.right_node < self.rest)
        wide = CLASSES + 1
        cells = [
            (self.known_classes[self.left_known] * wide + self.classes[self.left_node], self.left_n),
            (before.astype(np.int64) * wide + self.classes[self.second_node], self.second_n),
            (self.classes[self.right_node[rest]] * wide + self.known_classes[self.right_known[rest]], self.right_n[rest]),
        ]
        return sum(np.bincount(c, n, wide * wide) for c, n in cells).astype(np.int64)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _starting(sent, known_classes):
    """What parts send each other before the first sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                part = Part(row, sent.value, known_classes.value, _unpacked(row["classes"]))
                yield _rows(part.sent(part.classes, 0), SENT)

    return run


def _told(sent, known_classes):
    """Each part with what it was sent, its class pair counts, and the profiles of its frequent words."""

    def run(key: tuple, parts: pa.Table, messages: pa.Table) -> pa.Table:
        v: Vocabulary = sent.value
        row = parts.to_pylist()[0]
        messages = messages.sort_by("source")
        got = {c: messages.column(c).to_pylist() for c in _names(SENT)[2:]}
        part = Part(row, v, known_classes.value, np.frombuffer(got["classes"][0], np.uint8))
        before, after = (b"".join(filter(None, got[c])) for c in ("first", "second"))
        beside = np.zeros(len(part.home) * OWN, np.int64)
        for place, n in zip(got["place"], got["n"], strict=True):
            if place:
                beside[_unpacked(place)] += _unpacked(n).astype(np.int64)
        sides = [np.frombuffer(x, np.uint8) for x in (before, after)]
        frequent = part.rest + np.flatnonzero(v.frequent[part.home])
        told = part.profiles(frequent, *sides, beside).astype(np.int64).tobytes() if len(frequent) else b""
        new = (got["classes"][0], got["known_classes"][0], before, after, _packed(beside), part.pairs(sides[0]), told)
        return pa.Table.from_batches([_rows([(*row.values(), *new)], TOLD)])

    return run


def _moved(sent, known_classes, pairs, half: int, following: int | None):
    """What parts send each other when the words of this half went to their best classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        for batch in batches:
            for row in _each(batch):
                part = Part(row, v, known_classes.value, np.frombuffer(row["now"], np.uint8))
                words = np.concatenate([part.words.astype(_U), v.known[part.home]])
                may = (words & _U(1)) == half
                may[part.rest :] &= ~v.frequent[part.home]
                nodes = np.flatnonzero(may)
                moved = part.classes.copy()
                sides = (np.frombuffer(row[c], np.uint8) for c in ("before", "after"))
                dense = part.profiles(nodes, *sides, _unpacked(row["beside"]))
                moved[nodes] = best_classes(moved[nodes], *_sides(dense), pairs.value, words[nodes])
                yield _rows(part.sent(moved, following), SENT)

    return run


def _sides(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of classes before and after words and of themselves after themselves, from rows of profile places."""
    return dense[:, : CLASSES + 1], dense[:, CLASSES + 1 : OWN], dense[:, OWN]


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, classes in zip(batch.column("words").to_pylist(), batch.column("now").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_unpacked(words).astype(_U).view(np.int64)), pa.array(np.frombuffer(classes, np.uint8).astype(np.int32))], ["word", "class"]
            )


def word_parts(training: DataFrame, start: DataFrame, sent) -> DataFrame:
    """All training words that are not known and all bigrams, in one row per part."""
    pairs = training.select("text").mapInArrow(_dealt_pairs(sent), DEALT)
    words = start.filter("not known").select("word", "class", F.lit(0).alias("n")).mapInArrow(_dealt_words(sent), DEALT)
    halves = pairs.unionByName(words).groupBy("part").applyInArrow(_halves(sent), HALVES)
    return halves.groupBy("part").applyInArrow(_whole(sent), PART)


def cluster_words(training: DataFrame, start: DataFrame, start_path: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """``(word, known, frequent, class)`` of all training words and the class pair counts, by exchange from ``start``. A sweep's tables are deleted when nothing reads them any more, that of ``start`` too; of the assignments the best is kept."""
    spark = training.sparkSession
    known = start.filter("known").select("word", "frequent", "class").toPandas()
    hashes = known["word"].to_numpy(np.int64).view(_U)
    order = np.argsort(hashes)
    hashes, frequent, known_classes = hashes[order], known["frequent"].to_numpy(bool)[order], known["class"].to_numpy(np.int64)[order]
    parts_n = max(spark.sparkContext.defaultParallelism, -(-start.count() // PART_WORDS))
    vocabulary = Vocabulary(hashes, frequent, parts_n)
    send = spark.sparkContext.broadcast
    sent, known_sent = send(vocabulary), send(known_classes)
    parts, parts_path = written(word_parts(training, start, sent), "word_parts")
    drop_tables(spark, start_path)
    messages, path = written(parts.mapInArrow(_starting(sent, known_sent), SENT), "messages")
    driven = np.flatnonzero(frequent)
    # In order of the signed hashes, as ties are broken by it.
    driven = driven[np.argsort(hashes[driven].view(np.int64))]
    best = None
    for sweep in range(SWEEPS + 1):
        last = sweep == SWEEPS
        told = parts.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(_told(sent, known_sent), TOLD)
        told, told_path = written(told.select("part", "pairs", "frequent") if last else told, "told")
        pairs = np.zeros((CLASSES + 1) ** 2)
        with shuffles_dropped(spark):
            for r in told.select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
                pairs[r["at"]] = r["n"]
        pairs = pairs.reshape(CLASSES + 1, CLASSES + 1)
        reached = likelihood(pairs)
        if best is None or reached > best[0]:
            if best is not None:
                drop_tables(spark, best[3])
            best = (reached, known_classes, pairs, path, messages)
        else:
            drop_tables(spark, path)
        if last:
            drop_tables(spark, told_path)
            break
        # At most UNIT_SHARE words and the end.
        dense = np.zeros((len(hashes), OWN + 1))
        for r in told.select("part", "frequent").collect():
            home = vocabulary.home(r["part"])
            dense[home[frequent[home]]] = np.frombuffer(r["frequent"], np.int64).reshape(-1, OWN + 1)
        before, after, own = _sides(dense[driven])
        order = np.argsort(-before.sum(axis=1), kind="stable")
        order = order[known_classes[driven][order] < CLASSES]
        driven_classes = exchange_sweep(known_classes[driven], before, after, own, pairs, order)
        following = None if sweep + 1 == SWEEPS else (sweep + 1) % 2
        messages, path = written(told.mapInArrow(_moved(sent, known_sent, send(pairs), sweep % 2, following), SENT), "messages")
        drop_tables(spark, told_path)
        known_classes = known_classes.copy()
        for r in messages.filter("source = -1").select("part", "known_classes").collect():
            known_classes[vocabulary.home(r["part"])] = np.frombuffer(r["known_classes"], np.uint8)
        known_classes[driven] = driven_classes
        known_sent = send(known_classes)
    now = best[4].filter("source = -1").select("part", F.col("classes").alias("now"))
    rest = parts.select("part", "words").join(now, "part").select("words", "now").mapInArrow(_assigned, "word long, class int")
    fixed = [(int(w), True, bool(f), int(c)) for w, f, c in zip(hashes.view(np.int64), frequent, best[1], strict=True)]
    fixed = spark.createDataFrame(fixed, "word long, known boolean, frequent boolean, class int")
    no = F.lit(False)
    classes, _ = written(rest.select("word", no.alias("known"), no.alias("frequent"), "class").unionByName(fixed), "classes")
    drop_tables(spark, parts_path, best[3])
    return classes, best[2]


class Scorer:
    """What a worker needs: known words' counts and classes, suffix buckets' classes, transitions and class sizes, all of bounded size."""

    def __init__(self, known: np.ndarray, known_n: np.ndarray, known_class: np.ndarray, by_suffix: np.ndarray, pairs: np.ndarray, words: np.ndarray):
        order = np.argsort(known)
        self.known, self.known_n, self.known_class, self.by_suffix = known[order], known_n[order], known_class[order], by_suffix
        smooth = pairs + TRANSITION_PRIOR
        self.steps = np.log10(smooth / smooth.sum(axis=1, keepdims=True))
        self.sizes = np.log10(pairs.sum(axis=0) + words + 1)
        # The end is the one word of its class.
        self.sizes[CLASSES] = np.log10(pairs[:, CLASSES].sum() + 1)


def _partly_scored(sent):
    """One row per batch of documents. A token's code is its class, or the place of its word among the document's other words, behind all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Scorer = sent.value
        for batch in batches:
            hashes, buckets, text = tokens(batch.column("text"))
            n = batch.num_rows
            at = np.searchsorted(m.known, hashes)
            at[at == len(m.known)] = 0
            is_known = m.known[at] == hashes if len(m.known) else np.zeros(len(hashes), bool)
            logs = np.where(is_known, np.log10(m.known_n[at] + 1.0), 0.0) if len(m.known) else np.zeros(len(hashes))
            codes = np.where(is_known, m.known_class[at], 0) if len(m.known) else np.zeros(len(hashes), np.int64)
            rest = np.flatnonzero(~is_known)
            order = rest[np.argsort(hashes[rest], kind="stable")]
            order = order[np.argsort(text[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
            words, owners = hashes[order], text[order]
            fresh = np.ones(len(words), bool)
            fresh[1:] = (words[1:] != words[:-1]) | (owners[1:] != owners[:-1])
            begins = np.flatnonzero(fresh)
            times = np.diff(np.append(begins, len(words)))
            bounds = np.searchsorted(owners[begins], np.arange(n + 1))
            if not n:
                continue
            codes[order] = CLASSES + 1 + np.cumsum(fresh) - 1 - bounds[owners]
            suffix = m.by_suffix[buckets[order[begins]]].astype(np.uint8)
            first = np.searchsorted(text, np.arange(n + 1))
            coded = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                narrow = not b - a or codes[a:b].max() < 1 << 16
                coded.append(codes[a:b].astype("<u2" if narrow else "<u4").tobytes())
            row = (
                batch.column("row")[0].as_py(), batch.column("doc_id").to_pylist(), np.bincount(text, minlength=n).tolist(),
                np.bincount(text, is_known, minlength=n).astype(np.int64).tolist(), np.bincount(text, logs, minlength=n).tolist(),
                coded, np.diff(bounds).tolist(), suffix.tobytes(), _packed(words[begins]), _packed(times),
            )
            yield _rows([row], PARTS)

    return run


PARTS = (
    "base long, doc_id array<long>, n_tokens array<long>, known_tokens array<long>, log_counts array<double>, codes array<binary>, "
    "n_rest array<long>, by_suffix binary, rest binary, rest_n binary"
)
ASKED = "base long, " + DEALT
ANSWERED = "base long, part int, classes binary, n binary"
ASK, NOT_FOUND = WORD + 1, 255


def _asked(sent):
    """The other words of each batch, for the parts they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        for batch in batches:
            for row in _each(batch):
                words = _unpacked(row["rest"]).astype(_U)
                order, bounds = _slices(v.part_of(words), v.parts)
                words = words[order]
                yield _rows([(row["base"], int(p), ASK, _packed(words[bounds[p] : bounds[p + 1]]), None, None) for p in np.flatnonzero(np.diff(bounds))], ASKED)

    return run


def _answered(key: tuple, group: pa.Table) -> pa.Table:
    """Classes and counts of the words asked for, in the order of each question."""
    kinds = group.column("kind").to_numpy()
    columns = [group.column(c).to_pylist() for c in "abn"]
    words, classes, n = (_joined([c[i] for i in np.flatnonzero(kinds == WORD)]) for c in columns)
    words = words.astype(_U)
    order = np.argsort(words)
    # Behind the last word stands one that is not found.
    words, classes, n = np.append(words[order], _U(0)), np.append(classes[order], NOT_FOUND), np.append(n[order], 0)
    bases, out = group.column("base").to_pylist(), []
    for i in np.flatnonzero(kinds == ASK):
        asked = _unpacked(columns[0][i]).astype(_U)
        at = np.searchsorted(words[:-1], asked)
        at[words[at] != asked] = len(words) - 1
        out.append((bases[i], key[0].as_py(), classes[at].astype(np.uint8).tobytes(), _packed(n[at])))
    return pa.Table.from_batches([_rows(out, ANSWERED)])


def _modelled(sent, vocabulary):
    """The scores: joined words' counts and classes in their places, suffix buckets' classes where no word was found."""

    def run(key: tuple, parts: pa.Table, answers: pa.Table) -> pa.Table:
        m: Scorer = sent.value
        row = parts.to_pylist()[0]
        answers = answers.sort_by("part")
        words, times, n_rest = _unpacked(row["rest"]).astype(_U), _unpacked(row["rest_n"]), np.array(row["n_rest"])
        order, _ = _slices(vocabulary.value.part_of(words), vocabulary.value.parts)
        classes, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        classes[order] = np.frombuffer(b"".join(answers.column("classes").to_pylist()), np.uint8)
        counts[order] = _joined(answers.column("n").to_pylist())
        found = classes != NOT_FOUND
        docs = len(n_rest)
        owners = np.repeat(np.arange(docs), n_rest)
        n_known = np.array(row["known_tokens"]) + np.bincount(owners, times * found, docs).astype(np.int64)
        logs = np.array(row["log_counts"]) + np.bincount(owners, np.where(found, times * np.log10(counts + 1.0), 0.0), docs)
        others = np.where(found, classes, np.frombuffer(row["by_suffix"], np.uint8))
        bounds, out = np.concatenate([[0], np.cumsum(n_rest)]), []
        for i, (codes, n) in enumerate(zip(row["codes"], row["n_tokens"], strict=True)):
            named = np.concatenate([np.arange(CLASSES + 1), others[bounds[i] : bounds[i + 1]]])
            cls = named[np.frombuffer(codes, "<u2" if len(codes) == 2 * n else "<u4")]
            out.append(float((m.steps[_before(cls, CLASSES), cls] - m.sizes[cls]).sum()))
        columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array(n_known), pa.array(logs), pa.array(out, pa.float64())]
        return pa.Table.from_arrays(columns, _names(MODELLED))

    return run


MODELLED = "doc_id long, n_tokens long, n_known long, logs double, log_model double"


def scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    training = docs.filter(~held_by_crc("doc_id", 7, 2))
    counts, counts_path = written(word_counts(training), "words")
    summed = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = summed["n"], summed["v"]
    # At most KNOWN_SHARE words can have so large a share.
    is_end = F.col("word") == int(END_HASH)
    is_known = (F.col("n") * KNOWN_SHARE >= total) | is_end
    top = counts.filter((F.col("n") * UNIT_SHARE >= total) & ~is_end).select("word").toPandas()
    units = Units(top["word"].to_numpy(np.int64).view(_U))
    coarse, coarse_path = written(unit_bigrams(training, units), "bigrams")
    with shuffles_dropped(spark):
        coarse_classes, _ = cluster(coarse, units)
    drop_tables(spark, coarse_path)

    of_unit = {int(h): int(coarse_classes[u]) for u, h in enumerate(units.frequent.view(np.int64))}
    named = F.broadcast(spark.createDataFrame([*of_unit.items(), (int(END_HASH), CLASSES)], "word long, own int"))
    of_bucket = F.broadcast(spark.createDataFrame([(b, int(coarse_classes[len(units.frequent) + b])) for b in range(SUFFIXES + 1)], "bucket long, class int"))
    start = counts.join(of_bucket, "bucket").join(named, "word", "left").select(
        "word", is_known.alias("known"), F.col("own").isNotNull().alias("frequent"), F.coalesce("own", "class").alias("class")
    )
    classes, pairs = cluster_words(training, *written(start, "classes"))

    lexicon, _ = written(counts.join(classes, "word"), "lexicon")
    drop_tables(spark, counts_path)
    # A class may have many words of a bucket; of equal ones the least class counts.
    sized = lexicon.groupBy("bucket", "class").count().collect()
    words, shares = np.zeros(CLASSES + 1), np.zeros((SUFFIXES + 1, CLASSES + 1))
    for r in sized:
        words[r["class"]] += r["count"]
        shares[r["bucket"], r["class"]] += r["count"]
    by_suffix = np.where(shares.any(axis=1), shares.argmax(axis=1), words[:CLASSES].argmax())
    by_suffix[END_BUCKET] = CLASSES
    known = lexicon.filter("known").select("word", "n", "class").toPandas()
    hashes, n, known_class = known["word"].to_numpy(np.int64).view(_U), known["n"].to_numpy(np.int64), known["class"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(Scorer(hashes, n, known_class, by_suffix, pairs, words))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    parts, _ = written(numbered.mapInArrow(_partly_scored(sent), PARTS), "parts")
    # Words are looked up where their part is: questions and answers are in the same order, so neither names its documents.
    vocabulary = spark.sparkContext.broadcast(Vocabulary(np.zeros(0, _U), np.zeros(0, bool), max(spark.sparkContext.defaultParallelism, -(-distinct // PART_WORDS))))
    asked = parts.select("base", "rest").mapInArrow(_asked(vocabulary), ASKED)
    seldom = lexicon.filter("not known").select("word", "class", "n").mapInArrow(_dealt_words(vocabulary), DEALT)
    found, _ = written(asked.unionByName(seldom.withColumn("base", F.lit(None).cast("long"))).groupBy("part").applyInArrow(_answered, ANSWERED), "found")
    return (
        parts.groupBy("base").cogroup(found.groupBy("base")).applyInArrow(_modelled(sent, vocabulary), MODELLED)
        .select(
            "doc_id", held_by_crc("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("logs") + F.col("log_model")).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
