"""Operator 8, toxicity by a factorization machine over hashed terms.

A text's terms are its words (runs of ASCII letters and digits and of non-ASCII bytes, A-Z as a-z) and the words' first four and
six bytes, each once, hashed to ``BUCKETS``. The machine scores ``w0 + sum w_i + sum over pairs <v_i, v_j>``: the pair part, found
in linear time as half of (square of the sum - sum of the squares), learns that two terms say more together, such as an
insult with a group's name, than their weights add up to. Its inputs are the terms that tell

- alone: their share of toxic training rows differs from the overall share by at least ``MIN_Z`` standard deviations; or
- in company: a first machine of the terms that tell alone leaves residuals, and the leading eigenvectors of the terms' residual-weighted
  covariance are the directions in which pairs of terms explain them. They are found by multiplying with the rows, so no pair is
  ever made, on either half of the training rows by itself. A term enters if its rows of the *other* half go with that half's
  direction by ``PAIR_Z`` standard deviations. So both words of a pair that tells only together become inputs though neither tells
  alone, and the machine starts from their directions; terms that say nothing either way only add noise.

It is fitted to the labels of at most about ``TRAIN_ROWS`` rows, chosen by a hash of doc_id. The rows stay on the
executors in ``SHARDS`` parts; in each round every part makes a pass of stochastic gradient steps from the same weights, and the
weights (their size is bounded by ``BUCKETS`` and ``FACTORS``) are averaged. Rows with ``crc32(doc_id) mod 5 = 0`` are held out.

Defined results: null and empty texts get the score of no term at all; a label that is null is not used, of several for
a document the larger counts; without any usable label all scores are 0.5; repeated rows stay; long texts are read whole;
other columns are never read; an empty table gives an empty table. Of several texts for a training document the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import held_by_crc, prepare
from tidings.llm.words import batch_bytes, mix, span_hashes
from tidings.session import through_table

BUCKETS = 1 << 20
MIN_ROWS = 5
MIN_Z = 4.0
#: Higher than ``MIN_Z``: every term that could reach it is tried in ``FACTORS`` directions of two halves.
PAIR_Z = 5.0
FACTORS = 4
#: Multiplications that turn random directions towards the leading ones.
TURNS = 6
#: Largest factor of the machine's start.
START = 0.3
#: Rows whose residual is below this share of the rarer label's share are explained.
SETTLED = 0.2
TRAIN_ROWS = 20_000
SHARDS = 8
ROUNDS = 6
BATCH = 32
RATE = 0.3
#: Pulls linear weights of terms that say nothing to exactly zero, so a long text's many plain words don't add up. Not the factors:
#: they start small and would never leave zero.
SHRINK = 5e-4
SLICE = 1 << 19
GROUP_BYTES = 1 << 22

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _terms_of(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    data = _LOWER[data]
    inside = _TERM[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    cuts = bounds[1:-1]
    last[cuts[cuts > 0] - 1] = True
    start, end = np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1
    kinds = [span_hashes(data, start, np.minimum(end, start + n)) + _U(salt) for salt, n in ((1, 1 << 40), (2, 4), (3, 6))]
    hashed = np.stack([(mix(k) % _U(BUCKETS)).astype(np.int32) for k in kinds], axis=1) if len(start) else np.zeros((0, 3), np.int32)
    first = np.searchsorted(start, bounds)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(hashed[a:b])


def terms(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its terms; texts are taken a few megabytes at a time."""
    data, bounds = batch_bytes(texts)
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_BYTES, side="right")) - 1)
        yield from _terms_of(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


class Machine:
    """Weights of the chosen terms, one row each: the linear weight, then the factors. The last row's first is ``w0``."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray | None = None):
        if weights is None:
            weights = np.zeros((len(chosen) + 1, 1 + FACTORS), np.float32)
            weights[:, 1:] = np.random.default_rng(7).normal(0, 0.01, (len(chosen) + 1, FACTORS))
        self.chosen, self.weights = chosen, weights

    def inputs(self, found: np.ndarray) -> np.ndarray:
        """The rows of a text's terms that are inputs."""
        if not len(self.chosen):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.chosen, found)
        at[at == len(self.chosen)] = 0
        return at[self.chosen[at] == found]

    def margin(self, idx: np.ndarray) -> float:
        rows = self.weights[idx]
        v = rows[:, 1:]
        return float(self.weights[-1, 0] + rows[:, 0].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, squares: np.ndarray) -> None:
        """One pass of adaptive gradient steps over small batches."""
        w = self.weights
        shrink = np.array([SHRINK] + [0.0] * FACTORS)
        for a in range(0, len(rows), BATCH):
            part, y = rows[a : a + BATCH], labels[a : a + BATCH]
            sizes = np.array([len(x) for x in part])
            used, place = np.unique(np.concatenate(part).astype(np.int64), return_inverse=True)
            doc = np.repeat(np.arange(len(part)), sizes)
            own = w[used].astype(np.float64)
            flat = own[place]
            total = np.stack([np.bincount(doc, flat[:, k], minlength=len(part)) for k in range(1 + FACTORS)], axis=1)
            square = np.bincount(doc, (flat[:, 1:] ** 2).sum(axis=1), minlength=len(part))
            margin = w[-1, 0] + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - square)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
            slope = np.empty((len(flat), 1 + FACTORS))
            slope[:, 0] = error[doc]
            slope[:, 1:] = error[doc][:, None] * (total[doc][:, 1:] - flat[:, 1:])
            grad = np.stack([np.bincount(place, slope[:, k], minlength=len(used)) for k in range(1 + FACTORS)], axis=1) / len(part)
            squares[used] += grad**2
            rate = RATE / np.sqrt(squares[used] + 1e-4)
            moved = own - rate * grad
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * shrink, 0)
            squares[-1, 0] += error.mean() ** 2
            w[-1, 0] -= RATE / np.sqrt(squares[-1, 0] + 1e-4) * error.mean()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [t for t in terms(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"]
        )


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``(shard, doc_id, toxic, terms)`` of labelled rows that aren't held out."""
    usable = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_by_crc("doc_id", 5, 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = usable.count()
    share = F.lit(min(1.0, limit / max(n, 1)))
    chosen = through_table(usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)), "labels")
    # One text per document, combined before the shuffle: a repeated id can't fill a shard.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")
    )
    found = texts.mapInArrow(_features, "doc_id long, toxic int, terms array<int>")
    return through_table(found.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int")), "training")


class Counts:
    """How many of ``rows`` training rows hold each term above ``MIN_ROWS``, and how many toxic ones; there are fewer than ``BUCKETS``."""

    def __init__(self, training: DataFrame):
        total = training.agg(F.count("*").alias("n"), F.avg("toxic").alias("p")).first()
        self.rows, self.share = total["n"], total["p"] or 0.0
        counted = training.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
        found = counted.filter(F.col("n") >= MIN_ROWS).toPandas().sort_values("term")
        self.terms = found["term"].to_numpy(np.int32)
        self.n, self.toxic = found["n"].to_numpy(np.float64), found["t"].to_numpy(np.float64)

    def one_sided(self) -> bool:
        return not 0 < self.share < 1

    def telling(self) -> np.ndarray:
        """Which terms tell alone."""
        if self.one_sided():
            return np.zeros(len(self.terms), bool)
        p = self.share
        return np.abs(self.toxic - self.n * p) >= MIN_Z * np.sqrt(self.n * (p * (1 - p)))


def _passes(sent, rounds_done: int):
    def run(key, group):
        machine = Machine(*sent.value)
        machine.weights = machine.weights.copy()
        ids = group.column("doc_id").to_numpy().astype(np.int64).view(_U)
        # A fixed order for each round, whatever order the rows came in.
        order = np.lexsort((ids, mix(ids + _U(rounds_done))))
        found = group.column("terms").combine_chunks().to_numpy(zero_copy_only=False)
        toxic = group.column("toxic").to_numpy().astype(np.float64)
        machine.fit([machine.inputs(found[i].astype(np.int32)) for i in order], toxic[order], np.zeros(machine.weights.shape, np.float32))
        return pa.table({"n": pa.array([len(order)], pa.int64()), "weights": pa.array([machine.weights.tobytes()], pa.binary())})

    return run


def rounds(training: DataFrame, machine: Machine) -> Machine:
    """The machine after ``ROUNDS`` rounds. A shard holds a bounded number of rows, so each is one group of one task."""
    context = training.sparkSession.sparkContext
    sent = context.broadcast(machine.chosen)

    def inputs_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[np.isin(t, sent.value, assume_unique=True)] for t in batch.column("terms").to_numpy(zero_copy_only=False)]
            yield batch.set_column(batch.schema.get_field_index("terms"), "terms", pa.array(found, pa.list_(pa.int32())))

    shards = through_table(training.mapInArrow(inputs_only, training.schema), "inputs")
    sent.destroy()
    for done in range(ROUNDS):
        sent = context.broadcast((machine.chosen, machine.weights))
        parts = sorted(shards.groupBy("shard").applyInArrow(_passes(sent, done), "n long, weights binary").collect())
        sent.destroy()
        if not parts:
            machine.weights[:] = 0
            break
        total = sum(p["n"] * np.frombuffer(p["weights"], np.float32).astype(np.float64) for p in parts)
        machine.weights = (total / sum(p["n"] for p in parts)).astype(np.float32).reshape(machine.weights.shape)
    return machine


def _margins(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*sent.value)
        for batch in batches:
            found = batch.column("terms").to_numpy(zero_copy_only=False)
            margins = pa.array([machine.margin(machine.inputs(t)) for t in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), margins], ["doc_id", "toxic", "margin"])

    return run


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the margins' probabilities fit the labels best, by Newton steps; the slope is held near 1 where rows don't decide."""
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        curve = np.array([[(w * margins**2).sum() + 1, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(curve, [((p - labels) * margins).sum() + slope - 1, (p - labels).sum()]), -1, 1)
        slope, shift = slope - step[0], shift - step[1]
    return slope, shift


def residuals(training: DataFrame, machine: Machine, tried: np.ndarray, share: float) -> DataFrame:
    """``(half, residual, terms)`` per training row: what the machine leaves to explain, its terms that are tried as places in ``tried``."""
    context = training.sparkSession.sparkContext
    sent = context.broadcast((machine.chosen, machine.weights))
    seen = training.mapInArrow(_margins(sent), "doc_id long, toxic int, margin double").toPandas().sort_values("doc_id")
    slope, shift = calibrated(seen["margin"].to_numpy(np.float64), seen["toxic"].to_numpy(np.float64))
    known, bar = context.broadcast(tried), SETTLED * min(share, 1 - share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, every = Machine(*sent.value), Machine(known.value, np.zeros((1, 1), np.float32))
        for batch in batches:
            found = batch.column("terms").to_numpy(zero_copy_only=False)
            margins = np.array([trained.margin(trained.inputs(t)) for t in found])
            left = batch.column("toxic").to_numpy() - 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
            left[np.abs(left) < bar] = 0
            half = (mix(batch.column("doc_id").to_numpy().astype(np.int64).view(_U) + _U(77)) % _U(2)).astype(np.int32)
            places = pa.array([every.inputs(t).astype(np.int32) for t in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(left, pa.float64()), places], ["half", "residual", "terms"])

    left = through_table(training.mapInArrow(run, "half int, residual double, terms array<int>"), "residuals")
    sent.destroy()
    known.destroy()
    return left


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(half, residual, size, row, term)`` of a batch's rows, the last two per entry, about ``SLICE`` entries at a time."""
    lists = batch.column("terms")
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    half, left = batch.column("half").to_numpy(), batch.column("residual").to_numpy()
    a = 0
    while a < len(half):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, side="right")) - 1)
        size = np.diff(at[a : b + 1])
        yield half[a:b], left[a:b], np.maximum(size, 1), np.repeat(np.arange(b - a), size), flat[at[a] : at[b]]
        a = b


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, values[:, j], minlength=n) for j in range(values.shape[1])], axis=1)


def _summed(rows: DataFrame, add, shape: tuple[int, ...]) -> np.ndarray:
    """What ``add(total, slice)`` makes of all rows, in at most ``SHARDS`` parts without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in _slices(batch):
                add(total, *part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "total"]
        )

    parts = sorted(rows.coalesce(SHARDS).mapInArrow(run, "part int, total binary").collect())
    return sum((np.frombuffer(p["total"], np.float32).astype(np.float64) for p in parts), np.zeros(int(np.prod(shape)))).reshape(shape)


def directions(left: DataFrame, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per half the eigenvalues and directions ``(half, term, k)`` of the terms' covariance weighted by residual over length, without its diagonal.

    A term's own column is centred by its mean; a row is never expanded to pairs, it adds its value times its terms.
    """
    context, n = left.sparkSession.sparkContext, len(means)
    k = min(FACTORS, n)
    random = np.random.default_rng(3)
    turned = np.stack([np.linalg.qr(random.normal(size=(n, k)))[0] for _ in range(2)])
    values = np.zeros((2, k))
    for turn in range(TURNS):
        sent = context.broadcast((turned.astype(np.float32), np.einsum("t,htk->hk", means, turned)))

        def add(total, half, residual, size, row, term, sent=sent):
            vectors, centre = sent.value
            weight = residual / size
            value = (_sums(row, vectors[half[row], term], len(half)) - centre[half]) * weight[:, None]
            value = np.concatenate([value, weight[:, None]], axis=1)
            for h in range(2):
                own = half[row] == h
                total[h, :n] += _sums(term[own], value[row[own]], n)
                total[h, n] += value[half == h].sum(axis=0)

        sums = _summed(left, add, (2, n + 1, k + 1))
        sent.destroy()
        for h in range(2):
            inside, all_rows = sums[h, :n], sums[h, n]
            diagonal = inside[:, k] * (1 - 2 * means) + means**2 * all_rows[k]
            product = inside[:, :k] - np.outer(means, all_rows[:k]) - diagonal[:, None] * turned[h]
            if turn < TURNS - 1:
                turned[h] = np.linalg.qr(product)[0]
            else:
                inner = turned[h].T @ product
                values[h], mixed = np.linalg.eigh((inner + inner.T) / 2)
                turned[h] = turned[h] @ mixed
    return values, turned


def company(left: DataFrame, means: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each term the largest z with which its rows of one half go with a direction of the other half."""
    context, n, k = left.sparkSession.sparkContext, len(means), found.shape[2]
    best = np.zeros(n)
    for h in range(2):
        sent = context.broadcast((found[1 - h].astype(np.float32), means, means @ found[1 - h]))

        def add(total, half, residual, size, row, term, sent=sent, h=h):
            vectors, mean, centre = sent.value
            weight = (residual / size)[:, None]
            value = (_sums(row, vectors[term], len(half)) - centre) * weight
            own, mine = half[row] == h, half == h
            # Without what the term itself brings.
            others = value[row[own]] - vectors[term[own]] * (1 - mean[term[own]])[:, None] * weight[row[own]]
            total[:n] += _sums(term[own], np.concatenate([others, others**2, np.ones((len(others), 1))], axis=1), n)
            total[n] += np.concatenate([value[mine].sum(axis=0), (value[mine] ** 2).sum(axis=0), [mine.sum()]])

        sums = _summed(left, add, (n + 1, 2 * k + 1))
        sent.destroy()
        rows = max(sums[n, -1], 1)
        mean, count = sums[n, :k] / rows, sums[:n, -1:]
        spread = sums[n, k : 2 * k] / rows - mean**2
        squares = sums[:n, k : 2 * k] - 2 * mean * sums[:n, :k] + count * mean**2
        scale = np.sqrt(np.maximum(squares, count * spread))
        z = np.abs(sums[:n, :k] - count * mean) / np.where(scale > 0, scale, np.inf)
        best = np.maximum(best, z.max(axis=1, initial=0))
    return best


def fit(training: DataFrame) -> Machine:
    """The machine of the terms that tell alone, or of these and the terms that tell in company where there are any."""
    counts = Counts(training)
    alone = counts.telling()
    machine = rounds(training, Machine(counts.terms[alone]))
    if counts.one_sided():
        return machine
    # A sum of n values is at most sqrt(n) times the root of their squares' sum, so a term of fewer rows can't reach PAIR_Z.
    tried = counts.n >= PAIR_Z**2
    means = counts.n[tried] / counts.rows
    if not len(means):
        return machine
    left = residuals(training, machine, counts.terms[tried], counts.share)
    values, found = directions(left, means)
    chosen = alone.copy()
    chosen[tried] |= company(left, means, found) >= PAIR_Z
    if chosen.sum() == alone.sum():
        return machine
    wider = Machine(counts.terms[chosen])
    # Factors can only start along directions of positive value: a product of factors is never negative with itself.
    start = np.zeros((len(chosen), found.shape[2]))
    start[tried] = found[0] * (values[0] > 0)
    start = start[chosen]
    wider.weights[:-1, 1 : 1 + start.shape[1]] += START * start / np.maximum(np.abs(start).max(axis=0), 1e-12)
    return rounds(training, wider)


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*sent.value)
        for batch in batches:
            margins = np.array([machine.margin(machine.inputs(t)) for t in terms(batch.column("text"))])
            score = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``."""
    prepare(docs.sparkSession)
    machine = fit(training_rows(docs, labels))
    sent = docs.sparkSession.sparkContext.broadcast((machine.chosen, machine.weights))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(sent), "doc_id long, score double")
    return scored.select("doc_id", held_by_crc("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
