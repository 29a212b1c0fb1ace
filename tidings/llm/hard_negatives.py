"""Operator 11, hard negatives by a secondary sort.

For each anchor the rows of its label, in descending order of score, give the positives; each positive opens a window of
scores, relative to its own, and the first rows of other labels inside it are its hard negatives. A pair's score, an
integer, is packed into one binary key: the anchor, the score in descending order, positives before negatives, the
row's id. ``repartition`` by the key's anchor with ``sortWithinPartitions`` by the key is Spark's secondary sort
(``repartitionAndSortWithinPartitions``, without leaving the JVM's sorter); an iterator then reads each anchor's pairs as they come,
opens a window at each positive and gives out negatives until the window has enough. Its state is one anchor's open
windows, never an anchor's pairs. A negative never comes before its positive, as windows lie below their positive's
score or, at 0, on it.

Scores are made block by block: rows and anchors are packed into matrices, and each pair of blocks is one matrix
product. Pairs that can't be wanted don't leave their block: positives beyond the block's first few per anchor, and, once the
positives are known, negatives beyond the block's first few per window. So a first secondary sort finds the positives, a
second one, with the windows' bounds beside the anchors, the negatives. Per anchor and block at most
``positives * (1 + negatives)`` pairs are sorted, however many rows share a label, a score or a vector.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows
whose vector has another length than the anchor's are no partners of it; rows with the anchor's id are not "other" rows;
repeated rows are partners of their own, and repeated equal anchors one; rows of one id that differ are
told apart as anchors and keep their id in the result; a score beyond 64 bits counts as the nearest 64-bit integer; negative
positives' windows are empty; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.blocks import all_blocks
from tidings.llm.common import prepare
from tidings.session import through_table

#: A component is taken as floor(SCALE * x).
SCALE = 256
#: Numbers in a block of rows, and rows in it at most; numbers in a block of anchors.
ROW_VALUES, ROW_COUNT, ANCHOR_VALUES = 1 << 20, 8192, 1 << 17
#: Anchors whose scores with a block are held at once.
SLICE = 64
KEY = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
_TOP = np.uint64(1 << 63)
BLOCK_SCHEMA = "dim int, wide boolean, n int, ids binary, labels binary, vectors binary, part int, rows binary, windows binary"


def packed(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is: anchor, then row of that anchor, descending score, kind, id."""
    keys = np.empty(len(ids), KEY)
    keys["anchor"], keys["row"] = anchor.view(np.uint64) ^ _TOP, row.view(np.uint64) ^ _TOP
    keys["fall"], keys["kind"], keys["id"] = ~(score.view(np.uint64) ^ _TOP), kind, ids.view(np.uint64) ^ _TOP
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return fixed.cast(pa.binary())


def unpacked(keys: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """``(anchor, row, score, kind, id)`` per key."""
    k = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    signed = lambda x: (x.astype(np.uint64) ^ _TOP).view(np.int64).tolist()
    return list(zip(signed(k["anchor"]), signed(k["row"]), signed(~k["fall"]), k["kind"].tolist(), signed(k["id"]), strict=True))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """floor(SCALE * x) per component; None for a vector that is null or has a component that is no number."""
    starts, ends = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
    return [scaled[a:b] if ok and bad[a] == bad[b] else None for ok, a, b in zip(column.is_valid().to_pylist(), starts, ends, strict=True)]


def _blocks(most_values: int, most_rows: int, width: int):
    """Pack rows of equal length into matrices, in the order of their ids. Small numbers are kept in two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}
        values = 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            ids, labels, keys = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            order = np.argsort(ids, kind="stable")
            matrix = np.array([r[3] for r in rows], np.float64).reshape(len(rows), -1)[order]
            wide = bool(matrix.size and np.abs(matrix).max() > 32767)
            windows = np.full((len(rows), width), -1, np.int64)
            for at, k in enumerate(order.tolist()):
                for i, score in enumerate(rows[k][4] or ()):
                    windows[at, i] = score
            data = [ids[order].tobytes(), labels[order].tobytes(), (matrix if wide else matrix.astype(np.int16)).tobytes()]
            columns = [[matrix.shape[1]], [wide], [len(rows)], *([x] for x in data), [part], [keys[order].tobytes()], [windows.tobytes()]]
            types = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.binary(), pa.binary()]
            names = ["dim", "wide", "n", "ids", "labels", "vectors", "part", "rows", "windows"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("vec_id", "label", "row_key", "windows")]
            for i, label, key, windows, vector in zip(*plain, _vectors(batch.column("embedding")), strict=True):
                if vector is None:
                    continue
                rows = held.setdefault(len(vector), [])
                rows.append((i, label, key, vector, windows))
                values += len(vector) + 1
                if len(rows) * (len(vector) + 1) > most_values or len(rows) >= most_rows:
                    values -= len(rows) * (len(vector) + 1)
                    yield block(held.pop(len(vector)))
                elif values > 2 * most_values:
                    values = 0
                    for rest in held.values():
                        yield block(rest)
                    held = {}
        for rest in held.values():
            yield block(rest)

    return run


def _matrix(row: dict, prefix: str) -> np.ndarray:
    kind = np.float64 if row[prefix + "wide"] else np.int16
    return np.frombuffer(row[prefix + "vectors"], kind).reshape(row[prefix + "n"], row["dim"]).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``, at the bounds of 64 bits where they leave them."""
    most = (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def first(scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` places of highest score, equal scores by ascending place."""
    own = scores[places]
    if len(places) > n:
        enough = own >= np.partition(own, len(own) - n)[len(own) - n]
        places, own = places[enough], own[enough]
    return places[np.argsort(~own, kind="stable")[:n]]


def _wanted(kind: int, positives: int, negatives: int, least: int, most: int):
    """For each anchor and block the keys that may be wanted: its first positives, or the first negatives of its windows."""

    def picked(scores, same, others, windows):
        if kind == POSITIVE:
            return first(scores, np.flatnonzero(same & others), positives)
        found, unlike = [], np.flatnonzero(~same & others)
        for p in windows.tolist():
            if p >= 0:
                inside = unlike[(scores[unlike] >= -(-least * p // 100)) & (scores[unlike] <= most * p // 100)]
                found.append(first(scores, inside, negatives))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                anchors, own, keys = (np.frombuffer(row[c], np.int64) for c in ("anchor_ids", "anchor_labels", "anchor_rows"))
                windows = np.frombuffer(row["anchor_windows"], np.int64).reshape(len(anchors), positives)
                a, b = _matrix(row, "anchor_"), _matrix(row, "")
                for at in range(0, len(anchors), SLICE):
                    scores, out = products(a[at : at + SLICE], b), []
                    for k in range(len(scores)):
                        i = at + k
                        places = picked(scores[k], labels == own[i], ids != anchors[i], windows[i])
                        if len(places):
                            out.append(packed(anchors[i : i + 1].repeat(len(places)), keys[i : i + 1].repeat(len(places)), scores[k][places], kind, ids[places]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], ["key"])

    return run


def _positives(n: int):
    """The first ``n`` pairs of each anchor, from keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for batch in batches:
            out = []
            for a, row, score, _, i in unpacked(batch.column("key")):
                anchor, seen = (a, row), seen + 1 if anchor == (a, row) else 1
                if seen <= n:
                    out.append((a, row, i, score))
            yield _rows(out, ("anchor_id", "row_key", "positive_id", "positive_score"))

    return run


def _windows(negatives: int, least: int, most: int):
    """Hard negatives from keys in order: a positive opens its window, negatives go to the windows they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened = None, []
        for batch in batches:
            out = []
            for a, row, score, kind, i in unpacked(batch.column("key")):
                if anchor != (a, row):
                    anchor, opened = (a, row), []
                if kind == POSITIVE:
                    opened.append([i, score, 0])
                    continue
                for window in opened:
                    if window[2] < negatives and least * window[1] <= 100 * score <= most * window[1]:
                        window[2] += 1
                        out.append((a, row, window[0], window[2], i, window[1], score))
                opened = [w for w in opened if w[2] < negatives and least * w[1] <= 100 * score]
            yield _rows(out, ("anchor_id", "row_key", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))

    return run


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, columns, strict=True)], list(names))


def secondary_sort(keys: DataFrame) -> DataFrame:
    """Keys dealt by their anchor and sorted whole: each anchor's pairs lie together, in descending order of score."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``(anchor_id, row_key, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows(vec_id, embedding, label)`` holds anchors and partners; ``is_anchor`` is a condition on its columns. A negative's
    score lies between ``least`` and ``most`` percent of its positive's. ``row_key`` tells rows of one anchor_id apart.
    """
    spark = rows.sparkSession
    prepare(spark)
    none = F.lit(None).cast("array<long>")
    usable = rows.filter("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    ).withColumn("row_key", F.xxhash64("vec_id", "label", "embedding"))
    columns = ["vec_id", "label", "embedding", "row_key", "windows"]
    anchors = through_table(usable.filter("_anchor").drop("_anchor").dropDuplicates(["vec_id", "row_key"]), "anchors")
    n, values = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding") + 1), F.lit(0))).first()
    parts = max(1, -(-values // ANCHOR_VALUES), -(-n // ROW_COUNT))
    blocks = through_table(usable.withColumn("windows", none).select(*columns).mapInArrow(_blocks(ROW_VALUES, ROW_COUNT, 0), BLOCK_SCHEMA), "row_blocks")
    blocks = blocks.select("dim", "wide", "n", "ids", "labels", "vectors")

    def wanted(anchor_rows: DataFrame, kind: int) -> DataFrame:
        packed_anchors = anchor_rows.select(*columns).repartition(parts).mapInArrow(_blocks(2 * ANCHOR_VALUES, ROW_COUNT, positives), BLOCK_SCHEMA)
        packed_anchors = through_table(packed_anchors, "anchor_blocks")
        named = packed_anchors.select("part", F.col("dim").alias("anchor_dim"), *(F.col(c).alias(f"anchor_{c}") for c in ("wide", "n", "ids", "labels", "vectors", "rows", "windows")))
        pairs = all_blocks(blocks, named, parts, F.octet_length("anchor_vectors")).filter("dim = anchor_dim")
        return pairs.mapInArrow(_wanted(kind, positives, negatives, least, most), "key binary")

    best_keys = secondary_sort(wanted(anchors.withColumn("windows", none), POSITIVE))
    best = through_table(best_keys.mapInArrow(_positives(positives), "anchor_id long, row_key long, positive_id long, positive_score long"), "positives")
    windows = best.groupBy(F.col("anchor_id").alias("vec_id"), "row_key").agg(F.collect_set("positive_score").alias("windows"))
    keys = wanted(anchors.join(windows, ["vec_id", "row_key"]), NEGATIVE).unionByName(best.mapInArrow(_repacked, "key binary"))
    schema = "anchor_id long, row_key long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return secondary_sort(keys).mapInArrow(_windows(negatives, least, most), schema)


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
        keys = packed(column("anchor_id"), column("row_key"), column("positive_score"), POSITIVE, column("positive_id"))
        yield pa.RecordBatch.from_arrays([keys], ["key"])
