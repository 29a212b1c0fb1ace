"""Operator 12, ranked lexical search over bit-sliced Bloom signatures.

Terms are runs of letters and digits (``words.TERM``). Every document is a column of a bitmap and every hashed term
sets a few of its rows; documents of like length share a block, so that a block has as many rows as its documents need.
A term that occurs ``2**k`` times or more is also set under its k-th level, so the bitmap overestimates both presence
and frequency, never the other way.

To answer items, a block takes the rows of each of their terms, joins them by AND into one slice of the documents that may hold the
term, and sums the slices by the term's weight: for each level one weighted slice sum per item. With the most a level can
add to a score (exact for the document's own length) these sums are an upper bound of the document's score. Two passes:

1. the best upper bounds of every item give a few documents (``SEEDS`` of them), whose exact scores give a floor: an
   item's tenth best exact score, which at least ten documents reach;
2. every document whose upper bound reaches the floor is scored exactly, from its whole text, and these are ranked.

So a document is left out only where it is proven to score less than ten others. Nothing else is cut, ties included.

A term's weight is floor(1000 * ln((2N+2)/(2df+1))), an occurrence count tf in a document of ``m`` gives
(1000000000 * tf) div (1000 * tf + 8 * m) times the weight; see ``statistics`` and ``gain``.

Defined results: a null or termless text counts in no statistic and is never found; a null, empty or termless item finds
nothing; scores of 0 aren't returned; repeated rows of documents count and rank one by one, with the same doc_id; equal
scores rank by doc_id, null last; equal items are answered once, items of one id with different texts each; extra columns
are ignored; an empty table on either side gives an empty table. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.blocks import all_blocks
from tidings.llm.common import prepare
from tidings.llm.words import TERM, mix, word_hashes_of
from tidings.session import through_table

TOP = 10
#: Documents per item whose exact scores make the floor.
SEEDS = 40
#: Levels of frequency: 1, 2, 4 and 8 occurrences or more.
LEVELS = 4
#: Bits per set key and rows per term: about one bit in three is set, and a term that is absent shows in few documents.
BITS, ROWS = 8, 4
#: Documents in a block, and its size in bits, at most (but one byte's worth of documents always).
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 23
#: Distinct terms of the items in one part, about.
PART_TERMS = 4096

_U = np.uint64
_LEVEL = mix(np.arange(9001, 9001 + LEVELS, dtype=_U))
_ROW = mix(np.arange(7001, 7001 + ROWS, dtype=_U)) | _U(1)
#: The least and the most occurrences that a level stands for; the last one has no most.
LEAST = [1 << k for k in range(LEVELS)]


def gain(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What one unit of weight gives for ``tf`` occurrences in a document of length figure ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_figure(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 for a document of average length, 25 for one of none: 25 + (75 * n * N) div L, in whole numbers."""
    return np.array([25 + 75 * x * documents // total for x in n.tolist()], np.int64)


def level_steps(m: np.ndarray) -> list[np.ndarray]:
    """The most that each level adds to the gain of the levels below it."""
    most = [gain(2 * least - 1, m) for least in LEAST[:-1]] + [np.full(len(m), 1_000_000, np.int64)]
    return [most[0], *(b - a for a, b in zip(most[:-1], most[1:], strict=True))]


def term_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its terms and how often each occurs."""
    hashes, first = word_hashes_of(texts, TERM)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(hashes[a:b], return_counts=True)


def _lists(values: list[np.ndarray], kind: np.dtype = np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
    flat = np.concatenate(values).view(kind) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = list(term_counts(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("item_key"), _lists([t for t, _ in counted]), _lists([c for _, c in counted])],
            ["item_id", "item_key", "terms", "repeats"],
        )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how many of its documents hold each term; its documents and its terms in all under a null term."""
    for batch in batches:
        counted = [t for t in term_counts(batch.column("text")) if len(t[0])]
        terms, held = np.unique(np.concatenate([np.zeros(0, _U), *(t for t, _ in counted)]), return_counts=True)
        total = sum(int(c.sum()) for _, c in counted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *terms.view(np.int64).tolist()], pa.int64()), pa.array([len(counted), *held.tolist()], pa.int64()), pa.array([total, *[0] * len(held)], pa.int64())],
            ["term", "documents", "total"],
        )


def statistics(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, documents, total)``: the documents that hold a term of ``wanted(term)``, and under a null term the number of
    documents with a term and of all their terms. Counted per batch before the shuffle."""
    counts = docs.select("text").mapInArrow(_document_counts, "term long, documents long, total long")
    kept = counts.join(wanted.withColumn("asked", F.lit(True)), "term", "left").filter("term is null or asked")
    return kept.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total"))


def set_rows(terms: np.ndarray, level: int, size: int) -> np.ndarray:
    """The rows, of ``size`` in all, that hold these terms at a level: ``ROWS`` for each."""
    return (mix((terms ^ _LEVEL[level])[:, None] * _ROW) % _U(size)).astype(np.int64)


class _Block:
    """A bitmap under construction: one column per document, all of one size class."""

    def __init__(self, size: int):
        self.size, self.docs = size, []
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BITS // size))
        self.bits = np.zeros((size, self.most // 8), np.uint8)

    def add(self, doc: tuple, terms: np.ndarray, counts: np.ndarray) -> None:
        column, bit = divmod(len(self.docs), 8)
        for level, least in enumerate(LEAST):
            present = terms[counts >= least]
            if len(present):
                self.bits[set_rows(present, level, self.size).ravel(), column] |= np.uint8(1 << bit)
        self.docs.append(doc)

    def row(self) -> pa.RecordBatch:
        ids, keys, lengths = zip(*self.docs, strict=True)
        bits = self.bits[:, : -(-len(self.docs) // 8)]
        columns = [[list(ids)], [list(keys)], [list(lengths)], [self.size], [bits.tobytes()]]
        types = [pa.list_(pa.int64())] * 3 + [pa.int32(), pa.binary()]
        names = ["doc_ids", "text_keys", "lengths", "size", "bits"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


BLOCK_SCHEMA = "doc_ids array<long>, text_keys array<long>, lengths array<long>, size int, bits binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _Block] = {}
    for batch in batches:
        plain = [batch.column(c).to_pylist() for c in ("doc_id", "text_key")]
        for i, key, (terms, counts) in zip(*plain, term_counts(batch.column("text")), strict=True):
            if not len(terms):
                continue
            keys = sum(int((counts >= least).sum()) for least in LEAST)
            size = BITS << int(keys - 1).bit_length()
            block = open_blocks.setdefault(size, _Block(size))
            block.add((i, key, int(counts.sum())), terms, counts)
            if len(block.docs) == block.most:
                yield open_blocks.pop(size).row()
    for block in open_blocks.values():
        yield block.row()


def signatures(docs: DataFrame) -> DataFrame:
    """Blocks of bit-sliced signatures of all rows of ``docs(doc_id, text_key, text)`` that have a term."""
    return docs.mapInArrow(_signatures, BLOCK_SCHEMA)


def upper_bounds(block: dict, items: list[dict], documents: int, total: int) -> np.ndarray:
    """For each item and document of a block a number that the document's score can't exceed."""
    n = len(block["doc_ids"])
    bits = np.frombuffer(block["bits"], np.uint8).reshape(block["size"], -1)
    terms, places = np.unique(np.concatenate([i["terms"] for i in items]), return_inverse=True)
    steps = level_steps(length_figure(np.array(block["lengths"]), documents, total))
    ends = np.cumsum([len(i["terms"]) for i in items])
    bounds = np.zeros((len(items), n))
    for level in range(LEVELS):
        rows = set_rows(terms, level, block["size"])
        slices = bits[rows[:, 0]]
        for k in range(1, ROWS):
            slices &= bits[rows[:, k]]
        held = np.flatnonzero(slices.any(axis=1))
        if not len(held):
            continue
        shown = np.zeros(len(terms), np.int64)
        shown[held] = np.arange(1, len(held) + 1)
        may_hold = np.unpackbits(slices[held], axis=1, bitorder="little", count=n).astype(np.float64)
        step = steps[level].astype(np.float64)
        for k, (item, end) in enumerate(zip(items, ends, strict=True)):
            row = shown[places[end - len(item["terms"]) : end]]
            some = row > 0
            if some.any():
                bounds[k] += (item["weights"][some].astype(np.float64) @ may_hold[row[some] - 1]) * step
    # Doubles hold these whole numbers but for the longest items; the margin keeps those bounds on the safe side too.
    return bounds * (1 + 1e-12)


def _bounds(documents: int, total: int, seeds: int | None):
    """Documents of a block by upper bound: those that may be an item's best, or all that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items = [
                    {"key": k, "floor": f, "terms": np.array(t, np.int64).view(_U), "weights": np.array(w, np.int64)}
                    for k, f, t, w in zip(row["item_keys"], row["floors"], row["terms"], row["weights"], strict=True)
                ]
                ids, keys, bounds = row["doc_ids"], row["text_keys"], upper_bounds(row, items, documents, total)
                out = []
                for item, of in zip(items, bounds, strict=True):
                    enough = np.flatnonzero((of > 0) & (of >= item["floor"]))
                    if seeds is not None and len(enough) > seeds:
                        enough = enough[np.argpartition(-of[enough], seeds)[:seeds]]
                    out += [(ids[d], keys[d], item["key"], int(of[d])) for d in enough.tolist()]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "item_key", "bound"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = list(term_counts(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("item_keys"), _lists([t for t, _ in counted]), _lists([c for _, c in counted]),
                pa.array([int(c.sum()) for _, c in counted], pa.int64()),
            ],
            ["doc_id", "item_keys", "held", "counts", "length"],
        )


def _scores(documents: int, total: int):
    """Exact scores: a batch of pairs at once, its terms looked up among its documents' terms, each under its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = mix(np.arange(1, batch.num_rows + 1, dtype=_U))
            lists = {}
            for name in ("held", "counts", "terms", "weights"):
                column = batch.column(name)
                lists[name] = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            keyed = lambda name: mix(lists[name][0].view(_U) ^ np.repeat(salts, lists[name][1]))  # noqa: E731, B023
            held, wanted = keyed("held"), keyed("terms")
            order = np.argsort(held)
            at = np.searchsorted(held, wanted, sorter=order)
            at[at == len(held)] = 0
            found = held[order[at]] == wanted if len(held) else np.zeros(len(wanted), bool)
            row = np.repeat(np.arange(batch.num_rows), lists["terms"][1])[found]
            m = length_figure(batch.column("length").to_numpy(), documents, total)
            each = lists["weights"][0][found] * gain(lists["counts"][0][order[at[found]]] if len(held) else np.zeros(0, np.int64), m[row])
            scores = np.zeros(batch.num_rows, np.int64)
            np.add.at(scores, row, each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_key"), pa.array(scores)], ["doc_id", "item_key", "score"])

    return run


def exact_scores(docs: DataFrame, pairs: DataFrame, items: DataFrame, documents: int, total: int) -> DataFrame:
    """``(doc_id, item_key, score)`` for the rows of ``docs`` that ``pairs(doc_id, text_key, item_key)`` names, from their whole texts."""
    asked = pairs.groupBy("doc_id", "text_key").agg(F.collect_set("item_key").alias("item_keys"))
    asked = through_table(asked.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "asked")
    named = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text", "item_keys")
    held = named.mapInArrow(_held, "doc_id long, item_keys array<long>, held array<long>, counts array<long>, length long")
    both = held.select("doc_id", F.explode("item_keys").alias("item_key"), "held", "counts", "length").join(items.select("item_key", "terms", "weights"), "item_key")
    return both.mapInArrow(_scores(documents, total), "doc_id long, item_key long, score long")


def best(scored: DataFrame, by: str, n: int, *ties: Column) -> DataFrame:
    """The first ``n`` rows of each item by a figure; cut in every task before the shuffle."""
    ordered = Window.partitionBy("item_key").orderBy(F.desc(by), *ties)
    return scored.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= n)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, item_key, rank, doc_id, score)``: the ``top`` best rows of ``docs(doc_id, text)`` for each row of
    ``items(item_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    given = items.select(F.col("item_id").cast("long"), "text").distinct()
    given = given.withColumn("item_key", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))
    counted = given.mapInArrow(_items, "item_id long, item_key long, terms array<long>, repeats array<long>").filter(F.size("terms") > 0)
    counted = through_table(counted, "items")
    wanted = through_table(counted.select(F.explode("terms").alias("term")).distinct(), "item_terms")
    figures = through_table(statistics(keyed, wanted), "statistics")
    sums = figures.filter("term is null").select("documents", "total").first()
    documents, total = (sums["documents"], max(1, sums["total"])) if sums else (0, 1)

    weight = F.floor(1000 * F.log((F.lit(2 * documents + 2).cast("double")) / (2 * F.col("documents") + 1).cast("double"))).cast("long")
    weights = figures.filter("term is not null").select("term", weight.alias("weight")).filter("weight > 0")
    pairs = counted.select("item_id", "item_key", F.explode(F.arrays_zip("terms", "repeats")).alias("x")).select("item_id", "item_key", "x.terms", "x.repeats")
    weighed = (
        pairs.join(weights, pairs["terms"] == weights["term"])
        .groupBy("item_id", "item_key").agg(F.collect_list(F.struct("term", (F.col("weight") * F.col("repeats")).alias("w"))).alias("x"))
        .select("item_id", "item_key", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    )
    weighed = through_table(weighed, "weighed")
    parts = max(1, -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // PART_TERMS))
    blocks = through_table(signatures(keyed), "signatures")

    def bounded(floors: DataFrame, seeds: int | None) -> DataFrame:
        """``(doc_id, text_key, item_key, bound)`` from all blocks and all items, which go in parts of bounded size."""
        part = F.pmod(F.xxhash64("item_key"), F.lit(parts)).cast("int").alias("part")
        grouped = floors.groupBy(part).agg(F.collect_list(F.struct("item_key", "floor", "terms", "weights")).alias("x"))
        grouped = through_table(grouped.select(
            "part", F.col("x.item_key").alias("item_keys"), F.col("x.floor").alias("floors"), F.col("x.terms").alias("terms"), F.col("x.weights").alias("weights")
        ), "item_parts")
        joined = all_blocks(blocks, grouped, parts, 16 * F.size(F.flatten("terms")))
        return joined.mapInArrow(_bounds(documents, total, seeds), "doc_id long, text_key long, item_key long, bound long")

    likely = best(bounded(weighed.withColumn("floor", F.lit(0).cast("long")), SEEDS), "bound", SEEDS)
    seeded = exact_scores(keyed, likely, weighed, documents, total)
    floor = best(seeded, "score", top).filter(F.col("rank") == top).select("item_key", F.col("score").alias("floor"))
    floors = through_table(weighed.join(floor, "item_key", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long"))), "floors")
    reached = through_table(bounded(floors, None), "reached")
    scored = exact_scores(keyed, reached, weighed, documents, total).filter("score > 0")
    ranked = best(scored, "score", top, F.col("doc_id").asc_nulls_last())
    return ranked.join(weighed.select("item_id", "item_key"), "item_key").select("item_id", "item_key", "rank", "doc_id", "score")
