"""Operator 9, near duplicates by min-max hashing.

A document's set is its distinct 5-word shingles (``words.shingle_sets``). Each of 96 hash functions gives two values,
the least and the greatest hash of the set, so 96 evaluations give a signature of 192 values, each of which two sets
share with the probability of their Jaccard similarity. Five values make a band: two documents of similarity 0.75 share
none of the 38 bands with a probability of 3 in 100,000.

Nothing is linked by signature alone: every link is confirmed on the full sets. Documents with equal sets are one node
however many copies there are. A band's bucket is never expanded into its pairs:

1. every node is compared with one leader, the least among the leaders of its buckets, and components are formed;
2. in buckets that still hold several components, nodes outside the bucket's largest component are compared with the
   members of other components, in blocks inside tasks, by longer signatures; only pairs that agree in ``MIN_AGREEING`` values
   (four standard deviations below 0.75) leave a task: in a few rounds one per node and block (the best, then the second best), each round
   followed by merging what it linked, and then all that are left. So no pair of one bucket goes unexamined unless its nodes are connected already.

Defined results: null, empty or wordless texts have 0 shingles, are linked with nothing and are their own component;
fewer than five words are one shingle; repeated rows come out once each with the same component; a null doc_id is never
a component's name unless all ids in it are null; extra columns of the input are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import component_labels, free_name, prepare, verified_links
from tidings.llm.words import mix, shingle_sets
from tidings.session import through_table

PERCENT = 75
FUNCTIONS = 96
BANDS = 38
ROWS_PER_BAND = 5
#: Nodes that share a bucket get a longer signature, 512 values of 8 bits; at a similarity of 0.75 the count of equal ones
#: has mean 384 and a standard deviation below 10.
LONG_FUNCTIONS = 256
MIN_AGREEING = 343
#: Rounds in which a node is compared with one look-alike of other components, before all that are left are.
SINGLE_ROUNDS = 2
#: Nodes of a bucket that one task compares with one another at a time.
PROBES, TARGETS = 512, 1024

_U = np.uint64
_A = mix(np.arange(1, LONG_FUNCTIONS + 1, dtype=_U)) | _U(1)
_B = mix(np.arange(1001, LONG_FUNCTIONS + 1001, dtype=_U))
_WEIGHTS = mix(np.arange(5001, ROWS_PER_BAND + 5001, dtype=_U)) | _U(1)
SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, set_id long, bands array<long>"


def min_max(shingles: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of a set under each hash function."""
    low, high = np.full(functions, ~_U(0)), np.zeros(functions, _U)
    for at in range(0, len(shingles), 4096):
        hashed = shingles[at : at + 4096, None] * _A[:functions] + _B[:functions]
        np.minimum(low, hashed.min(axis=0), out=low)
        np.maximum(high, hashed.max(axis=0), out=high)
    return mix(low), mix(high)


def min_max_bands(shingles: np.ndarray) -> np.ndarray:
    """One key per band, made from five of the signature's values; each band takes both least and greatest ones."""
    values = np.stack(min_max(shingles, FUNCTIONS), axis=1).ravel()[: BANDS * ROWS_PER_BAND]
    return mix((values.reshape(BANDS, ROWS_PER_BAND) * _WEIGHTS).sum(axis=1, dtype=_U)).view(np.int64)


def long_signature(shingles: np.ndarray) -> bytes:
    return np.concatenate(min_max(shingles, LONG_FUNCTIONS)).astype(np.uint8).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = [long_signature(s) for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(signed, pa.binary())], ["set_id", "signature"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids, bands = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            if len(shingles):
                ids.append(xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63))
                bands.append(min_max_bands(shingles))
            else:
                ids.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_shingles", "set_id", "bands"],
        )


def text_key() -> Column:
    """With the doc_id, what tells documents apart: ids may be null or repeated."""
    return F.xxhash64("text")


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: a hash of its text, its set's size, an id of the set (equal sets, equal ids) and its signature."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(_sketched, SKETCH_SCHEMA)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``(band, key, set_id, leader)`` for the buckets of more than one node. Leaders are reduced before the shuffle."""
    keyed = nodes.select("set_id", F.posexplode("bands").alias("band", "key"))
    leaders = (
        keyed.groupBy("band", "key").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("_last"))
        .filter("leader <> _last").drop("_last")
    )
    return keyed.join(leaders, ["band", "key"])


def _near_pairs(band: int, sides: np.ndarray, ids: np.ndarray, labels: np.ndarray, signatures: np.ndarray, bands: np.ndarray, place: int | None) -> list[tuple[int, int]]:
    """Pairs of probes and targets of one block that look similar and differ in their component: for each probe the one
    at this place in the order of likeness (the last if there are fewer), or all, each in the first band that the two share
    and from one side only."""
    probes, targets = np.flatnonzero(sides == PROBE), np.flatnonzero(sides != PROBE)
    values, found = signatures[targets], []
    for i in probes:
        agreeing = (values == signatures[i]).sum(axis=1)
        near = np.flatnonzero((agreeing >= MIN_AGREEING) & (labels[targets] != labels[i]))
        if place is not None and len(near) > 1:
            ordered = near[np.lexsort((ids[targets[near]], -agreeing[near]))]
            near = ordered[min(place, len(ordered) - 1) :][:1]
        elif place is None and len(near):
            other = targets[near]
            first = (bands[other] == bands[i]).argmax(axis=1) == band
            near = near[first & ((sides[other] == SETTLED) | (ids[other] > ids[i]))]
        found += [(int(min(ids[i], x)), int(max(ids[i], x))) for x in ids[targets[near]]]
    return found


#: A block's rows: a node to be compared, a node of the bucket's largest component, any other node of the bucket.
PROBE, SETTLED, LOOSE = 0, 1, 2
BLOCK = ["band", "key", "i", "j"]


def _compared(place: int | None):
    """Blocks come one after another (rows are sorted by block); only the last block of a batch is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            left = yield from blocks(rows, final=False)
        if left is not None:
            yield from blocks(left, final=True)

    def blocks(rows: pa.Table, final: bool):
        key = np.stack([rows.column(c).to_numpy() for c in BLOCK], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
        until = rows.num_rows if final else int(starts[-1])
        bounds = [*starts, until] if final else starts
        sides, ids, labels = (rows.column(c).to_numpy() for c in ("side", "set_id", "label"))
        signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, 2 * LONG_FUNCTIONS)
        flat = rows.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        bands, found = flat.reshape(rows.num_rows, BANDS), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            band = int(key[a, 0]) if a < b else 0
            found += _near_pairs(band, sides[a:b], ids[a:b], labels[a:b], signatures[a:b], bands[a:b], place)
        columns = list(zip(*set(found), strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
        return rows.slice(until)

    return run


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components, each with its component, its bucket's largest one and
    the numbers of blocks. Components only grow, so what is resolved stays so."""
    bucket = ["band", "key"]
    labelled = members.select(*bucket, "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    labelled = through_table(labelled, "labelled")
    sizes = labelled.groupBy(*bucket, "label").agg(F.count("*").alias("n"))
    split = (
        sizes.groupBy(*bucket)
        .agg(F.sum("n").alias("n"), F.max("n").alias("n_largest"), F.max_by("label", F.struct("n", "label")).alias("largest"))
        .filter("n_largest < n")
        .select(
            *bucket, "largest", F.ceil((F.col("n") - F.col("n_largest")) / PROBES).alias("probe_blocks"),
            F.ceil(F.col("n") / TARGETS).alias("target_blocks"),
        )
    )
    return through_table(labelled.join(split, bucket), "unresolved")


def open_pairs(inside: DataFrame, signed: DataFrame, done: DataFrame, place: int | None) -> DataFrame:
    """Pairs of different components that share a bucket and look similar by signature, without those ``done``.

    With a ``place`` one pair per node and block. Probes are the nodes outside the largest component of
    their bucket, in blocks of about ``PROBES``; the bucket's nodes are dealt to them in blocks of about ``TARGETS``.
    """
    bucket = ["band", "key"]
    dealt = F.xxhash64("set_id")
    probes = inside.filter("label <> largest").select(
        *bucket, "set_id", "label", F.lit(PROBE).alias("side"), F.pmod(dealt, "probe_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("target_blocks") - 1)).alias("j"),
    )
    targets = inside.select(
        *bucket, "set_id", "label", F.when(F.col("label") == F.col("largest"), SETTLED).otherwise(LOOSE).alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("probe_blocks") - 1)).alias("i"), F.pmod(dealt, "target_blocks").alias("j"),
    )
    blocks = probes.unionByName(targets).join(signed, "set_id")
    sorted_blocks = blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK).select(*BLOCK, "side", "set_id", "label", "signature", "bands")
    pairs = sorted_blocks.mapInArrow(_compared(place), "a long, b long").distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_id, label, component_id)`` per row of ``docs(doc_id, text)``; ``label`` is a
    component's own, null without words."""
    sketched = through_table(sketches(docs), "sketches")
    nodes = sketched.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
        F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at"),
    )
    nodes = through_table(nodes, "nodes")
    members = through_table(bucket_members(nodes), "members")
    # The text of one document per set that shares a bucket, kept once for all comparisons.
    wanted = members.select("set_id").distinct().join(
        nodes.select("set_id", F.col("at.doc_id").alias("at_id"), F.col("at.text_key").alias("text_key")), "set_id"
    )
    given = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("_key") == F.col("text_key"))
    texts = given.join(wanted, same).dropDuplicates(["set_id"]).select("set_id", "text")
    texts = through_table(texts, "texts")
    signed = texts.mapInArrow(_signed, "set_id long, signature binary").join(nodes.select("set_id", "bands"), "set_id")
    signed = through_table(signed, "signatures")

    pairs = members.filter("set_id <> leader").groupBy("set_id").agg(F.min("leader").alias("a")).select("a", F.col("set_id").alias("b"))
    done = through_table(pairs, "pairs")
    links = through_table(verified_links(done, texts, PERCENT).select("a", "b"), "links")
    labels = component_labels(links)
    for place in (*range(SINGLE_ROUNDS), None):
        members = unresolved(members, labels)
        fresh = through_table(open_pairs(members, signed, done, place), "pairs")
        if fresh.isEmpty():
            continue
        done = done.unionByName(fresh)
        links = links.unionByName(through_table(verified_links(fresh, texts, PERCENT).select("a", "b"), "links"))
        labels = component_labels(links)

    named = nodes.select("set_id", "doc_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "label").select("set_id", "label", "component_id")
    return sketched.drop("bands").join(classes, "set_id", "left").withColumn(
        "component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``."""
    return components(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each document once: of rows of the same doc_id and text any one, and of
    several texts of a component that bear its id (or, all ids being null, none) one."""
    named = components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    worded = named.filter("set_id is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    kept = worded.unionByName(named.filter("set_id is null").select("doc_id", "text_key")).distinct()
    own_id, key, name = (free_name(docs, n) for n in ("_id", "_key", "_text"))
    kept = kept.withColumnsRenamed({"doc_id": own_id, "text_key": key})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(name) == F.col(key))
    return docs.withColumn(name, text_key()).join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
