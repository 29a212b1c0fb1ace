"""Items about the same announcement, by equal or by similar titles, and the primary source of each group.

No group is ever gathered: groups are keys on rows and primaries are plain aggregates. Similar titles are found without
loss: titles that are similar enough share some of their rarest shingles, their marks. Nodes are dealt to blocks of about one
size, and every two blocks whose sizes may go together are compared once, by the marks that their nodes share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidings.functions.text import title_key
from tidings.session import drop_tables, ship_package, shuffles_dropped, spread, written

SHINGLE = 5
MAX_DISTANCE = 0.3
# Nodes of a block, and those of them that look for partners at once.
TARGETS, PROBES = 32768, 4096
# Marks of a block, and meetings of nodes that are counted at once.
MARKS, MEETS = 2_000_000, 1_000_000
# How often all marks are sent at once; if blocks are so many that it takes more, they are compared in turns.
COPIES = 6
# Sizes of nodes in a band differ by this factor at most.
BAND = 1.05
# Similar nodes that a node takes along from one round.
PARTNERS = 8
# Shingles that are put last in the order of all, at most.
COMMON = 65536
# Beyond the one shingle that must be shared, one more is asked for per so many of a set.
SLACK = 10


def exact_key() -> Column:
    """The normalized title; an item without one is a group by itself."""
    key = title_key(F.col("title"))
    return F.when(key != "", key).otherwise(F.concat(F.lit("#"), F.col("source_name"), F.lit("#"), F.col("id")))


def score() -> Column:
    """The score an item carries, 0 without one."""
    return F.coalesce(F.expr("try_cast(try_element_at(metadata, 'score') as double)"), F.lit(0.0))


def standing() -> Column:
    """Orders the items of a group, primary first: score, then date (unknown last), then id."""
    date = F.col("publish_date")
    return F.struct((-score()).alias("s"), date.isNull().alias("u"), date.alias("d"),
                    F.col("id").alias("i"), F.col("source_name").alias("n"))


def primaries(items: DataFrame, by: list[str], keep: list[str], place: Column | None = None) -> DataFrame:
    """One row per group: its size and the ``keep`` columns of its primary item (the first by ``place``)."""
    chosen = F.min_by(F.struct(*keep), standing() if place is None else place).alias("p")
    return items.groupBy(*by).agg(F.count("*").alias("items"), chosen).select(*by, "items", "p.*")


def group_links(items: DataFrame, by: list[str]) -> DataFrame:
    """Every distinct link of every group as rows: a group may have any number of them."""
    return items.select(*by, "url").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(key: str) -> np.ndarray:
    """The distinct hashes of all runs of five characters, ascending; a shorter key is one run."""
    points = np.frombuffer(key.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    runs = max(1, len(points) - SHINGLE + 1)
    hashes = np.zeros(runs, np.uint64)
    for k in range(min(SHINGLE, len(points))):
        hashes = _mix(hashes + points[k : k + runs])
    return np.unique(hashes.view(np.int64))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that stand out in a batch; which ones do matters for speed only."""
    for batch in batches:
        found = [np.zeros(0, np.int64), *map(shingles, batch.column("key").to_pylist())]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(hashes[often]), pa.array(counts[often])], ["s", "c"])


def overlap(similarity: float, n: int) -> int:
    """The least number of shingles that a set of ``n`` shares with one as similar as this."""
    return math.ceil(n * similarity - 1e-9)


def _marks(common: np.ndarray, similarity: float):
    """Each set's first shingles in one order for all sets: those that stand out come last, the most common at the end."""
    by_hash = np.argsort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts = [], [np.zeros(0, np.int32)]
            for sh in map(shingles, batch.column("key").to_pylist()):
                at = np.minimum(np.searchsorted(common, sh, sorter=by_hash), max(len(common) - 1, 0))
                place = np.where(common[by_hash[at]] == sh, by_hash[at] + 1, 0) if len(common) else np.zeros(len(sh))
                first = sh[np.argsort(place, kind="stable")[: len(sh) - overlap(similarity, len(sh)) + 1 + len(sh) // SLACK]]
                sizes.append(len(sh))
                firsts.append(first.astype(np.int32))
            ends = np.cumsum([len(f) for f in firsts])
            marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts)))
            columns = [batch.column("node"), batch.column("key"), pa.array(sizes, pa.int64()), marks]
            yield pa.RecordBatch.from_arrays(columns, ["node", "key", "n", "marks"])

    return run


def title_marks(keys: DataFrame, similarity: float) -> DataFrame:
    """``(node, key, n, marks)``: how many shingles each key has, and the rarest of them.

    Two sets that are similar enough share ``k`` shingles among their first ``n - overlap + k`` in any common order, as what
    lies behind is too little to make up the overlap. Rare shingles first lets few nodes meet: the order ends with at most
    ``COMMON`` common ones, all others come before them by their hash. ``k`` is 1 and a tenth of the set, so that long
    titles must share many marks before they are compared. Marks are the lower halves of the hashes: shingles that are taken for
    one another make more nodes meet, and never fewer.
    """
    ship_package(keys.sparkSession)
    often = spread(keys.select("key")).mapInArrow(_common, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    with shuffles_dropped(keys.sparkSession):
        often = np.array([r["s"] for r in often.orderBy(F.desc("c"), "s").limit(COMMON).collect()][::-1], np.int64)
    node = keys.schema["node"].dataType.simpleString()
    return spread(keys.select("node", "key")).mapInArrow(_marks(often, similarity), f"node {node}, key string, n long, marks array<int>")


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(64)(shingles)
        for batch in batches:
            kept = []
            for key, key2 in zip(batch.column("key").to_pylist(), batch.column("key2").to_pylist(), strict=True):
                a, b = of(key), of(key2)
                common = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(common / (len(a) + len(b) - common) >= similarity)
            yield batch.select(["node", "other"]).filter(pa.array(kept, pa.bool_()))

    return run


def similar_pairs(pairs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(node, other)`` whose whole sets are similar enough. Keys are sent and not sets, which are five times as wide."""
    a, b = keys.select("node", "key"), keys.select(F.col("node").alias("other"), F.col("key").alias("key2"))
    both = pairs.join(a, "node").join(b, "other").select("node", "other", "key", "key2")
    return both.mapInArrow(_similar(similarity), both.select("node", "other").schema)


def _ranges(sizes: list[Row], similarity: float) -> tuple[dict[str, list[int]], int]:
    """For each band of sizes: the blocks its nodes are dealt to (``start``, ``splits``), and the first and last block they may have
    partners in; and how many turns it takes to compare all. Neighbouring bands share a block while they fit into one."""
    groups: list[dict] = []
    for r in sizes:
        g = groups[-1] if groups else None
        if not g or g["nodes"] + r["nodes"] > TARGETS or g["marks"] + r["marks"] > MARKS:
            groups.append(g := {"bands": [], "least": r["least"], "nodes": 0, "marks": 0})
        g["bands"].append(r["band"])
        g |= {"most": r["most"], "nodes": g["nodes"] + r["nodes"], "marks": g["marks"] + r["marks"]}
    blocks = 0
    for g in groups:
        g |= {"start": blocks, "splits": max(math.ceil(g["nodes"] / TARGETS), math.ceil(g["marks"] / MARKS))}
        blocks += g["splits"]
    found = {name: [0] * (groups[-1]["bands"][-1] + 1 if groups else 1) for name in ("start", "splits", "first", "last")}
    sent = 0
    for g in groups:
        near = [o for o in groups if o["most"] >= similarity * g["least"] - 1e-9 and g["most"] >= similarity * o["least"] - 1e-9]
        g |= {"first": near[0]["start"], "last": near[-1]["start"] + near[-1]["splits"] - 1}
        sent += g["marks"] * (g["last"] - g["first"] + 1)
        for band in g["bands"]:
            for name, values in found.items():
                values[band] = g[name]
    return found, max(1, math.ceil(sent / COPIES / max(1, sum(g["marks"] for g in groups))))


def _meet(similarity: float, probes: int, meets: int):
    """The pairs of two blocks, or of one with itself, that share enough marks and are of fitting sizes and different labels."""

    def run(cell: pa.Table) -> pa.Table:
        role, n = cell.column("role").to_numpy(), cell.column("n").to_numpy()
        label = pc.dictionary_encode(cell.column("label").combine_chunks()).indices.to_numpy()
        width = pc.list_value_length(cell.column("marks")).to_numpy()
        owner = np.repeat(np.arange(len(n)), width)
        # A mark in front of a label: those who share a mark lie together, and among them those of one label.
        full = (pc.list_flatten(cell.column("marks")).to_numpy().astype(np.int64) << 32) | label[owner].astype(np.int64)
        asking, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        held = np.flatnonzero((role & 2)[owner])
        held = held[np.argsort(full[held])]
        there, whose = full[held], np.searchsorted(asked, owner[held])
        own = np.flatnonzero((role & 1)[owner])
        order = np.argsort(full[own])
        sought = full[own][order]
        mark = sought >> 32 << 32
        low, own_low, own_high, high = np.empty((4, len(own)), np.int64)
        low[order], high[order] = np.searchsorted(there, mark), np.searchsorted(there, mark + (1 << 32))
        own_low[order], own_high[order] = np.searchsorted(there, sought), np.searchsorted(there, sought, "right")
        until = np.cumsum(width[asking])
        met = np.concatenate([[0], np.cumsum(own_low - low + high - own_high)])[until]
        found, begin = [np.zeros((2, 0), np.int64)], 0
        while begin < len(asking):
            done = met[begin - 1] if begin else 0
            end = min(begin + probes, max(begin + 1, int(np.searchsorted(met, done + meets, "right"))))
            part = slice(until[begin - 1] if begin else 0, until[end - 1])
            who = np.repeat(np.arange(end - begin), width[asking[begin:end]])
            starts, lengths = np.concatenate([low[part], own_high[part]]), np.concatenate([own_low[part] - low[part], high[part] - own_high[part]])
            at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            pair = np.repeat(np.concatenate([who, who]), lengths) * len(asked) + whose[at]
            if len(pair) * 8 > (end - begin) * len(asked):
                count = np.bincount(pair, minlength=(end - begin) * len(asked)).reshape(end - begin, -1)
                least = 1 + np.ceil(similarity * n[asking[begin:end]] - 1e-9).astype(np.int64) // SLACK
                a, b = np.nonzero(count >= np.minimum(least, 1 + n[asking[begin:end]] // SLACK)[:, None])
                count = count[a, b]
            else:
                pair, count = np.unique(pair, return_counts=True)
                a, b = np.divmod(pair, max(1, len(asked)))
            a, b = asking[begin + a], asked[b]
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            # All that a node shares with one whose marks reach further lies among the marks of both, or behind its own marks.
            behind = np.maximum(n[a] - width[a], n[b] - width[b])
            least = np.maximum(1 + small // SLACK, np.ceil(similarity / (1 + similarity) * (small + large) - 1e-9) - behind)
            # In a block with itself two nodes meet twice and are counted once.
            good = (count >= least) & (small >= similarity * large - 1e-9) & ((role[a] != 3) | (a < b))
            found.append(np.stack([a[good], b[good]]))
            begin = end
        a, b = np.concatenate(found, axis=1)
        return pa.table({"node": cell.column("node").take(pa.array(a)), "other": cell.column("node").take(pa.array(b))})

    return run


def open_links(marks: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """``(node, other)``: every pair of similar nodes in different components, once, as a table with its path.

    Nodes lie in blocks by size, so that a node is sent only to blocks of sizes that its partners may have, and a block is bounded
    by its marks. What two blocks share is counted where they meet: nodes of one component don't meet, and only pairs that share
    enough marks come out and are compared as whole sets. What is sent at once is bounded by ``COPIES``.
    """
    spark = marks.sparkSession
    labelled = marks.select("node", "n", "marks").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named, named_path = written(labelled.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int")), "labelled")
    with shuffles_dropped(spark):
        sizes = named.groupBy("band").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("nodes"), F.sum(F.size("marks")).alias("marks")
        )
        of, turns = _ranges(sorted(sizes.collect(), key=lambda r: r["band"]), similarity)
    of = {name: F.get(F.array(*map(F.lit, values)), F.col("band")).cast("long") for name, values in of.items()}
    own, other = F.col("own"), F.col("other")
    dealt = named.withColumn("own", of["start"] + F.pmod(F.xxhash64("node"), of["splits"]))
    dealt = dealt.withColumn("other", F.explode(F.sequence(of["first"], of["last"])))
    node, near, paths = marks.schema["node"].dataType.simpleString(), [], []
    for turn in range(turns):
        cells = dealt.filter(F.pmod(own + other, F.lit(turns)) == turn).select(
            F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "node", "label", "n", "marks",
            (F.when(own <= other, 1).otherwise(0) + F.when(own >= other, 2).otherwise(0)).alias("role"),
        )
        pairs, path = written(cells.groupBy("i", "j").applyInArrow(_meet(similarity, PROBES, MEETS), f"node {node}, other {node}"), "near")
        near.append(pairs)
        paths.append(path)
    drop_tables(spark, named_path)
    found, found_path = written(similar_pairs(reduce(DataFrame.unionByName, near), marks, similarity), "found")
    drop_tables(spark, *paths)
    return found, found_path


def next_links(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, other, place)``: for each node the first of its partners that are in other components, one more than ``PARTNERS`` at most."""
    both = found.unionByName(found.select(F.col("other").alias("node"), F.col("node").alias("other")))
    named = both.join(labels, "node", "left").join(labels.select(F.col("node").alias("other"), F.col("label").alias("label2")), "other", "left")
    apart = named.filter(F.coalesce("label", "node") != F.coalesce("label2", "other")).select("node", "other")
    place = F.row_number().over(Window.partitionBy("node").orderBy("other"))
    return written(apart.withColumn("place", place).filter(F.col("place") <= PARTNERS + 1), "links")[0]


def similar_labels(keys: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``(node, label)`` for the keys that are linked to others: keys of Jaccard distance up to ``max_distance`` are linked,
    and a label is the smallest node that a node is connected with.

    First every node is compared with one node, the one that is smallest among those of most of its marks, which settles hot families.
    Then all links between what is still apart are found. If no node has more of them than are taken along, all are known;
    else the next round takes some again, with at most half of the components that had a partner. Marks and links are deleted in the end.
    """
    spark, similarity = keys.sparkSession, 1 - max_distance
    marks, marks_path = written(title_marks(keys, similarity), "marks")
    each = marks.select("node", F.explode("marks").alias("mark"))
    leaders = each.groupBy("mark").agg(F.min("node").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    leaders, leaders_path = written(leaders, "leaders")
    led = each.join(leaders, "mark").filter("node <> leader").select("node", "leader").repartition("node")
    led = led.groupBy("node", "leader").agg(F.count("*").alias("c"))
    first, first_path = written(led.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("other")), "first")
    drop_tables(spark, leaders_path)
    labels = components(written(similar_pairs(first, marks, similarity), "links")[0])
    drop_tables(spark, first_path)
    found, found_path = open_links(marks, labels, similarity)
    drop_tables(spark, marks_path)
    while True:
        more = next_links(found, labels)
        with shuffles_dropped(spark):
            most = more.agg(F.max("place")).first()[0]
        if most is not None:
            known = labels.filter("node <> label").select("node", F.col("label").alias("other"))
            labels = components(known.unionByName(more.filter(F.col("place") <= PARTNERS).drop("place")))
        if most is None or most <= PARTNERS:
            drop_tables(spark, found_path)
            return labels


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node each node of ``links(node, other)`` is connected with. Labels travel along links
    and are then replaced by their own label, so the rounds grow with the logarithm of the longest path; each round is a
    table."""
    spark = links.sparkSession
    both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both, both_path = written(both.distinct(), "edges")
    labels, path = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        nearest, nearest_path = written(labels.unionByName(heard).groupBy("node").agg(F.min("label").alias("label")), "labels")
        jump = nearest.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step, step_path = written(nearest.join(jump, "label").select("node", F.col("next").alias("label")), "labels")
        with shuffles_dropped(spark):
            settled = step.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty()
        drop_tables(spark, path, nearest_path)
        if settled:
            drop_tables(spark, both_path)
            return step
        labels, path = step, step_path


def similar_groups(items: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """R5, near: ``group_key`` per item becomes that of its component of similar titles (the one whose digest is
    smallest). Equal titles are merged first, so copies cost one node however many there are. Items without a title
    stay alone."""
    spark = items.sparkSession
    keyed = items.withColumn("_key", exact_key()).withColumn("_digest", F.md5("_key"))
    keys, keys_path = written(
        keyed.filter(title_key(F.col("title")) != "").select(F.col("_digest").alias("digest"), F.col("_key").alias("key")).distinct(), "keys"
    )
    # Nodes are numbers in the order of the digests: a node stands in many rows, which are a third as wide with numbers.
    nodes, _ = written(keys.repartitionByRange("digest").sortWithinPartitions("digest").withColumn("node", F.monotonically_increasing_id()), "nodes")
    drop_tables(spark, keys_path)
    labels = similar_labels(nodes.select("node", "key"), max_distance)
    named = labels.join(nodes.select("node", "digest"), "node").join(nodes.select(F.col("node").alias("label"), F.col("key").alias("group_key")), "label")
    return (
        keyed.join(named.select(F.col("digest").alias("_digest"), "group_key"), "_digest", "left")
        .withColumn("group_key", F.coalesce("group_key", "_key"))
        .drop("_digest", "_key")
    )
