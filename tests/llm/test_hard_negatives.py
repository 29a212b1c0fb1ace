"""Hard negatives against brute force, with odd rows, ties, blocks of one row and numbers beyond floating point."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidings.llm import blocks, hard_negatives
from tidings.llm.hard_negatives import NEGATIVE, POSITIVE, first, packed, products, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, part int, key string, anchor_id long, windows string"


def vectors():
    r = random.Random(3)
    rows = [(i, [r.choice((-0.5, 0.25, 0.3, 0.7)) for _ in range(6)], r.randrange(3)) for i in range(150)]
    rows += [(i, [0.5] * 6, 1) for i in range(200, 260)]  # one vector, so ties throughout
    rows += [(300, [0.0] * 6, 1), (301, [0.0] * 6, 2), (290, [0.0] * 6, 2), (400, [1.0, 1.0], 1), (401, [1.0, 0.5], 1), (402, [0.5, 0.5], 2), (500, [], 1), (501, [], 1), (502, [], 2)]
    rows += [(100, [9e8] * 6, 1), (-100, [9e8] * 6, 1), (600, [1e17] * 6, 2), (601, [1e17] * 6, 2), (602, [5e16] * 6, 1)]
    rows += [(None, [0.5] * 6, 1), (700, None, 1), (701, [0.5] * 6, None), (702, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1), (703, [math.nan] * 6, 1), (704, [math.inf] * 6, 2)]
    return rows + [rows[100], rows[5], rows[160]]


def brute(rows, positives=5, negatives=10):
    usable = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label))
    out = []
    for anchor in {u for u in usable if u[0] % 100 == 0}:
        scored = []
        for i, v, label in usable:
            if i != anchor[0] and len(v) == len(anchor[1]):
                score = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, anchor[1], strict=True))))
                scored.append((-score, i, label))
        scored.sort()
        for score, p, _ in [s for s in scored if s[2] == anchor[2]][:positives]:
            near = [s for s in scored if s[2] != anchor[2] and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(anchor[0], p, rank + 1, s[1], -score, -s[0]) for rank, s in enumerate(near[:negatives])]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    out = hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in out.drop("row_key").collect())


@pytest.mark.parametrize("values", [1 << 20, 40])
def test_equals_brute_force(spark, monkeypatch, values):
    for name in ("ROW_VALUES", "ANCHOR_VALUES"):
        monkeypatch.setattr(hard_negatives, name, values)
    expected = brute(vectors())
    assert len(expected) > 100 and mined(spark, vectors()) == expected


def test_blocks_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(hard_negatives, "ROW_VALUES", 40)
    assert mined(spark, vectors()) == brute(vectors())


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(100, None, 1)]) == []


def test_keys_sort_as_pairs_do():
    r = random.Random(1)
    pairs = [(r.choice((-5, 3, 2**62)), r.randrange(-3, 3), r.choice((-(2**63), -1, 0, 7, 2**63 - 1)), r.choice((POSITIVE, NEGATIVE)), r.randrange(-4, 9)) for _ in range(300)]
    column = lambda k: np.array([p[k] for p in pairs], np.int64)
    keys = pa.concat_arrays([packed(column(0)[i : i + 1], column(1)[i : i + 1], column(2)[i : i + 1], pairs[i][3], column(4)[i : i + 1]) for i in range(len(pairs))])
    assert unpacked(keys) == pairs
    in_order = unpacked(pa.array(sorted(keys.to_pylist()), pa.binary()))
    assert in_order == sorted(pairs, key=lambda p: (p[0], p[1], -p[2], p[3], p[4]))


def test_first_and_products():
    scores = np.array([3, 9, 9, -1, 9, 3], np.int64)
    assert first(scores, np.arange(6), 2).tolist() == [1, 2]
    assert first(scores, np.array([0, 3, 5]), 9).tolist() == [0, 5, 3]
    big = np.array([[2.0**40, 3.0], [1.0, -(2.0**40)]])
    assert products(big, big).tolist() == [[2**63 - 1, 2**40 - 3 * 2**40], [2**40 - 3 * 2**40, 2**63 - 1]]
    half = np.array([[2.0**30 + 1, 1.0]])
    assert products(half, half).tolist() == [[(2**30 + 1) ** 2 + 1]]
