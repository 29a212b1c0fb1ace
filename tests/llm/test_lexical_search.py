"""Ranked lexical search against brute force over whole texts, and what its bounds promise."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidings.llm import blocks, lexical_search
from tidings.llm.lexical_search import _signatures, gain, length_figure, level_steps, search, term_counts, upper_bounds

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
r = random.Random(11)
VOCABULARY = ["".join(r.choice("abcdefg01É日") for _ in range(r.randint(1, 5))) for _ in range(150)]


def prose(n, seed):
    own = random.Random(seed)
    return "".join(own.choice(VOCABULARY) + own.choice((" ", ", ", "\n", "-", "\t")) for _ in range(n))


DOCUMENTS = [
    (None, "abc De"), (1, None), (2, ""), (3, "?! -\x00\x7f"), (4, "One two TWO"), (5, "one two two"), (5, "two"), (5, "two"), (None, "two"),
    *((k, prose(3 + k % 40, k % 60)) for k in range(10, 200)), (300, prose(20_000, 1)), (301, "é É é \U0001f600x ５5 a_b"), (302, "two " * 5000),
]
ITEMS = [(1, "two"), (2, None), (3, ""), (4, "--"), (5, prose(30, 12)), (5, prose(30, 12)), (5, "one two TWO"), (6, prose(400, 77)), (None, "é ５5 \U0001f600x"), (8, "nowhere at all"), (9, prose(20, 5) * 3)]


def words(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute(documents, items, top=10):
    counted = [(i, Counter(words(t))) for i, t in documents]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(k for _, _, k in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, k in counted:
            m = 100 - 75 + (75 * k * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def searched(spark, documents, items, top=10):
    docs = spark.createDataFrame([(*d, 1, 2, "x", 3) for d in documents], "doc_id long, text string, item_key long, rank int, _key string, score long")
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, doc_id long, terms string")
    return sorted((tuple(x) for x in search(docs, asked, top).drop("item_key").collect()), key=repr)


@pytest.mark.parametrize("broadcast", [8 << 20, -1])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(lexical_search, "PART_TERMS", 60)
    expected = brute(DOCUMENTS, ITEMS)
    assert len(expected) > 40 and searched(spark, DOCUMENTS, ITEMS) == expected


def test_few_documents_reach_the_floor(spark):
    documents = [(k, prose(60, k)) for k in range(1500)]
    items = [(k, documents[k * 7][1]) for k in range(12)]
    assert searched(spark, documents, items, top=3) == brute(documents, items, top=3)


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == []
    assert searched(spark, DOCUMENTS, []) == []
    assert searched(spark, [(1, None), (2, "")], ITEMS) == []


def test_signatures_never_underestimate():
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([d[0] for d in DOCUMENTS], pa.int64()), "text_key": pa.array(range(len(DOCUMENTS)), pa.int64()), "text": pa.array([d[1] for d in DOCUMENTS], pa.string())
    })
    texts = [d[1] for d in DOCUMENTS]
    n, total = sum(bool(words(t)) for t in texts), sum(len(words(t)) for t in texts)
    counts = dict(enumerate(term_counts(pa.array(texts, pa.string()))))
    items = [{"terms": t, "weights": 7 * c.astype(np.int64)} for t, c in term_counts(pa.array([i[1] for i in ITEMS], pa.string())) if len(t)]
    seen, excess = 0, []
    for out in _signatures(iter([batch])):
        for block in out.to_pylist():
            bounds = upper_bounds(block, items, n, total)
            for d, (key, length) in enumerate(zip(block["text_keys"], block["lengths"], strict=True)):
                seen += 1
                held = dict(zip(counts[key][0].tolist(), counts[key][1].tolist(), strict=True))
                m = int(length_figure(np.array([length]), n, total)[0])
                for item, bound in zip(items, bounds[:, d], strict=True):
                    score = sum(w * gain(held[t], m) for t, w in zip(item["terms"].tolist(), item["weights"].tolist(), strict=True) if t in held)
                    assert bound >= score
                    excess.append(bound > 0 and score == 0)
    assert seen == n and sum(excess) < 0.35 * len(excess)


def test_level_steps_cover_every_count():
    m = np.array([25, 100, 5000])
    steps = np.cumsum(level_steps(m), axis=0)
    for tf in (1, 2, 3, 4, 7, 8, 15, 100, 10**9):
        level = min(3, int(math.log2(tf)))
        assert (gain(tf, m) <= steps[level]).all()
