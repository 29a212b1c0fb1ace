"""Operator 8: the machine against explicit pairs, the screening of pairs against full matrices, labels that only pairs tell."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tidings.llm import toxicity

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def labelled(spark, rule, n=3000, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        w = [r.choice(VOCABULARY) for _ in range(30)] + ["insult"] * insult + ["group"] * group
        r.shuffle(w)
        rows.append((i, " ".join(w), int(rule(insult, group))))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def accuracy(df):
    got = toxicity.toxicity(df.drop("toxic"), df.drop("text")).join(df.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    return sum(x["predicted"] == x["toxic"] for x in got) / len(got)


@pytest.mark.parametrize("rule", [lambda a, b: a != b, lambda a, b: a == b, lambda a, b: a and b, lambda a, b: a and not b])
def test_labels_told_by_two_words_together(spark, rule):
    assert accuracy(labelled(spark, rule)) >= 0.95


def test_labels_told_by_nothing_get_no_inputs_from_chance(spark):
    r = random.Random(9)
    training = toxicity.training_rows(*(labelled(spark, lambda a, b: r.random() < 0.3).select("doc_id", c) for c in ("text", "toxic")))
    assert len(toxicity.fit(training).chosen) <= 6


def test_margin_is_the_sum_over_pairs():
    machine = toxicity.Machine(np.arange(9, dtype=np.int32))
    machine.weights = np.random.default_rng(1).normal(size=machine.weights.shape)
    for idx in ([], [3], [0, 2, 5, 8]):
        v = machine.weights[:, 1:]
        want = machine.weights[-1, 0] + sum(machine.weights[i, 0] for i in idx) + sum(v[i] @ v[j] for i, j in combinations(idx, 2))
        assert machine.margin(np.array(idx, np.int64)) == pytest.approx(want)


def test_one_step_follows_the_slope_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "SHRINK", 0.0)
    rows, labels = [np.array([0, 1, 3]), np.array([1, 2]), np.array([], np.int64)], np.array([1.0, 0.0, 1.0])
    machine = toxicity.Machine(np.arange(4, dtype=np.int32))
    machine.weights = np.random.default_rng(2).normal(size=machine.weights.shape)
    before = machine.weights.copy()

    def loss(weights):
        other = toxicity.Machine(machine.chosen, weights)
        return np.mean([np.log1p(np.exp(m)) - y * m for m, y in zip([other.margin(r) for r in rows], labels, strict=True)])

    slope = np.zeros(before.shape)
    for at in np.ndindex(*before.shape):
        up, down = before.copy(), before.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope[at] = (loss(up) - loss(down)) / 2e-5
    machine.fit(rows, labels, np.zeros(before.shape))
    step = toxicity.RATE * slope / np.sqrt(slope**2 + 1e-4)
    step[-1, 1:] = 0
    assert np.allclose(before - machine.weights, step, atol=1e-4)


def test_directions_are_eigenvectors_of_the_full_matrix(spark):
    r, n = np.random.default_rng(4), 12
    held = r.random((400, n)) < 0.4
    half, left = np.arange(400) % 2, np.where(held[:, 2] ^ held[:, 7], 0.5, -0.5) + r.normal(0, 0.05, 400)
    rows = [(int(half[i]), float(left[i]), [int(t) for t in np.flatnonzero(held[i])]) for i in range(400)]
    table = spark.createDataFrame(rows, "half int, residual double, terms array<int>").repartition(5)
    means = held.mean(axis=0)
    values, found = toxicity.directions(table, means)
    for h in range(2):
        x, weight = held[half == h] - means, (left / np.maximum(held.sum(axis=1), 1))[half == h]
        matrix = (x * weight[:, None]).T @ x
        np.fill_diagonal(matrix, 0)
        true, vectors = np.linalg.eigh(matrix)
        top = np.argmax(np.abs(true))
        own = np.argmax(np.abs(values[h]))
        assert values[h][own] == pytest.approx(true[top], rel=0.02) and abs(found[h][:, own] @ vectors[:, top]) > 0.98
    z = toxicity.company(table, means, found)
    assert set(np.argsort(z)[-2:]) == {2, 7} and z[[2, 7]].min() > toxicity.PAIR_Z


def test_a_repeated_id_is_one_training_row(spark):
    df = labelled(spark, lambda a, b: a and b, 300)
    texts = df.select("doc_id", "text").unionByName(spark.range(2000).selectExpr("5L as doc_id", "concat('copy ', id) as text"))
    training = toxicity.training_rows(texts, df.select("doc_id", "toxic"))
    assert training.groupBy("doc_id").count().filter("count > 1").count() == 0
    got = toxicity.toxicity(texts, df.select("doc_id", "toxic"))
    assert got.count() == 2300
