"""Each document's likeness against exact generalised Jaccard similarity."""

import collections
import random

import numpy as np

from geoloom.llm import fingerprints


def test_error_of_each_document(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(300))) for i in range(120)]
    got = {r.doc_id: r for r in fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = lambda t: collections.Counter(t.split())
    exact = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    texts, order, errors = dict(rows), sorted(dict(rows), reverse=True), []
    for k, i in enumerate(order):
        t, other = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        errors.append((got[i].near_edited - exact(words(t), words(t[: len(t) - n] + other[:n])), got[i].near_next - exact(words(t), words(other))))
    assert np.abs(errors).max() < 0.27 and np.abs(np.mean(errors, 0)).max() < 0.03
    assert np.sqrt(np.mean(np.square(errors), 0)).max() < 0.08  # 16 samples: 0.12


def test_parts_are_one_sequence_of_samples(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "")], "doc_id long, text string")
    got = {n: {r.doc_id: r.sample for r in fingerprints.fingerprints(docs, n=n).collect()} for n in (16, 40, 64)}
    assert got[40][1] == got[64][1][:40] and got[16][1] == got[64][1][:16] and len(set(got[64][1])) > 3
    assert got[64][2] == [None] * 64
