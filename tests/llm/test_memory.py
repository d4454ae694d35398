"""The pipeline's workers give their memory back between tasks and keep few words."""

import re

import numpy as np
import pyarrow as pa

from geoloom.llm import common, toxicity, words


def _held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_a_task_gives_its_memory_back():
    def run(batches):
        held = [np.ones(100_000, np.uint8) for _ in range(3_000)]  # too small to be mapped each for itself
        kept.append(held[-1])  # what lives on top keeps the rest from the system
        yield from batches

    kept, peak, batch = [], 0, pa.RecordBatch.from_pydict({"a": [1]})
    before = _held()
    for got in common.released(run)(iter([batch])):
        peak = _held()
        assert got is batch
    assert peak - before > 200 and _held() - before < 100


def test_tables_that_begin_anew_change_nothing(monkeypatch):
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[::3] = 0.1
    chain = toxicity.Chain(["a"], [toxicity.Linear(weights, np.zeros(0), 0.0)])
    texts = pa.array([f"alpha{k} beta gamma delta{k % 3}" for k in range(40)] + [None, ""])
    want, hashes = toxicity._Scorer(chain)(texts), words.hashed(words.blank_words(" ".join(texts.to_pylist()[:40])))
    monkeypatch.setattr(toxicity, "TABLE_WORDS", 5)
    monkeypatch.setattr(words, "TABLE_WORDS", 5)
    scorer = toxicity._Scorer(chain)
    assert np.array_equal(scorer(texts), want) and len(scorer.known) < 15
    assert np.array_equal(words.hashed(words.blank_words(" ".join(texts.to_pylist()[:40]))), hashes)
