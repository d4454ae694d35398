"""The corpus operators against brute force, and their defined results on odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, components, decontam, fingerprints, licenses, lines, minhash, shards, toxicity

ODD = "doc_id long, text string, n int, doc string, th long, text_hash long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], ODD)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- line dedup


def dedup(rows, min_chars=20, min_docs=3):
    holders = collections.defaultdict(set)
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < min_docs or i == max(holders[key(x)], key=rank)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"  Line number {k} with ÄÖÜ text " for k in range(12)] + ["a very common line of text", "short", "x" * 19, "é" * 20, ""]
    rows = [(i // 2 if i % 9 == 0 else i, "\n".join(rng.choice([*pool, "a very common line of text", "A VERY COMMON LINE OF TEXT\r"]) for _ in range(rng.randint(1, 8)))) for i in range(120)]
    rows += [(None, rows[3][1]), (500, None), (501, ""), rows[5], rows[5], (502, "\n".join(pool) * 500)]
    got = sorted((tuple(r) for r in lines.digests(frame(spark, rows)).collect()), key=str)
    assert got == dedup(rows)
    kept = lines.apply(frame(spark, rows).withColumn("n_chars", F.lit(5))).collect()
    assert len(kept) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    assert lines.digests(frame(spark, [])).count() == 0


# -- near duplicates


def exact_groups(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_minhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 200]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += rng.randint(1, 3)
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "one "), rows[0], rows[0]]
    want = exact_groups(rows)
    for block in (512, 4):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.groups(frame(spark, [*rows, (None, "one")]), percent=85).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert [r.kept for r in got if r.doc_id is None] == [True] and len(got) == len(rows) + 1
        assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in got if r.doc_id is not None)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 100)
    rng = random.Random(14)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(1500):  # a third is one group; most pairs stand near the threshold
        w = list(base) if i % 3 == 0 else [f"v{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(rng.randint(0, 5) if i % 3 == 0 else 0):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows if i % 3 == 0}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {i: root(i) if i in up else i for i, _ in rows} and len({root(i) for i in ids}) > 1


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
        errors.append(float((minhash.superminhash(a, 125) == minhash.superminhash(b, 125)).mean()) - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    tiny = minhash.superminhash(np.array([5], np.uint64), 125)
    assert (tiny == minhash.superminhash(np.array([5], np.uint64), 125)).all() and len(set((tiny >> np.uint64(32)).tolist())) == 125


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {v: root(v) for v in up if any(v in e and e[0] != e[1] for e in edges)}
    assert {r.v: r.c for r in components.components(df).collect()} == want
    monkeypatch.setattr("geoloom.operators.components.ONE_TASK", 0)
    assert {r.v: r.c for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


# -- decontamination


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(200))
    items = [[word() for _ in range(rng.randint(12, 60))] for _ in range(20)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "too short"), (92, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        w = [word() for _ in range(rng.randint(5, 200))]
        if i % 3 == 0:
            k = rng.randrange(20)
            passage = list(items[k])
            if i % 2:  # two of twelve words differ
                for at in range(3, len(passage), 9):
                    passage[at] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() for x in passage]
            want.add((i, k))
        if i % 3 == 1:  # too little in a row
            w[2:2] = items[i % 20][:6]
        rows.append((i, ", ".join(w)))
    rows += [(100, None), (101, ""), (102, "\n".join([" ".join(word() for _ in range(40_000)), " ".join(items[0])])), (None, " ".join(items[1])), rows[0]]
    want |= {(102, 0), (None, 1)}
    got = decontam.overlaps(frame(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontam.apply(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i is not None and i not in {d for d, _ in want})
    assert decontam.overlaps(frame(spark, []), bench).count() == 0 and decontam.overlaps(frame(spark, rows), bench.limit(0)).count() == 0


def test_masks_find_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(12), 2):
        assert any(all(o + k not in gone for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(13 - len(m)))


def longest_overlaps(rows, items, min_words=12, share=0.8):
    """Every diagonal of every pair, word by word."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    best = {}
    for i, t in rows:
        a = split(t)
        for j, u in items:
            b = split(u)
            for d in range(-len(b), len(a)):
                lo, hi = max(0, -d), min(len(b), len(a) - d)
                same = [a[k + d] == b[k] for k in range(lo, hi)]
                ups = np.concatenate([[0], np.cumsum(same)]).astype(int)
                if not len(b) or ups[-1] < share * min(min_words, len(b)) - 1e-9:
                    continue
                for n in range(hi - lo, min(min_words, len(b)) - 1, -1):
                    fits = [(n, int(ups[x + n] - ups[x]), -(lo + d + x), -(lo + x)) for x in range(hi - lo - n + 1) if ups[x + n] - ups[x] >= share * n - 1e-9]
                    if fits:
                        best[i, j] = max(best.get((i, j), fits[0]), fits[0])
                        break
    return {k: (-v[2], -v[3], v[0], v[1]) for k, v in best.items()}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(16)
    pool = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([200, 40, 15, 12, 1, 3, 6, 7, 10, 11])] + [(20, ""), (21, None), (None, " ".join(text(30)))]
    rows = []
    for i in range(70):
        w = text(rng.randint(0, 60))
        of = items[rng.choice([0, 1, 2, 3, 5, 6, 7, 8, 9, 12])][1].split()
        lo = rng.randrange(len(of)) if len(of) > 30 else 0
        part = of[lo : lo + rng.randint(20, 200)]
        for _ in range(rng.choice([0, 0, 1, 2, len(part) // 6])):
            if len(part) > 5:
                part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + part + w[at:])))
    long = items[0][1].split()
    rows += [(100, " ".join(long[:160] + ["other"] * 40)), (101, " ".join(["x"] * 9 + long[:80] + ["y"] * 30 + long[110:])), (102, None), (103, ""), (None, items[1][1]), rows[3], rows[3], (5, items[2][1])]
    bench = spark.createDataFrame([(k, t, "x", 1) for k, t in items], "item_id long, text string, item string, seed int")
    got = decontam.overlaps(frame(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words, r.n_same) for r in got}
    assert found == longest_overlaps(rows, items) and len(got) == len(found) and found[100, 0] == (0, 0, 200, 160)
    assert {(None, 1), (5, 2)} <= set(found) and {j for _, j in found} >= {0, 1, 2, 3, 5, 6, 7, 8, 9, None}


# -- licenses


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License. Again UNDER THE MIT LICENSE!"), (2, "Apache-License,\nVersion 2.0 or cc-by-nc"), (3, "under the terms of the mit license"), (4, "mit dem und mit license of"), (5, None), (6, ""),
        (7, "the K apache licence version 2"), (8, "work " * 50_000 + "cc by nc"), (None, "cc by nc"), (1, "cc by nc"), (9, "GNU General Public License, version 3"),
    ]
    rows += [rows[0]]
    got = sorted((tuple(r) for r in licenses.scan(frame(spark, rows)).collect()), key=str)
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == len(rows) and got.count(by[(1, 10)]) == 2
    assert by[(1, 10)][2:7] == (2, 1, 6, "mit", "mit") and by[(1, 3)][2:7] == (1, 0, 0, "cc-by-nc", "cc-by-nc")
    assert by[(2, 9)][2:7] == (2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert by[(3, 7)][2:7] == (0, None, None, "", "mit") and by[(4, 6)][5:7] == ("", "") and by[(5, 0)][2:] == (0, None, None, "", "", 0.0)
    assert by[(8, 50_003)][2:5] == (1, 50_000, 50_000) and by[(9, 6)][5:7] == ("", "gpl") and by[(7, 6)][2] == 0  # U+212A is a letter and a word of its own
    assert licenses.scan(frame(spark, [])).count() == 0


def naive_scan(text):
    """labels of the templates beyond the base phrases, and the best share."""
    w = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    labels, score = set(), 0.0
    for t in licenses.TEMPLATES:
        own = licenses.template_words(t.text)
        grams = len(own) - 2
        hits = sorted((p - k, p, k) for k in range(grams) for p in range(len(w) - 2) if w[p : p + 3] == own[k : k + 3])
        span, before, spans = 0, None, {}
        for d, p, k in hits:
            span += before is not None and d - before > licenses.NEAR
            before = d
            spans.setdefault(span, []).append((p, k))
        for own_hits in spans.values():
            for p, _ in own_hits:
                share = len({k for q, k in own_hits if p <= q <= p + grams * 6 // 5 + licenses.NEAR}) / grams
                score = max(score, share)
                if share >= t.share:
                    labels.add(t.label)
    return ",".join(sorted(labels)), score


def test_licenses_equal_brute_force(spark):
    rng = random.Random(31)
    filler = [f"word{k}" for k in range(50)] + ["the", "license", "software", "a", "copy", "of"]
    rows = []
    for i in range(60):
        w = [rng.choice(filler) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            own = licenses.template_words(rng.choice(licenses.TEMPLATES).text)
            own = own[: rng.randint(3, len(own))] if i % 2 else own
            for _ in range(rng.choice([0, 0, 1, 3])):
                own.insert(rng.randrange(len(own) + 1), rng.choice(filler))
            at = rng.randint(0, len(w))
            w[at:at] = own
        rows.append((i, " ".join(w)))
    notice = licenses.template_words(licenses.TEMPLATES[13].text)[:18]
    rows += [(100, " ".join(notice)), (101, " ".join(notice + [f"q{k % 7} a copy" for k in range(60)])), (102, "x " * 3000 + licenses.TEMPLATES[11].text + " y" * 3000)]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {i: (a, round(b, 9)) for i, t in rows for a, b in [naive_scan(t)]}
    assert "mit" in got[100][0] and "mit" in got[101][0] and got[102] == ("mit", 1.0)


def test_licenses_hold_long_templates(spark):
    long = licenses.Template("long", " ".join(f"v{k}" for k in range(300)), share=0.9)
    docs = frame(spark, [(1, "a b " + long.text), (2, " ".join(long.text.split()[:200]))])
    assert {r.doc_id: (r.labels, round(r.score, 2)) for r in licenses.scan(docs, (long,)).collect()} == {1: ("long", 1.0), 2: ("", 0.66)}


# -- fingerprints


def test_samples_equal_brute_force(spark):
    import struct

    import xxhash

    mask = (1 << 64) - 1
    h64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed & mask)
    uniform = lambda x, bit: ((x >> bit & 0xFFFF) + 0.5) / 65536
    texts = {1: "a b c a a ß d", 2: "b c " * 40 + "x y z", 3: "one"}
    got = {r.doc_id: r.sample for r in fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        want = []
        for k in range(fingerprints.SAMPLES):
            best = None
            for w, n in collections.Counter(t.split()).items():
                h = h64(w.encode(), 42)
                x, y = (h64(struct.pack("<i", 2 * (k % 8) + j + k // 8 * 16), h64(struct.pack("<Q", h), 42)) for j in (0, 1))
                r, log_c = -np.log(uniform(x, 0) * uniform(x, 16)), np.log(-np.log(uniform(x, 32) * uniform(x, 48)))
                step = int(np.floor(np.log(n) / r + uniform(y, 0)))
                rank = int((log_c - r * (step - uniform(y, 0) + 1) + 64) * (1 << 32))
                best = min(best or (rank, 0), (rank, (y >> 48) + step * 40503 & 0xFFFF)) if best else (rank, (y >> 48) + step * 40503 & 0xFFFF)
            want.append(best[1])
        assert got[i] == want


def test_fingerprints(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randrange(9)) for _ in range(rng.randint(20, 200)))
    rows = [(i * 3, text()) for i in range(25)] + [(100, "same text here"), (101, "same text here"), (102, None), (103, ""), (104, "?!"), (105, "größer 𝔘𝔫𝔦 " * 9)]
    got = {r.doc_id: r for r in fingerprints.compared(frame(spark, rows)).collect()}
    order = sorted(dict(rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        t, n = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - n] + texts[order[(k + 1) % len(order)]][:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[100].fingerprint == got[101].fingerprint and got[101].near_next == 1.0 and got[103].fingerprint == got[104].fingerprint
    # estimates follow the generalised Jaccard similarity
    words = lambda t: collections.Counter(t.lower().split())
    errors = []
    for k, i in enumerate(order[6:], 6):
        a, b = words(texts[i]), words(texts[order[(k + 1) % len(order)]])
        errors.append(got[i].near_next - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(errors)) < 0.08
    alone = fingerprints.compared(frame(spark, [(1, "just one text"), (1, "just one text")])).collect()
    assert [r.near_next for r in alone] == [1.0, 1.0]
    assert fingerprints.compared(frame(spark, [])).count() == 0
    odd = fingerprints.compared(frame(spark, [(None, "a b"), (5, "a c"), (5, "b d")])).collect()
    assert len(odd) == 3 and fingerprints.fingerprints(frame(spark, rows)).count() == len(rows)


# -- chat


def test_chat(spark):
    rng = random.Random(9)
    logs = {}
    for c in range(40):
        base = [("user" if k % 2 == 0 else "assistant", f"t{rng.randrange(3)}") for k in range(rng.randint(1, 5))]
        logs[c] = [("system", "common"), *base] if c % 2 else base
    logs[50] = [("user", f"long {k}") for k in range(700)]
    logs[51] = logs[50][:300]
    logs[52] = [(None, None)]
    rows = [(c, t * 3 + 1, r, x, "y") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += rows[:5]  # turns that repeat
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    seq = {c: [(r or "", x or "") for r, x in t] for c, t in logs.items()}
    want = {}
    for c, t in seq.items():
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in seq.values())
        twin = any(d < c and u == t for d, u in seq.items())
        if not longer and not twin:
            want[c] = [f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t]
    got = collections.defaultdict(dict)
    for r in chat.render(df).collect():
        got[r.conv_id][r.place] = r.rendered
    assert {c: [v[k] for k in range(len(v))] for c, v in got.items()} == want
    assert chat.render(df.limit(0)).count() == 0
    assert [tuple(r) for r in chat.render(spark.createDataFrame([(None, None, "user", "x")], "conv_id long, turn long, role string, text string")).collect()] == [(None, 0, "<|im_start|>user\nx<|im_end|>\n")]


# -- toxicity


def test_toxicity(spark):
    rng = random.Random(10)
    plain = [f"word{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        if bad:
            w[1:1] = rng.sample(["awfulone", "awfultwo", "horridthing", "nastything"], 2)
        rows.append((i, " ".join(w)))
        if i < 400:
            marks.append((i, rng.randrange(2), int(bad)))
        else:
            rows[-1] = (i, rows[-1][1])
    truth = {i: any(x in t for x in ("awful", "horrid", "nasty")) for i, t in rows}
    rows += [(9000, None), (9001, ""), (None, "word1"), (9002, "word2 " * 50_000)]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scores(docs, chain).collect()}
    held = [i for i in range(400, 600)]
    assert np.mean([got[i].rejected == truth[i] for i in held]) > 0.97
    assert not got[9000].rejected and not got[9001].rejected and not got[9002].rejected and 0 <= got[9000].p_low_quality <= 1
    plain = dict(rows)
    for i in (*held[:40], 9000, 9001, 9002):  # each row by itself
        p = chain.predict([toxicity.features(plain[i])])[0]
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic], p, atol=1e-6) and got[i].rejected == (p[-1] >= toxicity.THRESHOLD)
    kept = toxicity.apply(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    none = toxicity.train(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.scores(docs, none).collect()) and toxicity.scores(docs.limit(0), chain).count() == 0


# -- shards


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, "file://" + str(tmp_path / "s"), target_bytes=60_000, fanout=3, small_rows=50)
    docs = spark.range(1000).selectExpr("id AS doc_id", "IF(id % 7 = 0, NULL, sha2(string(id), 512)) AS text", "'x' AS shard", "1 AS bytes").repartition(3)
    assert store.version() == 0
    first = store.append(docs)
    before = store.manifest(first).count()
    while store.compact():
        pass
    last = store.version()
    entries = store.manifest().collect()
    assert first == 1 and last > 1 and len(entries) < before and sum(r.rows for r in entries) == 1000
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read().select(*docs.columns).collect())) == want == sorted(map(str, store.read(1).select(*docs.columns).collect()))
    assert store.vacuum() == 0 and store.vacuum(keep=1, older_than=0) >= before and sorted(map(str, store.read().select(*docs.columns).collect())) == want
    with pytest.raises(FileNotFoundError):  # an old version whose shards are gone is no shorter version
        store.read(1)
    store.append(docs.limit(0))
    store.append(docs.limit(10))
    assert store.read().count() == 1010 and sum(r.rows for r in store.manifest().collect()) == 1010
    with pytest.raises(Exception, match="exist"):  # another writer has taken the number
        store._commit(store.manifest(), store.version() - 1, docs.schema)
    with pytest.raises(ValueError, match="not struct"):
        store.append(docs.withColumn("bytes", F.lit("x")))
    store.append(docs.select("bytes", "shard", "text", "doc_id").limit(1))
    assert store.read().count() == 1011


def test_shards_vacuum_beside_an_append(spark, tmp_path):
    store = shards.ShardStore(spark, "file://" + str(tmp_path / "s"), small_rows=5)
    docs = spark.range(10).selectExpr("id AS doc_id", "repeat('x', 3) AS text")
    store.append(docs)
    commit = store._commit

    def late(*args):
        assert shards.ShardStore(spark, store.path).vacuum() == 0
        return commit(*args)

    store._commit = late
    assert store.append(docs) == 2 and store.read().count() == 20
    store._commit = lambda *args: (shards.ShardStore(spark, store.path).vacuum(older_than=0), commit(*args))
    with pytest.raises(Exception, match="exist|gone"):  # what is gone is not committed
        store.append(docs)
    assert store.version() == 2 and store.read().count() == 20


def test_shards_keep_the_version_before(spark, tmp_path):
    store = shards.ShardStore(spark, "file://" + str(tmp_path / "s"), target_bytes=1 << 20, fanout=2, small_rows=5)
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('x', 3) AS text")
    store.append(docs)
    before = store.read()
    assert store.compact() == 2 and store.vacuum(keep=2, older_than=0) == 0
    assert before.count() == 40 and store.read(1).count() == 40 and store.read().count() == 40


def test_shards_of_nothing(spark, tmp_path):
    store = shards.ShardStore(spark, "file://" + str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.read()
    docs = spark.range(0).selectExpr("id AS doc_id", "'x' AS text")
    assert store.append(docs) == 1 and store.compact() is None and store.vacuum() == 0
    assert store.read().columns == ["doc_id", "text"] and store.read().count() == 0
    assert store.append(spark.range(3).selectExpr("id AS doc_id", "repeat('y', 2000000) AS text")) == 2 and store.read().count() == 3
