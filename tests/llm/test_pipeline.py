"""The pipeline's stages on a small corpus with planted cases."""

import random


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = [f"w{k}x" for k in range(800)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    common = "This very line stands in many documents."
    docs, marks = {}, []
    for i in range(240):
        docs[i] = text(rng.randint(3, 9))
    docs[2] = text(9)
    for i in range(240, 320):  # toxic
        docs[i] = text(4).replace(" ", " horribleword ", 2)
    near = {320: docs[0], 321: docs[2].replace(docs[2].split()[5], "changed", 1), 322: docs[1] + " "}
    docs |= near
    bench = {0: text(3), 1: text(2)}
    docs |= {330: text(2) + "\n" + bench[0] + "\n" + text(2), 331: bench[1]}
    for i in range(10, 20):
        docs[i] = f"{common}\n{docs[i]}"
    marks = [(i, 1, int(240 <= i < 320)) for i in range(0, 320, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    out, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, d).write.parquet(f"{d}/out{k}")
        out = spark.read.parquet(f"{d}/out{k}")
        seen[name] = {r.doc_id: r for r in out.collect()}
    assert set(seen["toxicity"]) == {i for i in docs if not 240 <= i < 320}
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert [i for i, r in seen["line_dedup"].items() if common in r.text] == [19]
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {320, 321, 322}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {330, 331}
    assert set(seen["bpe"]) == set(seen["decontamination"]) and all(r.n_tokens > 0 for r in seen["bpe"].values())
    assert corpus_pipeline.run(spark, d).count() == len(seen["bpe"])


def test_near_dedup_links_from_080(spark):
    import corpus_pipeline
    from geoloom.llm import minhash

    rng = random.Random(12)
    rows, want = [], set()
    for i in range(0, 80, 2):
        w = [f"v{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        x = list(w)
        for at in (20, 60, 100, 140, 180)[: 4 + (i % 4 > 0)]:  # each takes 5: 180 of 220 are 0.818, 175 of 225 are 0.778
            x[at] = "changed"
        rows += [(i, " ".join(w)), (i + 1, " ".join(x))]
        if i % 4 == 0:
            want.add(i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline._near_dedup(spark, docs, "").collect()}
    assert {i for i, _ in rows} - left == want
    assert minhash.groups(docs, percent=85).filter("not kept").count() == 0  # op7_minhash links from 0.85
    assert (minhash.bands_for(85), minhash.bands_for(80)) == (25, 37)
    assert (1 - 0.80**minhash.ROWS) ** minhash.bands_for(80) < 1e-6
