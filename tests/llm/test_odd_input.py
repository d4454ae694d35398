"""Stages on empty tables, clashing columns, ties and very long texts."""

import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, decontam, lines, minhash, tokens, toxicity
from geoloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, toxic int, quality int, p_toxic double, rejected boolean, item string, a long, g long, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, 0.5, True, "x", 1, 2, None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x", 5), (1, 0, 0, "y", 6), (2, 0, 0, None, 7), (None, None, None, None, None)], "doc_id long, quality int, toxic int, text string, __gl_doc int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen", "x", 3)], "item_id long, text string, doc string, th int")
    return labels, bench


def stages(side):
    labels, bench = side
    return [lambda d: toxicity.apply(d, labels), lines.apply, minhash.apply, lambda d: decontam.apply(d, bench)]


def test_stages_on_empty_tables(spark, side):
    for stage in stages(side):
        out = stage(docs(spark, []))
        assert out.count() == 0 and out.columns == DOCS.replace(",", "").split()[::2]


def test_stages_keep_clashing_columns_and_nulls(spark, side):
    rows = [(1, "plain words"), (2, None), (None, "other words"), (3, ""), (4, "very long " * 60_000)]
    for stage in stages(side):
        out = stage(docs(spark, rows)).collect()
        assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(i) for i, _ in rows)
        assert all((r.toxic, r.quality, r.p_toxic, r.rejected, r.item, r.a, r.g) == (7, 8, 0.5, True, "x", 1, 2) for r in out)


def test_chat_ties_of_null_turns_and_long_texts(spark):
    long = "y" * 300_000
    rows = [(None, None, "user", "b"), (None, None, "user", "a"), (None, None, "user", "a"), (None, None, "assistant", "z"), (1, 0, "user", long)]
    got = sorted((str(r.conv_id), r.place, r.rendered) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = [("1", 0, f"<|im_start|>user\n{long}<|im_end|>\n"), *[("None", k, f"<|im_start|>{r}\n{t}<|im_end|>\n") for k, (r, t) in enumerate([("assistant", "z"), ("user", "a"), ("user", "b")])]]
    assert got == want


def test_token_files_of_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/ids"
    tokens.write(docs(spark, []), out, tokenizer_path())
    assert tokens.digests(spark, out).count() == 0 == tokens.read(spark, out).count()
    assert docs(spark, [(1, "x")]).filter(F.col("doc_id") > 1).count() == 0
