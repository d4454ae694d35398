"""Encoding, decoding and token files against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoloom.llm import bpe, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [0x3A3, 0x130, 0x301, 0x308, 0x2028, 0x3000, 0x1F600, 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0xFEFF, 0x4E2D, 0x661, 0x2160, 0xE0100, 0x1E9E, 0x212A, 0x2126, 0x344]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 0x250), *ODD]] + [" "] * 80 + list("'s're'll d")
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*made, "<|endoftext|>a<|startoftext|>", "x<|endoftext|>'s <|END", "ΣΑΣ ΟΔΟΣ", None, "", " \n ", "word " * 70_000, *made[:5]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 7 else i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block int")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    ids = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [tok.decode(x, skip_special_tokens=False) for x in ids]


def test_bpe_equals_library(docs, texts):
    ids, decoded = library(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((None if i == 7 else i, len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha(d.encode())) for i, (x, d) in enumerate(zip(ids, decoded)) if i != 7)
    got = [tuple(r) for r in bpe.digests(docs, PATH).collect()]
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(texts)
    encoded = bpe.encode(docs, PATH)
    assert {r.doc_id: list(r.ids) for r in encoded.collect() if r.doc_id is not None} == {i: x for i, x in enumerate(ids) if i != 7}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect() if r.doc_id is not None} == {i: d for i, d in enumerate(decoded) if i != 7}


def test_empty_table(spark, docs, tmp_path):
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    tokens.write(docs.limit(0), str(tmp_path / "t"), PATH)
    assert tokens.digests(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("kind", [1, 8])
def test_token_files_round_trip(spark, docs, texts, tmp_path, kind):
    out = "file://" + str(tmp_path / "t")
    tokens.write(docs.filter("doc_id is not null"), out, PATH, kind=kind)
    ids, _ = library(texts)
    start, want = 0, []
    for i, x in enumerate(ids):
        if i != 7:
            own = [*x, 2]
            want.append((i, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
            start += len(own)
    assert sorted(tuple(r) for r in tokens.digests(spark, out).collect()) == want
    back = {r.doc_id: (r.start, list(r.ids)) for r in tokens.read(spark, out).collect()}
    assert all(back[i] == (s, [*ids[i], 2]) for i, s, *_ in want)
    index = tokens.read_index(spark, out).collect()
    assert sum(r.n_ids for r in index) == start and sorted(r.ids_before for r in index)[0] == 0


@pytest.mark.parametrize("kind", [1, 8])
def test_chunks(kind):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0), np.zeros(9), np.array([2**32 - 1, 0, 7]), rng.integers(0, 49408, 1000)):
        assert (tokens.unpack_chunk(tokens.pack_chunk(ids.astype(np.uint32), kind)) == ids).all()
    with pytest.raises(ValueError):
        tokens.unpack_chunk(b"nope")


def test_crc_of_joined_strings():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 300))
        assert tokens.crc32_concat(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
