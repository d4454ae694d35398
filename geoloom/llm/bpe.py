"""BPE encoding and decoding through a table of distinct words.

``encode`` splits every text into the words that the tokenizer's normaliser and
pre-tokeniser make of it, encodes each distinct word once with the tokenizers
library, and joins the ids back by position:

1. Each task reads its documents in blocks of bounded size. A block has a local
   word list, ordered by frequency, and the documents become sequences of local
   numbers. The block's words are dealt by hash into word buckets.
2. A shuffle by bucket brings all copies of a word together; the bucket's table
   of distinct words is encoded, each word once.
3. A shuffle by block brings a block's word ids and its sequences together; the
   ids are gathered by position.

No word, document or source can make a hot task: a word crosses the first
shuffle once a block, however often it occurs, and blocks are bounded.

``decode`` joins ids with the vocabulary's id-to-piece table. The table is as
large as the vocabulary, whatever the corpus; it is sent to each executor.

Defined results: a null text counts as empty and gives no ids and an empty
decoded text. Null or repeated document ids are kept; each row is its own
document. Very long texts are worked on whole. An empty table gives no rows. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_bytes, pack_u32, partitions, released, ship, take_runs, unpack_bytes, unpack_u32

#: Bytes of text after which a block is closed.
BLOCK_CHARS = 24_000_000
#: Words that one call encodes.
WORDS_TOGETHER = 50_000
#: Bytes of text that are split together.
SPLIT_CHARS = 6_000_000
#: Words after which a segment of a block's sequences is closed.
SEGMENT_WORDS = 1_000_000
#: Word buckets at most, so that a block's rows don't grow with the number of partitions.
BUCKETS = 256
#: Documents and ids that are decoded together; pieces are joined in arrays of 32-bit offsets.
TOGETHER, TOGETHER_IDS = 256, 4_000_000
#: Words that a bucket's table holds at once; a larger table is begun anew, so
#: that memory stays bounded (a word is then encoded once in each part).
TABLE_WORDS = 1_500_000
#: White space of the tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_loaded: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """The vocabulary file's steps, apart: special tokens, words, word ids.

    It serves files whose normaliser is NFC, white space and lower case and
    whose pre-tokeniser is one split pattern before byte-level BPE.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError(f"{path}: not a word-level file of the kind this operator knows")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace("[^\\s", f"[^{SPACE}")
        self.words_of, self.marked = regex.compile(pattern).findall, regex.compile(pattern + "|\n").findall
        whole = Tokenizer.from_file(path)
        self.pieces = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size(with_added_tokens=True))]
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = spec["pre_tokenizer"]["pretokenizers"][1]
        self.of_word = Tokenizer.from_str(json.dumps(spec))

    @staticmethod
    def lower(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case by character, whatever follows
        return text.lower()

    def plain(self, text: str) -> list[str]:
        return self.words_of(self.lower(text))

    def words_of_many(self, stretches: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of stretches without white space and special tokens, and how many each has; one pass over all."""
        marked = self.marked(self.lower("\n".join(stretches))) if stretches else []
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, marked), bool, len(marked)))
        ends = np.append(ends, len(marked)) - np.arange(len(ends) + 1)
        return [w for w in marked if w != "\n"], np.diff(ends, prepend=0)[: len(stretches)]

    def words(self, text: str | None) -> list[str]:
        """The text's words in order; a special token stands as "\\n" and its content."""
        if not text:
            return []
        if "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += ["\n" + part] if k % 2 else self.plain(part)
        return out

    def words_of_missing(self, stretches: list[str], missing: np.ndarray) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
        """(numbers, stretches, all their words, words of each) of the stretches with the given numbers, in an order of its own."""
        new = [stretches[k] for k in missing.tolist()]
        odd = np.fromiter(("<|" in x for x in new), bool, len(new))  # perhaps a special token
        missing = np.concatenate([missing[~odd], missing[odd]])
        new = [stretches[k] for k in missing.tolist()]
        even = len(new) - int(odd.sum())
        words, counts = self.words_of_many(new[:even])
        parts = [self.words(x) for x in new[even:]]
        words += chain.from_iterable(parts)
        return missing, new, words, np.concatenate([counts, [len(p) for p in parts]]).astype(np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = getattr(self.of_word, "encode_batch_fast", self.of_word.encode_batch)  # without offsets, where there is one
        out = [x.ids for x in encode(words, add_special_tokens=False)]
        for k, w in enumerate(words):
            if w[:1] == "\n":
                out[k] = [self.special[w[1:]]]
        return out

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and how many each has; words go to the library together."""
        if any(w[:1] == "\n" for w in words):
            ids = self.encode(words)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), WORDS_TOGETHER):
            own = words[k : k + WORDS_TOGETHER]
            done = self.of_word.encode(own, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(done.ids, np.uint32))
            counts.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(own)))
        return np.concatenate(flat), np.concatenate(counts)


def tokenizer(path: str) -> WordTokenizer:
    """The file's tokenizer, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class Table:
    """Ids by string, in one growing array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, keys: list[str], n: np.ndarray, flat: np.ndarray) -> None:
        k = len(self.at)
        while len(self.starts) < k + len(keys):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.starts[k : k + len(keys)] = self.used + np.cumsum(n) - n
        self.lengths[k : k + len(keys)] = n
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(keys, range(k, k + len(keys))))

    def find(self, keys: list[str]) -> np.ndarray:
        """The keys' numbers; -1 for those that are not there."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))


_PARTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("docs", pa.binary()), ("body", pa.binary())])
_PARTS_SQL = "bucket int, block long, part long, docs binary, body binary"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], int, pa.ListArray]]:
    """(document ids, characters, stretches between white space) of a bounded number of documents or characters."""
    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())])
        a = 0
        while a < len(batch):
            b = min(max(a + 1, int(np.searchsorted(sizes, sizes[a] + SPLIT_CHARS, side="right")) - 1), a + 2_000, len(batch))
            texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
            yield batch.column(0).slice(a, b - a).to_pylist(), int(sizes[b] - sizes[a]), pc.ascii_split_whitespace(texts)
            a = b


def _split_blocks(path: str, buckets: int):
    """Documents to word parts (bucket >= 0, part = bucket) and sequence parts (bucket < 0)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(path)
        block = TaskContext.get().partitionId() << 24
        local: dict[str, int] = {}
        known = Table()  # local numbers of the words in each stretch between white space, which no word crosses
        seqs: list[np.ndarray] = []
        docs: list[int | None] = []
        chars = 0

        def close() -> Iterator[pa.RecordBatch]:
            words = list(local)
            lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
            flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            home = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            by = np.lexsort((rank, home))
            edges = np.searchsorted(home[by], np.arange(buckets + 1))
            out: list[tuple] = []
            for b in range(buckets):
                own = by[edges[b] : edges[b + 1]]
                if len(own):
                    text = "\0".join([words[i] for i in own]).encode()
                    out.append((b, block, b, pack_u32(np.diff(rank[own], prepend=np.uint32(0))), pack_bytes(text)))
            at = first = 0
            for k in range(len(docs)):
                if k + 1 == len(docs) or lengths[first : k + 1].sum() >= SEGMENT_WORDS:
                    n = int(lengths[first : k + 1].sum())
                    body = pack_u32(rank[flat[at : at + n]])
                    ids = np.array([d or 0 for d in docs[first : k + 1]], np.int64)
                    null = np.array([d is None for d in docs[first : k + 1]], np.uint8)
                    head = pack_bytes(np.concatenate([lengths[first : k + 1].view(np.uint8), ids.view(np.uint8), null]).tobytes())
                    out.append((-1 - (block + first) % buckets, block, buckets + first, head, body))
                    at, first = at + n, k + 1
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), _PARTS.types)], schema=_PARTS)

        for doc, size, stretches in _stretches(batches):
            coded = stretches.values.dictionary_encode()
            texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = known.find(texts)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                missing, new, words, counts = tok.words_of_missing(texts, missing)
                for w in words:
                    if w not in local:
                        local[w] = len(local)
                at[missing] = np.arange(len(known.at), len(known.at) + len(new))
                known.add(new, counts, np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
            own = at[coded.indices.to_numpy()]
            n = known.lengths[own]
            flat = known.ids[take_runs(known.starts[own], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[stretches.offsets.to_numpy()]
            seqs += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            docs += doc
            chars += size
            if chars >= BLOCK_CHARS:
                yield from close()
                block += 1
                local, known, seqs, docs, chars = {}, Table(), [], [], 0
        if docs:
            yield from close()

    return run


def _encode_buckets(path: str):
    """Word parts to id parts: each distinct word of the bucket is encoded once. Sequences pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        table: dict[str, int] = {}
        ids = np.zeros(0, np.uint32)
        lengths = np.zeros(0, np.int64)
        starts = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] >= 0:
                    words = unpack_bytes(row["body"]).decode().split("\0")
                    if len(table) > TABLE_WORDS:
                        table, ids, lengths, starts = {}, ids[:0], lengths[:0], starts[:0]
                    if new := [w for w in words if w not in table]:
                        more, n = tok.encode_flat(new)
                        starts = np.concatenate([starts, len(ids) + np.cumsum(n) - n])
                        lengths = np.concatenate([lengths, n])
                        ids = np.concatenate([ids, more])
                        table.update(zip(new, range(len(table), len(table) + len(new))))
                    at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                    n = lengths[at]
                    row["body"] = pack_u32(np.concatenate([[len(at)], n, ids[take_runs(starts[at], n)]]))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    return run


def _gather(finish):
    """A block's id parts come first, then its sequences; finish(docs, offsets, ids) gives the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        table = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, parts, table = row["block"], [], None
                if row["bucket"] >= 0:
                    parts.append((unpack_u32(row["docs"]), unpack_u32(row["body"])))
                    continue
                if table is None:
                    table, parts = _word_table(parts), []
                ids, lengths, starts = table
                head = np.frombuffer(unpack_bytes(row["docs"]), np.uint8)
                k = len(head) // 17
                words = head[: 8 * k].view(np.int64)
                doc = pa.array(head[8 * k : 16 * k].view(np.int64), mask=head[16 * k :].astype(bool))
                seq = unpack_u32(row["body"]).astype(np.int64)
                n = lengths[seq]
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(words)])]
                yield finish(doc, ends, ids[take_runs(starts[seq], n)])

    return run


def _word_table(parts: list) -> tuple:
    """Ids of the block's words by local number: flat ids, lengths, starts."""
    total = sum(len(rank) for rank, _ in parts)
    lengths = np.zeros(total, np.int64)
    starts = np.zeros(total, np.int64)
    flat, base = [], 0
    for delta, body in parts:
        rank, n = np.cumsum(delta.astype(np.int64)), int(body[0])
        own = body[1 : 1 + n].astype(np.int64)
        lengths[rank], starts[rank] = own, base + np.cumsum(own) - own
        flat.append(body[1 + n :])
        base += int(own.sum())
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), lengths, starts


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(released(_split_blocks(path, min(n, BUCKETS))), _PARTS_SQL)
    ids = parts.repartition(n, "bucket").mapInArrow(released(_encode_buckets(path)), _PARTS_SQL)
    return ids.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(released(_gather(finish)), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``."""

    def finish(doc, ends, ids):
        arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc, arr], ["doc_id", "ids"])

    return _encoded(docs, path, id_col, text_col, finish, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the ids' pieces, joined as the library joins them without a decoder, by spaces."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(tokenizer(path).pieces)
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()  # null ids are no ids
            ends, ids = np.concatenate([[0], np.cumsum(n)]), lists.flatten()
            for a, b in _together(ends):
                text = _joined(pieces, pa.array(ends[a : b + 1] - ends[a], pa.int32()), ids.slice(ends[a], ends[b] - ends[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), text], ["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _together(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with few enough ids; one that has more stands alone."""
    a = 0
    while a < len(ends) - 1:
        b = int(np.searchsorted(ends, ends[a] + TOGETHER_IDS, side="right")) - 1
        b = min(max(b, a + 1), a + TOGETHER, len(ends) - 1)
        yield a, b
        a = b


def _joined(pieces: pa.Array, offsets: pa.Array, ids: pa.Array) -> pa.Array:
    base = offsets[0].as_py() if len(offsets) else 0
    if base:
        offsets = pc.subtract(offsets, base)
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(ids)), " ")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and sum up where the ids are gathered."""

    def finish(doc, ends, ids):
        pieces = pa.array(tokenizer(path).pieces)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        of_text: list[str] = []
        for a, b in _together(ends):  # the decoded text is larger than the text
            own = ends[a : b + 1]
            text = _joined(pieces, pa.array(own - own[0], pa.int32()), pa.array(ids[own[0] : own[-1]].astype(np.int32)))
            buf, at = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)
            view = memoryview(buf) if buf is not None else memoryview(b"")
            of_text += [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([doc, pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path, id_col, text_col, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
