import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moments.llm import huffman, neardup, util, words
from tests.llm import common

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_bpe_equals_library(spark):
    tok = Tokenizer.from_file(WORD)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in words.bpe_roundtrip(spark, common.documents(spark), WORD).collect())
    want = []
    for row in common.rows():
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_texts_and_empty_table(spark):
    full = words.bpe_roundtrip(spark, spark.createDataFrame([(1, "The end."), (None, None)], "doc_id long, text string"), WORD, digests=False).collect()
    tok = Tokenizer.from_file(WORD)
    assert {(r.doc_id, r.ids, r.decoded) for r in full} == {(1, " ".join(map(str, tok.encode("The end.", add_special_tokens=False).ids)), "the</w> end</w> .</w>"), (None, "", "")}
    assert words.bpe_roundtrip(spark, common.empty(spark), WORD).count() == 0


def test_bpe_rows_of_a_block_are_bounded(spark, monkeypatch):
    """Blocks times buckets: with as many buckets as partitions, both of which grow with the input, rows grow as its square."""
    rows = {}
    write = words.Scratch.write
    monkeypatch.setattr(words.Scratch, "write", lambda self, df, name, *by: rows.setdefault(name, write(self, df, name, *by)))
    docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(5000)))], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1000)
    try:
        words.bpe_roundtrip(spark, docs, WORD)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows["split"].count() <= words.MOST_BUCKETS


def test_bpe_words_forgotten_are_encoded_again():
    lists = [["the", "ends"], ["ends", "of"], ["the"]]
    rows = pa.RecordBatch.from_pydict({"block": [0, 1, 2], "bucket": [0, 0, 0], "words": [words._sized("\n".join(x).encode()) for x in lists], "file": ["f"] * 3})
    got = [pa.Table.from_batches(words._encoder(WORD, most)(iter([rows]))) for most in (0, 1 << 30)]
    assert got[0].equals(got[1]) and got[0].num_rows == 3


def test_workers_trim_before_and_after(monkeypatch):
    """A worker that was left full by a function over groups, which doesn't see its task's end, is trimmed before it holds more."""
    seen = []
    monkeypatch.setattr(util, "trim", lambda: seen.append("trim"))
    assert list(util.trimmed(lambda batches: (seen.append(b) or b for b in batches))(iter(["a", "b"]))) == ["a", "b"]
    assert seen == ["trim", "a", "b", "trim"]
    node = pa.array([{"k1": 1, "k2": 1}, {"k1": 2, "k2": 2}])
    elements = pa.array([np.arange(100_000, dtype=">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()] * 2)
    pairs = pa.table({"a": node.slice(0, 1), "b": node.slice(1, 1)})
    assert neardup._confirmer(80)(pairs, pa.table({"node": node, "elements": elements})).num_rows == 1
    assert len(seen) == 5


@given(st.lists(st.integers(0, 1 << 62)))
def test_pack(numbers):
    assert words.unpack(words.pack(np.array(numbers, np.uint64))).tolist() == numbers


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from(list(".,!aB.s 1.\n\t\xa0é<|endoftx>")), max_size=40))
def test_pieces_equal_library(text):
    enc = test_pieces_equal_library.__dict__.setdefault("enc", huffman.PieceEncoder(BYTE))
    flat, sizes = enc.encode(pa.array([text, "ab cd", text]))
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in (text, "ab cd", text)]
    assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_words_go_to_the_library_without_separators():
    """Distinct words of any script go many in a text, with no tokens between them but their own, and come back equal."""
    enc, asked = huffman.PieceEncoder(BYTE), []
    tok = enc.tok

    class Spy:
        def encode_batch_fast(self, texts, **k):
            asked.extend(zip(texts, out := tok.encode_batch_fast(texts, **k), strict=True))
            return out

    enc.tok = Spy()
    letters = "abcXYZ\u00e9\u00df\u00c4\u00f1\u03a3\u0434\u05d0\u0e01\u65e5\U00020000"
    distinct = [a + b + c for a in letters for b in letters for c in letters]
    texts = ["", *(" ".join(["first", *distinct[k : k + 700]]) for k in range(0, len(distinct), 650))]
    flat, sizes = enc.encode(pa.array(texts))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for ids in want for i in ids] and sizes.tolist() == [len(x) for x in want]
    lines = [(t.split(), len(e.ids)) for t, e in asked if len(t.split()) > 1]
    assert sorted(w for t, _ in lines for w in t) == sorted(distinct)
    assert all(n == sum(len(tok.encode(" " + w, add_special_tokens=False).ids) for w in t) for t, n in lines)


def test_token_files_equal_library(spark):
    tok, start, want = Tokenizer.from_file(BYTE), 0, []
    rows = common.documents(spark).selectExpr("doc_id", "xxhash64(coalesce(text, '')) h", "coalesce(text, '') text").collect()
    for doc_id, _, text in sorted(map(tuple, rows)):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    manifest = huffman.write_token_files(spark, common.documents(spark), BYTE, 2)
    got = huffman.read_token_files(manifest, with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got) == sorted(want)
    files = sorted((r.file.rpartition("/")[2], r.start) for r in manifest.collect())
    assert [s for _, s in files] == sorted(s for _, s in files)


def test_token_files_of_nothing(spark):
    assert huffman.read_token_files(huffman.write_token_files(spark, common.empty(spark), BYTE, 2)).count() == 0
    got = huffman.read_token_files(huffman.write_token_files(spark, spark.createDataFrame([(None, None)], "doc_id long, text string"), BYTE, 2)).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1)]


@pytest.mark.parametrize("n, limit", [(1, 4), (2, 4), (9, 4), (16, 4), (300, 9), (5000, 13), (5000, 18)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths.astype(float)).sum() <= 1
    ids = rng.choice(n, 3000, p=counts / counts.sum()).astype(np.uint32)
    book = huffman.Book(lengths)
    bits, checks = huffman.pack_bits(ids, book)
    assert huffman.unpack_bits(bits, checks, len(ids), book.table(), book.bits).tolist() == ids.tolist()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(counts, 18) * counts).sum() == cost
    assert (huffman.code_lengths(counts, 4) * counts).sum() >= cost
