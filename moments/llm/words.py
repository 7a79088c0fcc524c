"""BPE encoding and decoding through a table of distinct words.

A tokenizer whose normaliser and splitter never look across white space gives for a text the ids of its
words, one after the other. So every distinct word is encoded once:

1. ``mapInArrow`` over the documents splits each block of texts at ASCII white space. The positions' codes into the
   block's list of distinct words go into a file of the shared folder; the lists themselves, cut by a hash of the word
   into buckets, are written as a table, which also names the file. Files that it doesn't name don't count.
2. All lists of a bucket come together, so each distinct word is encoded in one place, once.
3. The ids go back to their blocks. There, with the block's file, they are put in the order of the positions, some
   documents at a time, and decoded through the vocabulary's id-to-piece table.

What is shuffled are the distinct words of blocks and their ids, compressed, never texts or occurrences; a word that is in
every document costs one entry a block.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.util import Scratch, pick, text_or_empty, trimmed

#: Text of a block. All that a worker holds at a time is a small multiple of it, or of the one text that is larger.
BLOCK_BYTES = 24_000_000
#: Words that the tokenizer gets at a time (each of its results takes about a kilobyte), and numbers packed at a time.
ENCODE_WORDS, PACK_NUMBERS = 4096, 1 << 19
#: Words of documents that are put together at a time.
JOIN_WORDS = 400_000
#: Buckets of words, at most, as every block has a row for each: with more of both the rows would grow as the square of the
#: input. Words of one bucket that are remembered, at most but for those of its last block.
MOST_BUCKETS, KNOWN_WORDS = 256, 300_000


class Codes(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of about ``most`` bytes of text, of a row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def pack(numbers: np.ndarray) -> bytes:
    """Variable-length bytes, seven bits each, least significant first."""
    return b"".join(_packed(numbers[k : k + PACK_NUMBERS]) for k in range(0, len(numbers), PACK_NUMBERS))


def _packed(numbers: np.ndarray) -> bytes:
    v = numbers.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        if not (more := v >= np.uint64(1) << np.uint64(7 * k)).any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(size.max())):
        at = size > k
        low = ((v[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[(ends - size)[at] + k] = low | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack(blob: bytes, dtype=np.int64) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    out, at = [np.empty(0, dtype)], 0
    while at < len(b):
        end = min(at + PACK_NUMBERS, len(b))
        while b[end - 1] >= 128:
            end += 1
        out.append(_unpacked(b[at:end]).astype(dtype))
        at = end
    return np.concatenate(out)


def _unpacked(b: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


SPLIT_SCHEMA = "block long, bucket int, n long, words binary, file string"


def _squeeze(blob: bytes) -> bytes:
    return pa.compress(blob, "zstd", asbytes=True)


def _unsqueeze(blob: bytes) -> bytes:
    """The size goes in front, as the codec asks for it."""
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _sized(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + _squeeze(blob)


def _splitter(base: str, buckets: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, counts, parts, size
            coded = pa.chunked_array(parts, pa.string()).dictionary_encode().chunks  # all of one dictionary
            parts = []
            flat, words = np.concatenate([c.indices.to_numpy() for c in coded]), coded[0].dictionary.to_numpy(zero_copy_only=False)
            del coded
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often))
            words = words[often]
            bucket = (hash_array(words) % np.uint64(buckets)).astype(np.int64) if len(words) else np.empty(0, np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            file = f"{part:06d}-{made:04d}-{uuid.uuid4().hex[:8]}.codes"
            with system.open_output_stream(f"{root}/{file}") as out:
                known = np.array([d is not None for d in ids], np.uint8).tobytes()
                blobs = [_sized(x) for x in (np.array([d or 0 for d in ids], "<i8").tobytes() + known, pack(np.concatenate(counts)), pack(order), pack(rank[flat]))]
                out.write(struct.pack("<QQ4Q", len(ids), buckets, *map(len, blobs)) + b"".join(blobs))
            used = np.flatnonzero(np.diff(edges)).tolist() or [0]
            lists = [words[order[edges[k] : edges[k + 1]]].tolist() for k in used]
            n = len(used)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 24 | made] * n, pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([_sized("\n".join(x).encode()) for x in lists], pa.binary()),
                    pa.array([f"{base}/{file}"] * n, pa.string()),
                ],
                ["block", "bucket", "n", "words", "file"],
            )
            made += 1
            ids, counts, parts, size = [], [], [], 0
            return row

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1), BLOCK_BYTES // 4):
                lists = pc.ascii_split_whitespace(texts)
                parts.append(lists.flatten())
                ids += keys[at : at + len(texts)]
                counts.append(pc.list_value_length(lists).to_numpy())
                at, size = at + len(texts), size + texts.nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return split


ENCODED_SCHEMA = "block long, bucket int, file string, ids binary, sizes binary"


def load_tokenizer(path: str):
    """The tokenizer of a file with truncation and padding off, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(2)
def pieces(path: str) -> pa.Array:
    """The id-to-piece table of a file; a worker keeps it, but not the tokenizer."""
    table = {i: p for p, i in load_tokenizer(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([table.get(i, "") for i in range(max(table) + 1)])


def _encoder(path: str, most: int = KNOWN_WORDS):
    """Rows come sorted by bucket, so what is remembered is one bucket's distinct words, each encoded once; of a bucket of
    over ``most`` they are forgotten then, and words that come again are encoded again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(path)
        known: dict[str, bytes] = {}
        current = None
        for batch in batches:
            for k in range(batch.num_rows):
                block, bucket, blob, file = (batch.column(c)[k].as_py() for c in range(4))
                if bucket != current or len(known) > most:
                    known, current = {}, bucket
                words = _unsqueeze(blob).decode().split("\n")
                new = list(set(words).difference(known))
                for at in range(0, len(new), ENCODE_WORDS):
                    some = new[at : at + ENCODE_WORDS]
                    known.update(zip(some, [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(some, add_special_tokens=False)], strict=True))
                got = [known[w] for w in words]
                sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
                flat = np.frombuffer(b"".join(got), "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([file]), pa.array([_sized(flat.view(np.uint8).reshape(-1, 4).T.tobytes())]), pa.array([_sized(pack(sizes))])],
                    ["block", "bucket", "file", "ids", "sizes"],
                )

    return encode


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block; they come sorted by block and bucket."""
    rows: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if rows and row["block"] != rows[0]["block"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _assembled(rows: list[dict], vocabulary: pa.Array, digests: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(rows[0]["file"])
    with system.open_input_file(name) as source:
        raw = source.read()
    n_docs, _, *lengths = struct.unpack_from("<QQ4Q", raw)
    at, blobs = 48, []
    for n in lengths:
        blobs.append(_unsqueeze(raw[at : at + n]))
        at += n
    doc_ids = pa.array(np.frombuffer(blobs[0], "<i8", n_docs), mask=np.frombuffer(blobs[0], np.uint8, n_docs, 8 * n_docs) == 0)
    n_words, order, codes = unpack(blobs[1]), unpack(blobs[2]), unpack(blobs[3], np.int32)
    del raw, blobs
    sizes, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    sizes[order] = np.concatenate([unpack(_unsqueeze(r["sizes"])) for r in rows])
    flat = np.concatenate([np.frombuffer(b := _unsqueeze(r["ids"]), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1) for r in rows])
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    # Words as strings of ids and of pieces, in the order of their codes; words without ids drop out.
    mine = pa.array(flat[_spans(starts, sizes)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    texts = [pc.binary_join(pa.ListArray.from_arrays(offsets, v), " ") for v in (pc.cast(mine, pa.string()), vocabulary.take(mine))]
    ends, d = np.cumsum(n_words), 0
    while d < n_docs:  # some documents at a time, one at least
        first = int(ends[d - 1]) if d else 0
        e = max(d + 1, int(np.searchsorted(ends, first + JOIN_WORDS, "right")))
        part = codes[first : int(ends[e - 1])]
        bounds = np.concatenate([[0], ends[d:e] - first])
        has = sizes[part]
        n_tokens = np.diff(np.concatenate([[0], np.cumsum(has)])[bounds])
        if len(has) and not has.all():
            bounds = np.concatenate([[0], np.cumsum(has > 0)])[bounds]
            part = part[has > 0]
        lists, taken, columns = pa.array(bounds, pa.int32()), pa.array(part), []
        for words in texts:
            joined = pc.binary_join(pa.ListArray.from_arrays(lists, words.take(taken)), " ")
            if digests:
                data, edges = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int32, e - d + 1, 4 * joined.offset).tolist()
                joined = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)], pa.string())
            columns.append(joined)
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        yield pa.RecordBatch.from_arrays([doc_ids.slice(d, e - d), pa.array(n_tokens, pa.int64()), *columns], names)
        d = e


def _assembler(path: str, digests: bool):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            yield from _assembled(rows, pieces(path), digests)

    return assemble


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, digests: bool = True, buckets: int | None = None) -> DataFrame:
    """Encodes and decodes every whole text.

    Reads ``doc_id, text``; other columns are ignored, whatever their names. One row comes back per input row, repeated
    ids included: ``doc_id, n_tokens`` and, with ``digests``, ``ids_sha256, decoded_sha256``, else ``ids`` (decimal,
    separated by a space) and ``decoded``. A null or empty text has no tokens; a null id stays null; an empty table
    gives an empty result. A text larger than a block is a block of its own. ``buckets`` of words: as many as shuffle
    partitions, but ``MOST_BUCKETS`` at most, unless given.
    """
    scratch = Scratch(spark, "words")
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    texts = pick(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    split = scratch.write(texts.mapInArrow(trimmed(_splitter(scratch.path("codes"), buckets)), SPLIT_SCHEMA), "split")
    lists = split.select("block", "bucket", "words", "file").repartition("bucket").sortWithinPartitions("bucket", "block")
    encoded = lists.mapInArrow(trimmed(_encoder(tokenizer_path)), ENCODED_SCHEMA)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    return encoded.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(trimmed(_assembler(tokenizer_path, digests)), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_roundtrip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
