"""Token ids in a binary file format: canonical length-limited Huffman codes from global counts.

1. Texts are range-partitioned and sorted by document id, encoded, and staged as blocks of about a million ids.
2. Counts of all ids over all blocks (at most one row per id of the vocabulary) give code lengths by package-merge,
   so that no code exceeds ``limit`` bits, and the codes are the canonical ones.
3. Each block is written on its own into a file: header with the code lengths, blocks with their first global position,
   documents and the bit offset of every ``STEP``-th id, an index at the end. Files are written under a name of their
   own attempt; only those in the manifest table, which Spark commits, count.
4. A reader fetches single blocks by range and decodes all stretches between checkpoints side by side, through one
   table indexed by the next ``limit`` bits.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.util import Scratch, pick, text_or_empty
from moments.llm.words import Codes, slices

MAGIC = b"HUFIDS01"
BLOCK_IDS = 1_000_000
STEP = 256
LIMIT = 18
MEMORY_PIECES = 1_300_000
SLICE_BYTES = 20_000_000
#: Words that the library gets in one text.
LINE_WORDS = 200

#: The letter that byte-level pieces have for a space.
SPACE = "\u0120"
#: A word, and marks after it, at which every token ends.
_MARKS_SPACE = "([a-z])([.,!?;:]+) "
_WORD_MARKS = re.compile(r"(\n{0,2}[^\W\d_]+)([^\w\s]+)")


# ---- codes ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for an id that doesn't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    flags, merged = [], weights
    for level in range(limit):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([weights, pairs])
            at = np.argsort(both, kind="stable")
            merged, package = both[at], at >= len(weights)
        else:
            package = np.zeros(len(weights), bool)
        flags.append(package)
    take, n = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for package in reversed(flags):
        packs = int(package[:take].sum())
        n[: take - packs] += 1
        take = 2 * packs
    lengths[order] = n
    return lengths


class Book:
    """Canonical codes of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        self.canon = used[np.lexsort((used, lengths[used]))]
        sizes = self.lengths[self.canon]
        self.bits = int(sizes.max()) if len(sizes) else 1
        spans = np.int64(1) << (self.bits - sizes)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.canon] = (np.cumsum(spans) - spans) >> (self.bits - sizes)
        self._spans = spans

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every value of the next ``bits`` bits."""
        size = 1 << self.bits
        ids, lens = np.zeros(size, np.uint32), np.ones(size, np.uint8)
        n = int(self._spans.sum())
        ids[:n], lens[:n] = np.repeat(self.canon, self._spans), np.repeat(self.lengths[self.canon], self._spans)
        return ids, lens


def pack_bits(ids: np.ndarray, book: Book) -> tuple[bytes, np.ndarray]:
    """The ids' codes, most significant bit first, and the bit offset of every STEP-th id."""
    if not len(ids):
        return b"", np.empty(0, np.uint64)
    sizes = book.lengths[ids]
    ends = np.cumsum(sizes)
    at = ends - sizes
    left = book.codes[ids] << (64 - sizes).astype(np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(left >> shift, first)
    over = np.flatnonzero((at & 63) + sizes > 64)
    out[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at[::STEP].astype(np.uint64)


def unpack_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """The ids again: one lane per checkpoint, all lanes a symbol further at each step."""
    ids, lens = table
    lanes = len(checkpoints)
    if not n:
        return np.empty(0, np.uint32)
    b = np.frombuffer(bits + bytes(STEP * width // 8 + 8), np.uint8).astype(np.uint32)
    windows = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    pos, last = checkpoints.astype(np.int64), len(windows) - 1
    out = np.empty((STEP, lanes), np.uint32)
    drop = np.uint32(32 - width)
    for k in range(min(STEP, n)):
        x = (windows[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)) >> drop
        out[k] = ids[x]
        pos += lens[x]
    return out.T.reshape(-1)[:n]


# ---- texts to ids --------------------------------------------------------------------------------------------


class PieceEncoder:
    """ids of whole texts, equal to the library's, from remembered pieces.

    A byte-level splitter never lets a token run into the next `` word`` or line. So a text is cut before each space and
    line break, each distinct piece is encoded once by the library, and the ids are put together. Where a text has
    other white space, or runs of it, the library encodes that text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if hasattr(self.tok.model, "_resize_cache"):  # each piece is encoded once, so the library need not remember any
            self.tok.model._resize_cache(0)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for p, i in vocabulary.items() if p[:1] == SPACE]] = True
        self.clear()

    def clear(self) -> None:
        self.codes, self.done = Codes(), 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.sizes, self.bad = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, bool))
        self.fill = 0

    def _learn(self) -> None:
        while len(self.codes) > self.done:
            new = list(islice(self.codes, self.done, None))
            n = len(self.codes)
            if n > len(self.starts):
                self.starts, self.sizes, self.bad = (np.concatenate([a, np.zeros(n, a.dtype)]) for a in (self.starts, self.sizes, self.bad))
            plain, good, whole, joined, heads, tails = [], [], [], [], [], []
            for k, p in enumerate(new, self.done):
                if p.isalpha():
                    plain.append(k)
                    continue
                first = p[:2] == "\n\n"
                q = p[2:] if first else p
                body = q[1:] if q[:1] == "\n" and not first else q
                if m := _WORD_MARKS.fullmatch(p):
                    joined.append(k)
                    heads.append(self.codes[m[1]])
                    tails.append(self.codes["\n\n" + m[2]])
                elif body and body.split() == [body]:
                    good.append(k)
                    whole.append(q if first or q[:1] == "\n" else " " + q)
                elif p != "\n\n":
                    self.bad[k] = True
            if plain:  # many in one text: of a word and the space before it, only the first token begins with a space
                words = new if len(plain) == len(new) else [new[k - self.done] for k in plain]
                lines = [" " + " ".join(words[k : k + LINE_WORDS]) for k in range(0, len(words), LINE_WORDS)]
                flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)])
                firsts = np.flatnonzero(self.opens[flat])
                if len(firsts) != len(plain):
                    raise ValueError("not a byte-level tokenizer")
                self._add(plain, flat, np.diff(firsts, append=len(flat)))
            self.done = n
            if whole:
                got = [e.ids for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)]
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                self._add(good, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)
            if joined:
                if len(self.codes) > n:
                    self._learn()
                pairs = np.array([heads, tails]).T.reshape(-1)
                self._add(joined, self._gather(pairs), self.sizes[pairs].reshape(-1, 2).sum(1))

    def _add(self, codes: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.fill + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        self.flat[self.fill : self.fill + len(flat)] = flat
        self.starts[codes], self.sizes[codes] = self.fill + np.cumsum(sizes) - sizes, sizes
        self.fill += len(flat)

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.repeat((self.starts[codes] - ends + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and how many each has."""
        if len(self.codes) > MEMORY_PIECES:
            self.clear()
        cut = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _MARKS_SPACE, "\\1 \n\n\\2 ")
        lists = pc.split_pattern(pc.binary_join_element_wise("", cut, "\n\n"), " ")
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        numbers = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        codes = numbers[pieces.indices.to_numpy()]
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], np.cumsum(self.sizes[codes])])[offsets]
        flat, sizes = self._gather(codes), np.diff(bounds)
        if self.bad[numbers].any():
            odd = np.flatnonzero(np.maximum.reduceat(self.bad[codes], offsets[:-1]))
            parts, at = [], 0
            for d in odd.tolist():
                parts += [flat[at : bounds[d]], ids := np.array(self.tok.encode(texts[d].as_py(), add_special_tokens=False).ids, np.uint32)]
                sizes[d], at = len(ids), bounds[d + 1]
            flat = np.concatenate([*parts, flat[at:]])
        return flat, sizes


_ENCODERS: dict[str, PieceEncoder] = {}

STAGED = "part int, seq int, start long, doc_ids array<long>, n_tokens array<int>, ids binary, hist_ids array<int>, hist_counts array<long>"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of some batches at a time: pieces that come again in ``most`` bytes of text are looked up once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= most:
            yield [i for b in held for i in b.column(0).to_pylist()], pa.concat_arrays([b.column(1) for b in held])
            held, size = [], 0
    if held:
        yield [i for b in held for i in b.column(0).to_pylist()], pa.concat_arrays([b.column(1) for b in held])


def _stage(path: str, end_id: int, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        encoder, part = _ENCODERS[path], TaskContext.get().partitionId()
        seq, start, doc_ids, parts, counts, waiting = 0, 0, [], [], [], 0
        hist = np.zeros(1 << 16, np.int64)
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("ids", pa.binary()), ("hist_ids", pa.list_(pa.int32())), ("hist_counts", pa.list_(pa.int64()))])

        def row(ids=None, sizes=None, blob=None, h=None) -> pa.RecordBatch:
            hi = None if h is None else np.flatnonzero(h)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([part, seq, start, ids, sizes, blob, hi, None if h is None else h[hi]], schema, strict=True)], schema=schema)

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, doc_ids, parts, counts, waiting, hist
            flat = np.concatenate(parts)
            n = np.bincount(flat)
            if len(n) > len(hist):
                hist = np.concatenate([hist, np.zeros(len(n) - len(hist), np.int64)])
            hist[: len(n)] += n
            out = row(doc_ids, counts, flat.astype(kind).tobytes())
            seq, start, doc_ids, parts, counts, waiting = seq + 1, start + len(flat), [], [], [], 0
            return out

        end = np.array([end_id], np.uint32)
        for ids, held in _gathered(batches, SLICE_BYTES):
            at = 0
            for texts in slices(held, 2 * SLICE_BYTES):
                flat, sizes = encoder.encode(texts)
                ends = np.cumsum(sizes).tolist()
                for doc_id, a, b in zip(ids[at : at + len(texts)], [0, *ends], ends, strict=False):
                    doc_ids.append(doc_id)
                    parts += [flat[a:b], end]
                    counts.append(b - a + 1)
                    waiting += b - a + 1
                    if waiting >= BLOCK_IDS:
                        yield flush()
                at += len(texts)
        if doc_ids:
            yield flush()
        yield row(h=hist)

    return run


# ---- files ---------------------------------------------------------------------------------------------------

MANIFEST = "file string, n_docs long, n_tokens long, start long, offsets array<long>, sizes array<long>, bytes long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(base: str, lengths: bytes, part_starts: dict[int, int], wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(np.frombuffer(zlib.decompress(lengths), np.uint8))
        system, root = _filesystem(base)
        system.create_dir(root, recursive=True)
        out, state = None, None
        head = MAGIC + struct.pack("<I", len(lengths)) + lengths

        def close() -> pa.RecordBatch:
            index = json.dumps({"offsets": state["offsets"], "sizes": state["sizes"]}).encode()
            out.write(index + struct.pack("<I", len(index)) + MAGIC)
            out.close()
            row = {**state, "bytes": state["bytes"] + len(index) + 12}
            return pa.RecordBatch.from_pylist([{k: row[k] for k in ("file", "n_docs", "n_tokens", "start", "offsets", "sizes", "bytes")}])

        for batch in batches:
            for r in batch.to_pylist():
                if out is not None and state["key"] != (r["part"], r["seq"]):
                    yield close()
                    out = None
                start = part_starts[r["part"]] + r["start"]
                if out is None:
                    name = f"ids-{r['part']:06d}-{r['seq']:06d}-{uuid.uuid4().hex[:8]}.hid"
                    out = system.open_output_stream(f"{root}/{name}")
                    out.write(head)
                    state = {"file": f"{base}/{name}", "n_docs": 0, "n_tokens": 0, "start": start, "offsets": [], "sizes": [], "bytes": len(head)}
                ids = np.frombuffer(r["ids"], kind)
                bits, checks = pack_bits(ids, book)
                if len(bits) >= 1 << 29:
                    raise ValueError("a block's bits outgrow its 32-bit checkpoints")
                docs, sizes = np.array([-1 if d is None else d for d in r["doc_ids"]], "<i8"), np.array(r["n_tokens"], "<u4")
                nulls = np.packbits(np.array([d is None for d in r["doc_ids"]], bool)).tobytes()
                blob = struct.pack("<QQQQ", len(docs), len(ids), start, len(bits)) + docs.tobytes() + nulls + sizes.tobytes() + checks.astype("<u4").tobytes() + bits
                out.write(blob)
                state["offsets"].append(state["bytes"])
                state["sizes"].append(len(blob))
                state |= {"bytes": state["bytes"] + len(blob), "n_docs": state["n_docs"] + len(docs), "n_tokens": state["n_tokens"] + len(ids), "key": (r["part"], r["seq"] + 1)}
        if out is not None:
            yield close()

    return run


def read_block(source, offset: int, size: int, table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Document ids, which of them are null, sizes, first global position and ids of one block."""
    source.seek(offset)
    blob = source.read(size)
    n_docs, n, start, n_bits = struct.unpack_from("<QQQQ", blob)
    at = 32
    docs = np.frombuffer(blob, "<i8", n_docs, at)
    nulls = np.unpackbits(np.frombuffer(blob, np.uint8, (n_docs + 7) // 8, at + 8 * n_docs), count=n_docs).astype(bool)
    at += 8 * n_docs + (n_docs + 7) // 8
    sizes = np.frombuffer(blob, "<u4", n_docs, at)
    at += 4 * n_docs
    checks = np.frombuffer(blob, "<u4", -(-n // STEP), at)
    at += len(checks) * 4
    return docs, nulls, sizes, start, unpack_bits(blob[at : at + n_bits], checks, n, table, width)


def open_file(source) -> Book:
    """The codes of an open file."""
    head = source.read(12)
    if head[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    return Book(np.frombuffer(zlib.decompress(source.read(struct.unpack("<I", head[8:])[0])), np.uint8))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source, table, width = None, None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != at:
                    if source is not None:
                        source.close()
                    system, path = _filesystem(r["file"])
                    at, source = r["file"], system.open_input_file(path)
                    book = open_file(source)
                    table, width = book.table(), book.bits
                docs, nulls, sizes, start, ids = read_block(source, r["offset"], r["size"], table, width)
                ends = np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [pa.array(docs, mask=nulls), pa.array(start + begins), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        if source is not None:
            source.close()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch | None = None, limit: int = LIMIT) -> DataFrame:
    """Encodes all texts and writes the files; returns their manifest.

    Reads ``doc_id, text`` and ignores other columns. Documents are stored in ascending id, null ids first, rows of the
    same id by a hash of their text; a null or empty text is its end id alone. An empty table gives an empty manifest.
    The code book has at most one entry per id of the vocabulary, and what the driver holds beside it is one number a file.
    """
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) > 1 << 16
    scratch = scratch or Scratch(spark, "ids")
    texts = pick(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    staged = scratch.write(texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(_stage(tokenizer_path, end_id, wide), STAGED), "staged")
    counted = staged.where("hist_ids is not null").select("part", "start", F.explode(F.arrays_zip("hist_ids", "hist_counts")).alias("h"))
    hist = counted.groupBy(F.col("h.hist_ids").alias("id")).agg(F.sum("h.hist_counts").alias("n")).collect()
    counts = np.zeros(max([r.id for r in hist], default=0) + 1, np.int64)
    for r in hist:
        counts[r.id] = r.n
    part_starts, total = {}, 0
    for r in sorted(staged.where("hist_ids is not null").select("part", "start").collect()):
        part_starts[r.part], total = total, total + r.start
    lengths = zlib.compress(code_lengths(counts, limit).tobytes(), 9)
    blocks = staged.where("ids is not null").select("part", "seq", "start", "doc_ids", "n_tokens", "ids")
    manifest = scratch.write(blocks.mapInArrow(_writer(scratch.path("files"), lengths, part_starts, wide), MANIFEST), "manifest")
    scratch.drop("staged")
    return manifest


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    blocks = manifest.select("file", F.explode(F.arrays_zip("offsets", "sizes")).alias("b")).select("file", F.col("b.offsets").alias("offset"), F.col("b.sizes").alias("size"))
    return blocks.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_reader(with_ids), READ + (", ids array<long>" if with_ids else ""))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2))
