import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moments.llm import suffixes
from tests.llm import common


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(letters):
    s = np.array([*letters, 0], np.int16)
    text = s.tolist()
    sa = suffixes.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: text[i:])
    before, lcp = suffixes.permuted_prefixes(s, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        n = 0
        while text[a + n : a + n + 1] == text[b + n : b + n + 1]:
            n += 1
        assert before[b] == a and lcp[b] == n


def brute(rows, length):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), len(b) - len(rest), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, gram, shard", [(400, 64, 6_000_000), (40, 8, 6_000_000), (40, 8, 600)])
def test_equals_brute_force(spark, length, gram, shard):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (5, 12, 90, 150, 300)]
    extra, n = [], 1000
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 5))]
        extra.append((n, " ".join(parts)))
        n += 1
    extra += [(n + k, t) for k, (_, t) in enumerate(extra[:5])] + [(n + 10, "z" * 900), (n + 11, "ab" * 500), (n + 12, "q" * 399), (n + 13, "q" * 399)]
    docs = common.documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(tuple(x) for x in suffixes.remove_repeats(spark, docs, length, gram, shard).collect())
    assert got == brute([x[:2] for x in common.rows()] + extra, length)


def test_long_texts_in_stretches(monkeypatch):
    """A text beyond a piece gives the same windows and anchors, stretch by stretch."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1]), pa.array([2])], ["text", "dk", "dh"])

    def windows():
        out = {}
        for b in suffixes._placer(400, 64)(iter([batch])):
            for r in b.to_pylist():
                out |= {r["lo"] + k: r["key"] for k in range(r["size"])}
        return out

    whole = windows()
    assert sorted(whole) == list(range(5000 - 399))
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 700)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 600)
    assert windows() == whole


def test_empty(spark):
    assert suffixes.remove_repeats(spark, common.empty(spark)).count() == 0
