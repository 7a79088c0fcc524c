"""Each stage against a plain version of it, on rows of every kind."""

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from moments.llm import neardup, quality
from moments.llm.util import Scratch
from tests.llm import common
from tests.llm.test_decontam import brute as brute_windows
from tests.llm.test_secrets import TEXTS, base

D = "/root/testdata/sf0.001"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_name_five_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "secret scans", "BPE encoding"]


def test_quality_stage_keeps_what_the_scores_say(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality.score(spark, docs, quality.fit(spark, docs, labels)).collect()}
    want = Counter({tuple(r): 1 for r in docs.collect() if scores[r.doc_id].p_quality >= 0.5 and scores[r.doc_id].p_toxic <= 0.5})
    got = corpus_pipeline.quality_stage(spark, docs, D)
    assert got.columns == docs.columns and bag(got) == want and 0 < len(want) < docs.count()
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), D).count() == 0


def test_neardup_stage_keeps_one_row_of_each_component(spark):
    words = [f"w{k}" for k in range(60)]
    near = words[:-1] + ["other"]
    a, b, c, d = " ".join(words), " ".join(near), "alone in the world with these words", "another text that has nothing in common"
    rows = [
        (1, a, "x"), (2, b, "x"), (2, c, "x"),  # id 2 has a duplicate row and one of its own
        (None, d, "x"), (None, "words of a second null id that stay", "x"), (None, a, "x"), (None, None, "e"), (None, "", "e"), (None, " ", "e"),
        (7, "", "e"), (7, "a full text under the id of an empty one", "x"), (7, "and one more text under the same id", "x"),
        (8, "the same id and the same text twice", "x"), (8, "the same id and the same text twice", "x"), (9, None, "e"), (9, None, "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.neardup_stage(spark, docs, "").collect())
    want = Counter(rows)
    for gone in ((2, b, "x"), (None, a, "x"), (8, rows[12][1], "x")):
        want[gone] -= 1
    assert got == +want
    assert corpus_pipeline.neardup_stage(spark, docs.limit(0), "").count() == 0


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_neardup_stage_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, head = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    parts = {}
    for k, r in enumerate(rows):
        parts.setdefault(find(k) if sets[k] else (k,), []).append((r.doc_id, k))
    want = sorted(min(p)[0] for p in parts.values())
    assert sorted(r.doc_id for r in corpus_pipeline.neardup_stage(spark, docs, D).collect()) == want


def test_neardup_stage_with_sets_in_blocks_equals_all_pairs(spark, monkeypatch):
    """Variants of one text, all near the threshold to each other: sets go out in blocks, each pair once, and the rows that stay are those of brute force."""
    monkeypatch.setattr(neardup, "SET_BYTES", 20_000)
    made, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *p: made.setdefault(name, write(self, df, name, *p)))
    r = random.Random(4)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(60):
        t = list(base)
        for _ in range(r.randint(2, 9)):
            t[r.randrange(200)] = f"x{k}y{r.randrange(1000)}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, head = [shingles(t) for _, t in rows], list(range(60))
    for _ in range(60):  # the least id reached
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    head[i] = min(head[i], head[j])
    assert {x.doc_id for x in corpus_pipeline.neardup_stage(spark, docs, "").collect()} == {k for k in range(60) if head[k] == k}
    crossed = [tuple(sorted([tuple(x.a), tuple(x.b)])) for x in made["crossed"].collect()]
    assert len(crossed) == len(set(crossed))


def test_decontamination_stage_drops_what_windows_cover(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").unionByName(common.documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    rows = docs.collect()
    bad = {(r.doc_id, r.text) for r, w in ((r, brute_windows([(r.doc_id, r.text)], items)[0]) for r in rows) if w[5]}
    want = Counter(tuple(r) for r in rows if (r.doc_id, r.text) not in bad)
    got = corpus_pipeline.decontamination_stage(spark, docs, D)
    assert bad and got.columns == docs.columns and bag(got) == want


def test_decontamination_stage_drops_passages_in_long_texts(spark, tmp_path):
    """A passage of 13 words goes at any length of text; the words of a shorter item only where they are a twentieth."""
    item, answer = [f"q{k}" for k in range(18)], "one short answer"
    spark.createDataFrame([(0, " ".join(item)), (1, answer), (None, " ".join(f"n{k}" for k in range(13)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    filler = [f"w{k}" for k in range(600)]

    def inside(words):
        return " ".join(filler[:300] + words + filler[300:])

    gone = [
        (1, inside(item), "x"), (1, inside(item), "x"), (None, inside(item[2:15]), "x"), (2, inside([f"N{k}," for k in range(13)]), "x"),
        (3, " ".join([answer, *filler[:57]]), "x"), (4, inside([*answer.split(), *item]), "x"),
    ]
    kept = [
        (1, inside(item[:12]), "x"), (5, inside(answer.split()), "x"), (6, " ".join([answer, *filler[:58]]), "x"), (None, inside([]), "x"), (None, None, "e"), (7, "", "e"),
        (8, inside([*item[:6], "between", *item[6:]]), "x"),
    ]
    docs = spark.createDataFrame(gone + kept, "doc_id long, text string, source string")
    assert bag(corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))) == Counter(kept)
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_secrets_stage_leaves_no_base_secret(spark):
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(r[0], r[1], "c") for r in common.rows()] + [(None, "token=abcdefgh", "n"), (1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.secrets_stage(spark, docs, D).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    clean = Counter((i, t) for i, t, _ in rows if not base(t))
    after = Counter((r.doc_id, r.text) for r in got)
    assert all(not base((r.text or "").replace("[secret]", " ")) for r in got)
    assert sum((clean - after).values()) <= 3  # texts with linked weak parts alone


def test_bpe_stage_equals_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r.doc_id, r.n_tokens, r.ids) for r in corpus_pipeline.bpe_stage(spark, common.documents(spark), D).collect())
    want = Counter()
    for row in common.rows():
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids
        want[(row[0], len(ids), " ".join(map(str, ids)))] += 1
    assert got == want


def test_run_cleans_up(spark):
    from moments.llm import util

    before = set(util.MADE)
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
    assert len([b for b in util.MADE if b not in before]) == 1
