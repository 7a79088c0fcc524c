import hashlib
import re
from collections import Counter, defaultdict

from moments.llm import decontam
from tests.llm import common

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if g := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= g - {None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def brute_near(docs, items):
    """Items per text of which the two rarest terms of a window stand at most 13 words apart."""
    texts = [words(t) for _, t in docs]
    used = Counter(w for t in texts for w in t)
    pairs = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w and item is not None else 0):
            rare = sorted(set(w[k : k + 13]), key=lambda x: (used[x], x))[:2]
            if len(rare) == 2 and used[rare[0]]:
                pairs[tuple(sorted(rare))].add(item)
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        at = defaultdict(list)
        for p, x in enumerate(t):
            at[x].append(p)
        found = {i for (a, b), own in pairs.items() if any(abs(p - q) <= 13 for p in at.get(a, ()) for q in at.get(b, ())) for i in own}
        out.append((doc_id, len(found)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{k}" for k in range(20))
ITEMS = [(1, LONG), (2, "Short One"), (3, None), (4, ""), (5, "the"), (10, LONG + " tail"), (11, "the the the the the the the the the the the the the the"), (12, "école Été naïve"), (None, "end")]


def test_equals_brute_force(spark):
    extra = [(900, LONG.upper()), (901, "x " + LONG[:-4] + " y"), (902, "short one short ONE"), (903, "the " * 40), (904, LONG * 3), (905, "École été naïve école Été naïve"), (None, LONG), (906, " ".join(f"w{k}" for k in range(12))), (907, "w9 one word put in w8 w7"), (908, "w0 " + "x " * 20 + "w1")]
    docs = common.documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.contamination(spark, docs, items).collect()
    plain = [r[:2] for r in common.rows()] + extra
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == brute(plain, ITEMS)
    assert sorted(((r.doc_id, r.n_near) for r in rows), key=repr) == brute_near(plain, ITEMS)


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(spark, common.empty(spark), items).count() == 0
    got = decontam.contamination(spark, common.documents(spark), items.limit(0)).collect()
    assert len(got) == len(common.rows()) and not any(r.contaminated or r.n_hit for r in got)


def test_proximity(spark):
    index = spark.createDataFrame([("a", 1, 0, 5), ("b", 1, 0, 9), ("a", 2, 0, 0), ("b", 2, 0, 50), ("b", 3, 0, 7), ("a", 3, 0, 8), ("a", 4, 0, 1)], "term string, dk long, dh long, pos int")
    keys = spark.createDataFrame([(7, "a"), (7, "b")], "test long, term string")
    assert sorted((r.dk, r.gap) for r in decontam.proximity_matches(index, keys, 6).collect()) == [(1, 4), (3, 1)]
