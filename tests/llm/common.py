"""Rows that every operator on documents has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, shard int, block long, code int, word string, n int"


def rows():
    r = random.Random(7)
    words = ["the", "of", "thon's", "ÉCOLE", "naïve", "日本語", "x1y2", "don't", "AKIA", "ß", "end.", "I'LL"]
    texts = [
        None, "", " ", "\n", "a", "  two  spaces  ", "tab\tand\r\nline\n\nbreaks ", "\x1cfs\x1d gs\x85nel\xa0nbsp　wide", "<|endoftext|> <|startoftext|>x",
        "é combining ́ alone", "\U0001f600 emoji\U0001f600\U0001f600", "İSTANBUL ΣΑΣ", "x" * 5000, " ".join(r.choice(words) for _ in range(20_000)),
        "same text twice", "same text twice", "don't can't we'll",
    ]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(30)]
    out = [(k, t, "en", f"src{k % 3}", len(t or ""), 1, 2, 3, 4, "w", 5) for k, t in enumerate(texts)]
    out += [(3, "tie of an id", None, None, None, None, None, None, None, None, None), (3, "tie of an id", None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
