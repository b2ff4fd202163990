"""Small tables with every odd case, and plain versions of what the operators compute."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, size string, score string, node string, position string"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def odd_texts():
    """(doc_id, text, lang, source): nulls, empty and long texts, near copies, ties and repeated rows."""
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["other"] + base[31:]
    half = base[:30] + [f"v{i}" for i in range(30)]
    rows = [
        (1, " ".join(base), "en", "b"), (2, " ".join(near), "en", "a"), (3, " ".join(half), "de", "a"), (4, "\t\n" + " \x0b".join(base).upper() + "\r ", None, None), (5, None, "en", "a"), (6, "", None, "a"),
        (7, " \n\t ", "de", None), (8, "one two", "en", "c"), (9, "One  TWO", "en", "c"), (10, "two one", "en", "c"), (11, "Éa é\u00a0x \U0001f600 ünï", "fr", "é"), (12, " ".join(f"long{i % 9973}" for i in range(60000)), "en", "b"),
        (13, "<|endoftext|> [INST] \\ </s>", "en", "b"), (14, "x" * 5000, "de", "b"), (None, "no id but words here now ok", "en", "b"),
    ]
    rows += [(15, "again and again and again and again", "en", "b")] * 3  # repeated rows
    return rows + [(100 + i, " ".join(base + [f"tail{i}"]), "en", "hot") for i in range(40)]  # a group of near copies


def odd_documents(spark, partitions=3):
    rows = [(*r, len(r[1] or ""), "p", "s", "c", "n", "q") for r in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(texts, size=5, need=80):
    """{index: (set size, component index)} by comparing all pairs that share a shingle."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < i:
                    met[j] += 1
        for j, n in met.items():
            if 100 * n >= need * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def bag(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect() if columns else df.collect())))


def texts_of(df):
    return df.select("doc_id", F.col("text"))
