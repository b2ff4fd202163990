"""Whole queries against plain versions: loops over Python values, from the definitions alone."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from helpers import brute_components, odd_documents, words
from pyspark.sql import functions as F

from rarebucket.llm import langid, mixing, nbsvm, packing, queries, url_filter


def fold(key, folds):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


# --- quality classifier ---------------------------------------------------------------------------------------------


def plain_indicators(text):
    """(n-gram of shapes, level) pairs of a text."""
    shapes, before = [], None
    for word in filter(None, "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ")):
        signs = ""
        for c in word:
            sign = "A" if "A" <= c <= "Z" or "À" <= c <= "Þ" else "a" if c >= "\x80" or "a" <= c <= "z" else "0" if "0" <= c <= "9" else c
            signs += sign if not signs.endswith(sign) else ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
        shapes.append((signs, low == before))
        before = low
    grams = Counter([(s,) for s in shapes] + list(zip(shapes, shapes[1:], strict=False)))
    return {(g, k) for g, n in grams.items() for k, level in enumerate(nbsvm.LEVELS) if n / len(shapes) >= level}


def test_indicators_of_whole_texts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + [None, "", " ", "É éß Ab12 ab12 AB12 x!! x!! ...", "a a A a"]
    got = [set(r.tolist()) for r in nbsvm.indicators(pa.array(texts), bits=31)]
    want = [plain_indicators(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    sample = range(0, len(texts), 7)
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in sample for j in sample)


def test_ratios_and_dual_solution():
    random = np.random.default_rng(3)
    rows = [np.unique(random.choice(40, 9) + 40 * int(y) * (random.random(9) < 0.4)).astype(np.int32) for y in random.integers(0, 2, 60)]
    labels = random.integers(0, 2, 60)
    counts = {c: Counter(i for r, y in zip(rows, labels, strict=True) if y == c for i in r.tolist()) for c in (0, 1)}
    size = {c: sum(counts[c].values()) + 128 for c in (0, 1)}
    ratio = {i: math.log((1 + counts[1][i]) / size[1]) - math.log((1 + counts[0][i]) / size[0]) for i in range(128) if counts[0][i] + counts[1][i]}
    scale = np.array([ratio.get(i, 0.0) for i in range(128)])
    y = [1.0 if v else -1.0 for v in labels]
    # plain dual coordinate descent, in the order that the module draws
    w, bias, dual = dict.fromkeys(range(128), 0.0), 0.0, [0.0] * len(rows)
    draw = np.random.default_rng(7)
    for _ in range(10):
        for i in draw.permutation(len(rows)).tolist():
            own = rows[i].tolist()
            margin = sum(w[j] * ratio[j] for j in own) + bias
            step = min(max(dual[i] - (y[i] * margin - 1) / (sum(ratio[j] ** 2 for j in own) + 1), 0.0), 1.0) - dual[i]
            dual[i] += step
            for j in own:
                w[j] += step * y[i] * ratio[j]
            bias += step * y[i]
    level = sum(abs(w[j]) for j in ratio) / len(ratio)
    want = [(0.75 * level + 0.25 * w[j]) * ratio.get(j, 0.0) for j in range(128)]
    got, got_bias = nbsvm.descend(rows, np.array(y), scale)
    assert np.allclose(got, want) and np.isclose(got_bias, 0.25 * bias)
    # the whole fit: the same weights up to the logistic scale, and a calibrated curve
    weights, offset = nbsvm.fit(rows, labels, bits=7)
    kept = np.flatnonzero(np.abs(got) > 1e-9)
    factor = weights[kept] / got[kept]
    assert np.allclose(factor, factor[0]) and factor[0] > 0
    p = 1 / (1 + np.exp(-np.array([weights[r].sum() + offset for r in rows])))
    assert abs(p.sum() - sum((sum(labels) + 1) / (sum(labels) + 2) if v else 1 / (len(rows) - sum(labels) + 2) for v in labels)) < 1e-3


def plain_quality(docs, labels):
    """{index: score} of (doc_id, text) rows, from the model of all labelled rows outside of the held-out fold."""
    known = {}
    for doc_id, quality in labels:
        if doc_id is not None and quality is not None and fold(doc_id, 5):
            known[doc_id] = min(quality, known.get(doc_id, 1))
    found = [r.tolist() for r in nbsvm.indicators(pa.array([t for _, t in docs], pa.string()))]
    rows = {}
    for (doc_id, _), own in zip(docs, found, strict=True):
        if doc_id in known:
            rows[doc_id] = min(own, rows.get(doc_id, own))
    weights, offset = nbsvm.fit([np.array(rows[k], np.int32) for k in sorted(rows)], np.array([known[k] for k in sorted(rows)]))
    return [1 / (1 + math.exp(-max(-500, min(500, sum(weights[i] for i in own) + offset)))) for own in found]


def test_quality_scores(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_quality(docs, [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()])
    got = {r.doc_id: r for r in queries.QUERIES["op8_nbsvm"](spark, sf).collect()}
    for (doc_id, _), score in zip(docs, want, strict=True):
        assert math.isclose(got[doc_id].score, score, rel_tol=1e-9) and got[doc_id].predicted == int(score >= 0.3) and got[doc_id].held_out == (fold(doc_id, 5) == 0)


# --- language -------------------------------------------------------------------------------------------------------


def plain_vector(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = f" {' '.join(letters.split())} "
    vec = lambda c: langid.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(np.int64)
    grams = Counter(zip(s, s[1:], s[2:], strict=False)) if s.strip() else {}
    return sum((n * np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for (a, b, c), n in grams.items()), np.zeros(langid.DIMENSIONS, np.int64)).astype(float)


def plain_languages(docs):
    """(language, cosine) of (doc_id, text, lang) rows."""
    vectors = [plain_vector(t) for _, t, _ in docs]
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for (doc_id, _, lang), v in zip(docs, vectors, strict=True):
        if lang is not None and fold(doc_id, 3) != 1:
            sums[lang] += np.rint(v * langid.UNIT / max(1.0, np.linalg.norm(v)))
    out = []
    for v in vectors:
        cosine = {k: float(p @ v) / (np.linalg.norm(p) * np.linalg.norm(v)) if v.any() and p.any() else 0.0 for k, p in sums.items()}
        best = min(cosine, key=lambda k: (-cosine[k], k)) if cosine and v.any() else None
        out.append(("und", 0.0) if best is None else (best, min(1.0, max(0.0, cosine[best]))))
    return out


def short(rows):
    """Rows whose texts a plain loop can take."""
    return [r for r in rows if len(r[1] or "") < 30_000]


def test_languages(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) < 4000")
    rows = [tuple(r) for r in table.collect()] + [(-1, None, "en"), (-2, "12 !", "de"), (-3, "Αβ γ", None), (None, "no id", "en")]
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect())
    assert got == Counter((i, lang, round(score, 4)) for (i, _, _), (lang, score) in zip(rows, plain_languages(rows), strict=True))


# --- URLs -----------------------------------------------------------------------------------------------------------


def signs_of(url):
    table = url_filter.sign_table()
    return [0, 0, 0, *table[np.frombuffer((url or "").encode(), np.uint8)].tolist(), 0]


def plain_model(urls):
    """Chance of a sign after the three before it: counts of all orders, blended."""
    follow = defaultdict(Counter)
    for url in urls:
        s = signs_of(url)
        for i in range(3, len(s)):
            for k in range(4):
                follow[tuple(s[i - k : i])][s[i]] += 1

    def chance(context, c):
        p = 1 / url_filter.SIGNS
        for k in range(4):
            seen = follow.get(tuple(context[3 - k :]))
            if seen:
                p = (seen[c] + len(seen) * p) / (seen.total() + len(seen))
        return p

    return chance


def plain_scores(urls, accepted, rejected):
    good, bad = plain_model(accepted), plain_model(rejected)
    out = []
    for url in urls:
        s = signs_of(url)
        out.append(sum(math.log(good(s[i - 3 : i], s[i]) / bad(s[i - 3 : i], s[i])) for i in range(3, len(s))) / (len(s) - 3) if url else 0.0)
    return out


def test_url_scores_threshold_and_verdicts(spark):
    random = np.random.default_rng(11)
    pick = lambda *x: str(random.choice(x))
    urls = [f"http://{pick('a', 'news', 'blog')}{random.integers(50)}.{pick('org/fr/', 'org/de/', 'net/', 'com/', 'example.net/en/')}{pick('article', 'win', 'cheap-pills', 'story')}{random.integers(999)}" for _ in range(400)] + [None, "", "no scheme", "HTTPS://X.ORG/fr/" + "y" * 5000]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("lm", F.lit(1))).collect()}
    rule = {h + p: v for h, p, v in url_filter.RULES}
    labelled = [(i, rule[got[i].rule] == "allow") for i in range(len(urls)) if got[i].rule]
    of = lambda keep: [[urls[i] for i, good in labelled if good == side and keep(i)] for side in (True, False)]
    held = [(i, good) for i, good in labelled if fold(i, 5) == 0]
    scores = plain_scores([urls[i] for i, _ in held], *of(lambda i: fold(i, 5) != 0))
    step = 2 * url_filter.RANGE / (url_filter.BINS - 1)
    edges = [(k + 1) * step - url_filter.RANGE for k in range(url_filter.BINS)]
    accuracy = [sum((s >= e - 1e-9) == good for s, (_, good) in zip(scores, held, strict=True) if good) / sum(g for _, g in held) + sum((s >= e - 1e-9) == good for s, (_, good) in zip(scores, held, strict=True) if not good) / sum(not g for _, g in held) for e in edges]
    best = [e for e, a in zip(edges, accuracy, strict=True) if a >= max(accuracy) - 1e-12]
    cut = best[(len(best) - 1) // 2]
    final = plain_scores(urls, *of(lambda i: True))
    assert len(held) > 20 and 0 < sum(g for _, g in held) < len(held)
    for i, score in enumerate(final):
        assert math.isclose(got[i].lm_score, score, abs_tol=1e-4)
        if got[i].rule is None and abs(score - cut) > 0.01:
            assert got[i].verdict == ("allow" if score >= cut else "block")
    assert len({r.verdict for r in got.values() if r.rule is None}) == 2


# --- pipeline -------------------------------------------------------------------------------------------------------


def plain_pipeline(docs, labels):
    """Pieces (doc_id, piece, start, length, crc) of (doc_id, text, lang, source) rows after all five stages."""
    kept = []
    for row, (lang, cosine) in zip(docs, plain_languages([r[:3] for r in docs]), strict=True):
        if lang != "und" and cosine >= (langid.LEAST if len(row[1]) < langid.LONG else langid.LEAST_LONG):
            kept.append(row)
    scores = plain_quality([r[:2] for r in kept], labels)
    kept = [r for r, s in zip(kept, scores, strict=True) if s >= 0.3]
    groups = defaultdict(list)
    for i, (n, c) in brute_components([r[1] for r in kept]).items():
        groups[c if n else -1 - i].append(i)
    kept = [kept[min(g, key=lambda i: (kept[i][0] is None, kept[i][0] or 0))] for g in groups.values()]
    # each source's words once or twice in its shuffled order, up to its target
    sources = defaultdict(list)
    for r in kept:
        sources[r[3]].append((hashlib.md5(f"{'' if r[0] is None else r[0]}\n{r[1]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    size = {s: sum(len(words(r[3])) for r in rows) for s, rows in sources.items()}
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
    mixed = []
    for s, rows in sources.items():
        rows.sort()
        starts = [0, *accumulate(len(words(r[3])) for r in rows)]
        for copy in range(2):
            for (_, known, doc_id, text), at in zip(rows, starts, strict=False):
                n = min(len(words(text)), math.floor(target[s]) - copy * size[s] - at)
                if n > 0:
                    mixed.append((doc_id if known else None, text if n == len(words(text)) else first_words(text, n)))
    encoder, out = packing.load_encoder(added=True), Counter()
    for doc_id, text in mixed:
        ids = np.array([*encoder.encode(text, allowed_special="all"), 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(min(first, len(ids)), len(ids), 1024), len(ids)]
        out.update((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    return out


def first_words(text, n):
    at = seen = 0
    space = "\t\n\x0b\x0c\r "
    while at < len(text) and (text[at] in space or seen < n or text[at - 1] not in space):
        seen += text[at] not in space and (at == 0 or text[at - 1] in space)
        at += 1
    return text[:at]


@pytest.mark.parametrize("odd", [False, True])
def test_whole_pipeline(spark, sf, tmp_path, odd):
    """All stages on a small table, and on one with nulls, ties, repeated rows and columns whose names clash."""
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000"), spark.read.parquet(f"{sf}/labels.parquet")
    if odd:
        more = odd_documents(spark).filter("text IS NULL OR length(text) < 6000")
        docs = docs.limit(120).unionByName(more.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True).unionByName(docs.limit(3), allowMissingColumns=True)
        labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (10**6 + 1, None, 0), (10**6 + 2, 1, 0)], labels.select("doc_id", "quality", "toxic").schema), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = plain_pipeline(rows, [tuple(r) for r in spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", "quality").collect()])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert want and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for one in places.values():
        assert [0, *accumulate(n for _, n in sorted(one))][:-1] == [o for o, _ in sorted(one)] and sum(n for _, n in one) <= 1024


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    odd_documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_mixing_by_hand():
    assert first_words(" a  b c", 2) == " a  b " and first_words("a b", 1) == "a "
    assert mixing.CURVES[2][1] == (0.7, 1.0)
