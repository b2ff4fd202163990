"""Operators on documents against brute force, on odd cases and on the small test tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import bag, brute_components, no_documents, odd_documents, odd_texts, words
from pyspark.sql import functions as F
from tables import duck, same_rows

from rarebucket.llm import common, jaccard_join, langid, lm_score, media, mixing, nbsvm, packing, queries

# --- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    """Excess over a cap is dealt anew until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = total * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return share | full
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_mixing(spark):
    got = mixing.mixed_words(odd_documents(spark)).collect()
    assert len(got) == len(odd_texts())
    sizes = defaultdict(int)
    for _, text, _, source in odd_texts():
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert bag(mixing.mixed_words(odd_documents(spark, 7)), "doc_id", "size", "taken", "position") == sorted(repr((r.doc_id, r["size"], r.taken, r.position)) for r in got)


def test_demand_is_inverted(spark):
    for knots in (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 0.0), (1.0, 0.0)), *mixing.CURVES):
        times = np.linspace(0, 1, 20001)
        area = np.concatenate([[0], np.cumsum(np.diff(times) * (np.interp(times[1:], *zip(*knots, strict=True)) + np.interp(times[:-1], *zip(*knots, strict=True))) / 2)])
        rows = spark.range(100).select((F.col("id") / 100).alias("u")).select("u", mixing.inverse_demand(F.col("u"), knots).alias("t")).collect()
        assert all(abs(np.interp(r.t, times, area / area[-1]) - r.u) < 1e-6 for r in rows)


def test_mixed_documents(spark):
    docs = odd_documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    plan = mixing.mixed_words(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    got = Counter()
    for r in rows:
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({r.source: r.taken for r in plan if r.taken})
    whole = {t for _, t, _, _ in odd_texts()}
    assert sum(r.text not in whole for r in rows) <= len(plan)  # only the last of a source is cut
    assert Counter(r.doc_id for r in rows)[15] == 6 or Counter(r.doc_id for r in rows)[15] == 3 * 2


def test_mixing_sql(spark, sf):
    same_rows(queries.QUERIES["op1_mixing"](spark, sf).toPandas(), duck(sf).sql(queries.SQL["op1_mixing"]).df())


# --- n-gram Jaccard join --------------------------------------------------------------------------------------------


def test_near_copies(spark):
    want = brute_components([t for _, t, _, _ in odd_texts()])
    ids = [r[0] for r in odd_texts()]
    smallest = {}
    for i, (_, c) in want.items():
        known = [x for x in (smallest.get(c), ids[i]) if x is not None]
        smallest[c] = min(known) if known else None
    found = jaccard_join.near_copies(odd_documents(spark))
    assert bag(found, "doc_id", "n_shingles", "component_id") == sorted(repr((ids[i], n, smallest[c])) for i, (n, c) in want.items())
    kept = jaccard_join.without_near_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert kept.count() == len({c for _, c in want.values()})


def test_near_copies_small_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute_components([r.text for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_jaccard_join"](spark, sf).collect()}
    assert got == {rows[i].doc_id: (n, rows[c].doc_id) for i, (n, c) in want.items()}


def test_common_shingles_only_reorder(spark, monkeypatch):
    """Borderline copies around one source, so that components join late."""
    random = np.random.default_rng(4)
    source = [f"s{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(source)
        for p in random.choice(120, random.integers(0, 6), replace=False):
            t[p] = f"x{random.integers(1 << 30)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts)
    assert len({c for _, c in want.values()}) > 1
    for least in (3, 10**9):
        monkeypatch.setattr(jaccard_join, "common_shingles", lambda d, s, least=least, f=jaccard_join.common_shingles: f(d, s, least))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(docs).collect()} == want
        monkeypatch.undo()


# --- language -------------------------------------------------------------------------------------------------------


def test_hyperdimensional_bundles():
    texts = ["ab Ba!", "", "12", "é", "a-b c", None]
    got = langid.text_vectors([t or "" for t in texts], langid.letters(), 256)
    vec = lambda c: langid.letter_vectors(np.array([0 if c == " " else ord(c)]), 256)[0].astype(int)
    for t, v in zip(texts, got, strict=True):
        letters = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = f" {' '.join(letters.split())} "
        want = sum((np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(s, s[1:], s[2:], strict=False)), np.zeros(256, int)) if s.strip() else np.zeros(256)
        assert np.array_equal(v, want), t
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))  # too many letters for the table
    alone = langid.text_vectors([many], langid.letters(), 128)[0]
    assert np.array_equal(langid.text_vectors(["abc", many], langid.letters(), 128)[1], alone)


def test_language(spark, sf):
    docs = odd_documents(spark)
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (5, 6, 7))
    assert all(0 <= r.score <= 1 for r in rows.values()) and langid.identify(docs).count() == docs.count()
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in rows.values())
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and not {5, 6, 7} & {r.doc_id for r in kept.collect()}
    found = queries.QUERIES["op9_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        langid.identify(rows)


def test_long_texts_in_one_batch(spark):
    """Many long texts come in batches bounded by bytes, without any session option, and are worked on whole."""
    texts = [f"{i} " + f"word{i} other " * 150_000 for i in range(24)]  # 2 MB each
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: r for r in media.inspected(media.media_column(docs)).collect()}
    assert all(got[i].payload_sha256 == hashlib.sha256(media.padded(t.encode())).hexdigest() for i, t in enumerate(texts))
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"en"}
    assert {r.n_words for r in lm_score.scores(docs).collect()} == {300_001}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_numbered(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 20)], "k string, many long")
    got = sorted(map(tuple, common.numbered(rows, "many", "nth", block=4).select("k", "nth").collect()))
    assert got == [(k, i) for k, n in (("a", 1), ("b", 7), ("c", 8), ("d", 20)) for i in range(n)]


def test_equal_rows_spread(spark):
    """Rows without an id and repeated rows are dealt apart, each with its own place, the same on reruns."""
    rows = [(None, f"no id {i} here") for i in range(300)] + [(7, "the same row again")] * 300
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    packed = packing.pack_documents(docs, group_docs=50).collect()
    assert Counter(r.doc_id for r in packed) == {None: 300, 7: 300}
    groups = Counter((r.doc_id, r.sequence_id >> 32) for r in packed)
    assert all(sum(1 for d, _ in groups if d == key) > 6 and max(n for (d, _), n in groups.items() if d == key) < 100 for key in (None, 7))
    assert bag(packing.pack_documents(docs.repartition(3), group_docs=50)) == sorted(map(repr, map(tuple, packed)))
    mix = mixing.mixed_words(docs).collect()
    assert len(mix) == 600 and sum(r.taken for r in mix) == math.floor(mix[0].target)
    places = sorted((r.offset, r["size"]) for r in mix)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    out = Counter(tuple(r) for r in mixing.mixed_documents(docs).select("doc_id", "text").collect())
    assert sum(len(words(t)) * n for (_, t), n in out.items()) == sum(r.taken for r in mix)


def test_unknown_languages_go(spark, sf):
    """Unlearned scripts and letter noise of any length go; learned texts and short clean ones stay."""
    random = np.random.default_rng(3)
    alphabets = ["".join(map(chr, range(a, b))) for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0x627, 0x64B), (0x4E00, 0x6E00))] + ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"]
    noise = [" ".join("".join(random.choice([*a], random.integers(2, 10))) for _ in range(n)) for a in alphabets for n, k in ((3, 40), (60, 40), (1000, 5)) for _ in range(k)]
    short = ["the", "of the", "and the water", "he was there", "der", "le"]
    learned = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    added = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(noise + short)], learned.schema)
    kept = {r.doc_id for r in langid.with_language(learned.union(added)).select("doc_id").collect()}
    assert sum(-1 - i in kept for i in range(len(noise))) <= 0.02 * len(noise)
    assert all(-1 - len(noise) - i in kept for i in range(len(short)))
    assert sum(k >= 0 for k in kept) >= 0.98 * learned.count()


# --- quality --------------------------------------------------------------------------------------------------------


def test_shapes():
    import pyarrow as pa

    shape, row = nbsvm.shapes(pa.array(["Word other WORK wOrD 12 x1 a!! b?! the the", None, "É é", "Abc"]))
    assert row.tolist() == [0] * 10 + [2, 2, 3]
    assert len({*shape[:8].tolist()}) == 8 and shape[0] == shape[12] and shape[1] == shape[8] and shape[9] != shape[8] and shape[10] != shape[11]


def test_dual_descent_separates():
    random = np.random.default_rng(0)
    rows = [np.unique(random.choice(50, 12) + (50 if y else 0) * (random.random(12) < 0.5)).astype(np.int32) for y in (0, 1) * 100]
    labels = np.array([0, 1] * 100)
    w, b = nbsvm.fit(rows, labels, bits=8)
    right = [(w[r].sum() + b > 0) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.97
    assert nbsvm.fit(rows[::2], labels[::2])[1] < 0 < nbsvm.fit(rows[1::2], labels[1::2])[1] and nbsvm.fit([], labels[:0])[1] == 0


def test_quality(spark, sf):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (None, 1, 0), (15, 0, 0), (12, 1, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    rows = nbsvm.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    assert {r.score for r in nbsvm.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.of_quality(docs, labels).columns == docs.columns
    found = queries.QUERIES["op8_nbsvm"](spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95


# --- language model -------------------------------------------------------------------------------------------------


def plain_scores(texts):
    rows = [words(t) for t in texts]
    count = [Counter(tuple(w[i : i + n]) for w in rows for i in range(len(w) - n + 1)) for n in range(4)]
    total, out = sum(map(len, rows)), []
    for w in rows:
        score = 0.0
        for i in range(len(w)):
            back = 0
            for n in range(min(3, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or count[n][gram] >= 2:
                    score += np.log(count[n][gram] / (total if n == 1 else count[n - 1][gram[:-1]])) + back * np.log(0.4)
                    break
                back += 1
        out.append((len(w), score))
    return out


def test_stupid_backoff(spark):
    want = sorted((r[0] is None, r[0] or 0, n, s) for r, (n, s) in zip(odd_texts(), plain_scores([r[1] for r in odd_texts()]), strict=True))
    for chunk, part in ((4 << 20, 10**6), (3000, 500)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_score) for r in lm_score.scores(odd_documents(spark), chunk_bytes=chunk, part_grams=part).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9)


def test_count_table(spark):
    """Counts per order against a plain count, whatever the chunks and partitions."""
    rows = [words(r[1]) for r in odd_texts()]
    for n in (1, 2, 3):
        want = sorted(Counter(tuple(w[i : i + n]) for w in rows for i in range(len(w) - n + 1)).values())
        for chunk, part in ((16 << 20, 10**6), (3000, 500)):
            got = lm_score.count_table(odd_documents(spark), chunk_bytes=chunk, part_grams=part).filter(F.col("n") == n)
            assert sorted(r["count"] for r in got.collect()) == want
    assert lm_score.count_table(odd_documents(spark), least=3).agg(F.min("count")).first()[0] == 3


def test_stupid_backoff_sql(spark, sf):
    same_rows(queries.QUERIES["op3_stupid_backoff"](spark, sf).toPandas(), duck(sf).sql(queries.SQL["op3_stupid_backoff"]).df())


# --- media ----------------------------------------------------------------------------------------------------------


def test_media(spark):
    rows = media.inspected(media.media_column(odd_documents(spark))).collect()
    want = Counter()
    for doc_id, text, _, _ in odd_texts():
        body = (text or "").encode()
        padded = body + b"\xff" * (max(576, -(-len(body) // 576) * 576) - len(body))
        want[doc_id, len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in rows if r.doc_id == 15}) == 1
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    pixels = media.pixel_arrays(media.media_column(odd_documents(spark)).filter("doc_id = 8")).first()
    assert (pixels.height, pixels.width, len(pixels.pixels)) == (1, 144, 144) and pixels.pixels[0] == int.from_bytes(b"one ", "big")


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd_documents(spark), group_docs=10, added=True).collect()
    want = Counter()
    for doc_id, text, _, _ in odd_texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(min(first, len(ids)), len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 6  # one for each group at most
    assert bag(packing.pack_documents(odd_documents(spark, 5), group_docs=10, added=True)) == sorted(map(repr, map(tuple, rows)))


def test_added_tokens(spark, tmp_path):
    """Registered packing gives the ids of the tokenizer as loaded, which finds added tokens in texts."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random = np.random.default_rng(6)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "hello", " world", "é", "12", "'s", "\u00a0", "!"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>" * 1500] + ["".join(random.choice(parts, random.integers(1, 12))) for _ in range(300)]
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.update((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(ids, 1024)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.QUERIES["op10_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()) == want


@pytest.mark.parametrize("fill", [False, True])
def test_sum_of_squares_choice(fill):
    """Each item goes where the sum over gaps of squared counts is smallest."""
    random = np.random.default_rng(2)
    lengths = random.integers(1, 65, 400).tolist()
    places, offsets = packing.sum_of_squares(lengths, 64, fill)
    gap, count = {}, Counter()
    for n, where, offset in zip(lengths, places.tolist(), offsets.tolist(), strict=True):
        def total(g):
            after = count.copy()
            if g != 64:
                after[g] -= 1
            if g > n:
                after[g - n] += 1
            return sum(v * v for v in after.values())
        was = gap.get(where, 64)
        assert offset == 64 - was and was >= n
        open_ = [g for g, v in count.items() if v and g >= n]
        assert total(was) == min(total(g) for g in (open_ if fill and open_ else [64, *open_]))
        if was != 64:
            count[was] -= 1
        gap[where] = was - n
        if was > n:
            count[was - n] += 1


# --- all ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("f", [
    lambda d: mixing.mixed_words(d), lambda d: mixing.mixed_documents(d), lambda d: lm_score.scores(d), lambda d: media.inspected(media.media_column(d)), lambda d: jaccard_join.near_copies(d), lambda d: jaccard_join.without_near_copies(d),
    lambda d: nbsvm.quality(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")), lambda d: langid.identify(d), lambda d: langid.with_language(d), lambda d: packing.pack_documents(d)])
def test_empty_table(spark, f):
    assert f(no_documents(spark)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").select("doc_id").collect()
    comp = {r.doc_id: r.component_id for r in jaccard_join.near_copies(docs).collect()}
    held = {r.doc_id for r in kept.collect()}
    lost = [r.doc_id for r in good if r.doc_id not in held and comp[r.doc_id] == r.doc_id]
    assert len(lost) <= 0.02 * len(good)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= held
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n > 1024 OR n <> m").count() == 0
