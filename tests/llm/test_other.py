"""Embeddings, WebP, URLs and conversations."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import duck, same_rows

from rarebucket.llm import chat, components, graph_dedup, queries, url_filter, webp

# --- embeddings -----------------------------------------------------------------------------------------------------


def brute_links(rows, bound=0.98):
    fine = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float) / np.abs(v).max()
            fine[i] = x / np.linalg.norm(x)
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in fine.items():
        for j, y in fine.items():
            if j < i and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= bound:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    ids = {}
    for i in range(len(rows)):
        ids[find(i)] = min(ids.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], ids[find(i)], rows[i][0] == ids[find(i)]) for i in range(len(rows)))


def clusters(seed, groups, each, dims=16, noise=0.03):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return [(c + random.normal(size=dims) * noise).tolist() for c in centres for _ in range(each)]


def test_near_vectors(spark):
    vectors = clusters(1, 40, 5) + clusters(2, 1, 60, noise=0.02)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e300] * 16, [1e300] * 16, vectors[0], vectors[0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 90, vectors[0], None), (n + 91, vectors[0], None), (n + 92, vectors[0], 5), (n + 92, vectors[0], 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("n_links", F.lit(0))
    for shard in (4096, 48):
        got = sorted(tuple(r) for r in graph_dedup.near_vectors(table, shard=shard).collect())
        want = brute_links(rows)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)), "a link below the bound"
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
        if shard == 4096:
            assert got == want
    assert graph_dedup.near_vectors(table.limit(0)).count() == 0


def test_dense_ball_in_groups(spark):
    rows = [(i, v, 0) for i, v in enumerate(clusters(3, 1, 150, noise=0.01))]
    got = sorted(tuple(r) for r in graph_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=40).collect())
    assert got == brute_links(rows)


def test_audit(spark, monkeypatch):
    """Links that were not found make the operator fail."""
    rows = [(i, v, 0) for i, v in enumerate(clusters(5, 20, 6))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = spark.createDataFrame([("p", i, 1, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v, _ in rows], "place string, node long, many long, vector array<double>")
    counts = spark.createDataFrame([(i, n) for i, n, _, _ in brute_links(rows)], "node long, n long")
    assert graph_dedup.recall(nodes, counts, 0.98) == 1.0
    assert graph_dedup.recall(nodes, counts.filter("node < 60"), 0.98) < 0.8
    monkeypatch.setattr(graph_dedup, "expanded", lambda x, links, q, found, bound: (np.arange(0), np.arange(0)))
    with pytest.raises(Exception, match="links of audited vectors"):
        graph_dedup.near_vectors(table)


def test_several_shards_at_the_settings_of_the_query(spark):
    """Labels of more than one shard: clusters with guests, united lists and search; all links by brute force."""
    random = np.random.default_rng(8)
    base = random.normal(size=(4000, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    # chains of near copies, so that links cross the borders of clusters
    rows = [(3 * i + k, (v + random.normal(size=24) * 0.02 * k).tolist(), 0) for i, v in enumerate(base) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = sum(int((x[a : a + 1000] @ x.T >= 0.98).sum()) for a in range(0, len(x), 1000)) - len(x)
    got = sum(r.n_links for r in graph_dedup.near_vectors(table).collect())
    assert len(rows) > 5 * graph_dedup.SHARD and 0.99 * want <= got <= want


def test_components(spark):
    random = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(300)] + [tuple(map(int, random.integers(1000, 1400, 2))) for _ in range(250)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7), (9000, 9001), (9000, 9001)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.component for r in components.components(rows).collect()} == {x: find(x) for x in up}
    assert components.components(rows.limit(0)).count() == 0


# --- WebP -----------------------------------------------------------------------------------------------------------

IMAGES = [
    np.random.default_rng(1).integers(0, 2**32, (7, 9), dtype=np.uint64).astype(np.uint32), (np.random.default_rng(2).integers(0, 5, (20, 33)) * 0x01020304).astype(np.uint32), np.zeros((1, 1), np.uint32), np.full((5, 40), 0xFFAABBCC, np.uint32),
    (np.add.outer(np.arange(30), np.arange(17)) * 0x00010203).astype(np.uint32) | np.uint32(0xFF000000), (np.arange(300) % 2 * 0xFF).astype(np.uint32).reshape(10, 30),
]
OPTIONS = [
    {}, {"matches": False}, {"cache": 1}, {"cache": 4}, {"cache": 11}, {"meta": 2}, {"meta": 3, "cache": 6}, {"palette": True}, {"palette": True, "modes": (1, 2)}, {"subtract_green": True}, {"cross": ((3, -5, 100), (-128, 127, 9))},
    *[{"modes": (m,)} for m in range(14)], {"modes": tuple(range(14)), "cross": ((77, 1, -9),), "subtract_green": True, "cache": 5, "meta": 2, "step": 3},
]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_webp_round_trip(options):
    for image in IMAGES:
        data = webp.encode(image, **options)
        back, size = webp.decode(data + b"more")
        assert size == len(data) and np.array_equal(back, image)


def test_webp_by_hand():
    """A stream put together from the format's description: 2 x 1 pixels, every code with one or two symbols."""
    out = webp.Writer()
    for value, n in ((0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    for value, n in ((1, 1), (1, 1), (1, 1), (10, 8), (20, 8)):  # green: 10 or 20, one bit each
        out.put(value, n)
    for symbol in (7, 9, 255):  # red, blue, alpha: one symbol, no bits
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(value, n)
    for value, n in ((1, 1), (0, 1), (0, 1), (0, 1)):  # distance
        out.put(value, n)
    out.put(1, 1)
    out.put(0, 1)
    value, n = out.number()
    pixels = webp.read_stream(value.to_bytes(-(-n // 8), "little"))
    assert pixels.tolist() == [[0xFF071409, 0xFF070A09]]


def bits_of(*parts):
    """A stream of (value, bits) parts, first bit lowest."""
    value = n = 0
    for v, k in parts:
        value, n = value | v << n, n + k
    return value.to_bytes(-(-n // 8), "little")


def one(symbol):
    """A code with one symbol, which takes no bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def constant(a, r, g, b):
    """The five codes of an image in which all pixels are alike, in the order of the format."""
    return [*one(g), *one(r), *one(b), *one(a), *one(0)]


def head(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def two(x, y, alphabet):
    """A code in which x is bit 0 and y bit 1. The lengths 0 and 1 and runs of zeros (18) have the words 10, 11 and 0."""
    parts, at = [(0, 1), (15, 4), *[({18: 1, 0: 2, 1: 2}.get(s, 0), 3) for s in webp.LENGTH_ORDER], (0, 1)], 0
    for symbol in (x, y, alphabet):
        while at < symbol:
            n = min(symbol - at, 138) if symbol - at >= 11 else 1
            parts += [(0, 1), (n - 11, 7)] if n > 1 else [(1, 2)]
            at += n
        if symbol < alphabet:
            parts.append((3, 2))
            at += 1
    return parts


ENTRY = (webp.CACHE_FACTOR * 0xFF070A09 & 0xFFFFFFFF) >> 31
PLAIN, NO_CACHE = [(0, 1)], [(0, 1)]  # no (further) transform; neither cache nor, on top, groups of codes


@pytest.mark.parametrize(("parts", "want"), [
    # subtract green: red and blue are less the green
    ([*head(2, 1), (1, 1), (2, 2), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(255, 1, 10, 250)], [[0xFF0B0A04] * 2]),
    # cross-colour in blocks of 4: green to red 1.0, green to blue -0.5, red to blue 2.0 (64 in units of 1/32)
    ([*head(1, 1), (1, 1), (1, 2), (0, 3), *NO_CACHE, *constant(255, 64, 240, 32), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(255, 1, 10, 0)], [[0xFF000A00 | (1 + 10) << 16 | (-5 + 22) & 255]]),
    # predictors: black first, then left in the first row, above in the first column
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 0, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000100, 0xFF000100]]),
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 1, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000300, 0xFF000400]]),
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 2, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000300, 0xFF000400]]),
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 3, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000400, 0xFF000300]]),  # above right of the last: the first of its own row
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 4, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000200, 0xFF000300]]),
    ([*head(3, 2), (1, 1), (0, 2), (0, 3), *NO_CACHE, *constant(0, 0, 12, 0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(0, 0, 1, 0)], [[0xFF000100, 0xFF000200, 0xFF000300], [0xFF000200, 0xFF000400, 0xFF000600]]),
    # palette of two colours, the second as a difference: eight indexes a pixel, first lowest
    ([*head(5, 1), (1, 1), (3, 2), (1, 8), *NO_CACHE, *one(7), *one(1), *one(2), *one(128), *one(0), *PLAIN, *NO_CACHE, *NO_CACHE, *constant(255, 0, 0b10110, 0)], [[0x80010702, 0x00020E04, 0x00020E04, 0x80010702, 0x00020E04]]),
    # colour cache of two entries: a literal, the entry that it went to, the literal again; and the entry that nothing went to
    ([*head(3, 1), *PLAIN, (1, 1), (1, 4), (0, 1), *two(10, 280 + ENTRY, 282), *one(7), *one(9), *one(255), *one(0), (0, 1), (1, 1), (0, 1)], [[0xFF070A09] * 3]),
    ([*head(3, 1), *PLAIN, (1, 1), (1, 4), (0, 1), *two(10, 281 - ENTRY, 282), *one(7), *one(9), *one(255), *one(0), (0, 1), (1, 1), (0, 1)], [[0xFF070A09, 0, 0xFF070A09]]),
    # a literal, then a back-reference of length 3 (prefix symbol 2) by distance code 2, the pixel to the left
    ([*head(4, 1), *PLAIN, *NO_CACHE, *NO_CACHE, *two(20, 258, 280), *one(7), *one(9), *one(255), *one(1), (0, 1), (1, 1)], [[0xFF071409] * 4]),
], ids=lambda x: "")
def test_webp_streams_by_hand(parts, want):
    """Streams put together from the format's description alone, one per inverse."""
    assert webp.read_stream(bits_of(*parts)).tolist() == want


def test_every_inverse_is_on_the_way_of_the_query(spark, tmp_path, monkeypatch):
    """Texts for which each way of writing pays: the registered query reads them back through the inverses."""
    from rarebucket.llm import media

    random = np.random.default_rng(1)
    line = "".join(map(chr, random.integers(97, 123, 576)))
    texts = {
        webp.INDEXED: "four" * 300, webp.ABOVE: line * 9 + "end", webp.CROSSED: "".join(chr(c) * 4 for c in random.integers(33, 126, 1000)),
        webp.CACHED: "".join(random.choice(["and ", "the ", "of a", "word", "%04x" % random.integers(1 << 16)]) for _ in range(900)), webp.PLAIN: "".join(map(chr, random.integers(32, 126, 4000))),
    }
    used = []
    for name in ("undo_predictor", "undo_cross", "undo_palette", "undo_cache", "copy"):
        monkeypatch.setattr(webp, name, lambda *a, name=name, f=getattr(webp, name): used.append(name) or f(*a))
    seen = {}
    for way, text in texts.items():
        used.clear()
        (stored,) = media.store([text.encode()])
        pixels = np.ascontiguousarray(np.frombuffer(media.padded(text.encode()), np.uint8)).view(">u4").astype(np.uint32)
        starts = np.array([0, len(pixels)])
        assert webp.ways(pixels, starts, webp.repeats(pixels, starts)[:-1])[0].tolist() == [way]
        assert b"".join(map(webp.samples_of, media.load(stored))) == media.padded(text.encode())
        seen[way] = {*used}
    monkeypatch.undo()
    assert "undo_palette" in seen[webp.INDEXED] and "undo_predictor" in seen[webp.ABOVE] and "undo_cross" in seen[webp.CROSSED] and "undo_cache" in seen[webp.CACHED] and "copy" in seen[webp.ABOVE]
    spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op4_webp"](spark, str(tmp_path)).collect():
        assert r.payload_sha256 == hashlib.sha256(media.padded(texts[r.doc_id].encode())).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media.store([texts[r.doc_id].encode()])[0]).hexdigest()


@pytest.mark.parametrize("cut", [1, 10, 21, 30, 60])
def test_damaged_webp(cut):
    data = webp.encode(IMAGES[0])
    with pytest.raises(ValueError):
        webp.decode(data[: len(data) - cut])
    with pytest.raises(ValueError):
        webp.read_stream(data[20 : 20 + int.from_bytes(data[16:20], "little") - cut])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
def test_payloads(bodies):
    from rarebucket.llm import media

    stored = media.store(bodies)
    for body, one in zip(bodies, stored, strict=True):
        assert b"".join(webp.samples_of(i) for i in media.load(one)) == media.padded(body)
        assert media.store([body]) == [one]


def test_payload_of_several_windows():
    from rarebucket.llm import media

    random = np.random.default_rng(5)
    body = random.integers(0, 256, 300_000, dtype=np.uint8).tobytes() + b"\x07" * 70_000 + "so wörd ".encode() * 9000
    stored = media.store([body, b"", body])
    assert stored[0] == stored[2]
    assert b"".join(webp.samples_of(i) for i in media.load(stored[0])) == media.padded(body)


def test_payload_of_several_files(monkeypatch):
    from rarebucket.llm import media

    monkeypatch.setattr(media, "SIDE", 4)
    body = bytes(range(256)) * 40
    (one,) = media.store([body])
    assert len(media.load(one)) > 1 and b"".join(webp.samples_of(i) for i in media.load(one)) == media.padded(body)


# --- URLs -----------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.net/en/x", "https://a.b.example.NET/en/1?q=/de/#f", "http://example.net/EN/x", "http://example.net", "http://example.net?x=/en/", "http://xexample.net/fr/",
    "http://example.com/de/1", "http://example.com/de", "http://sub.org/fr/9", "http://org/fr/", "x://y://z.org/fr/", "http://ä.org/fr/\u00e9", "http://user@host.com:80/p#f?g", "http://a.com/\n/b", "://c.net/en/",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
    path = rest[k:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(1000 + i, f"http://good{i % 7}.org/fr/page{i}") for i in range(60)] + [(2000 + i, f"http://spam{i % 7}.net/casino{i}") for i in range(60)] + [(3000, "http://good3.example.de/fr/page5"), (3001, "http://spam3.example.de/casino5")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("html", F.lit(None).cast("string"))
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        assert (got[i].host, got[i].path, got[i].rule) == plain_rule(u), u
        assert got[i].verdict in ("allow", "block")
        if got[i].rule:
            assert got[i].verdict == {h + p: v for h, p, v in url_filter.RULES}[got[i].rule]
    assert (got[3000].verdict, got[3001].verdict) == ("allow", "block") and got[0].lm_score == got[1].lm_score == 0
    assert {r.verdict for r in url_filter.judged(pages.filter("page_id < 5")).filter("rule IS NULL").collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_character_model():
    """Blended chances against a plain loop, and that they add up to one."""
    import pyarrow as pa

    urls = ["http://a.org/x1", "http://b.org/x22", "ab"]
    gram, row = url_filter.grams(pa.array(urls))
    n = url_filter.SIGNS
    counts = np.bincount(gram, minlength=n**4)
    table = url_filter.chances(counts)
    assert np.allclose(np.exp(table).reshape(-1, n).sum(1), 1)
    strings = [[0, 0, 0, *url_filter.sign_table()[np.frombuffer(u.encode(), np.uint8)].tolist(), 0] for u in urls]

    def chance(context, c):
        p = 1 / n
        for k in range(4):
            own = context[3 - k :]
            follow = [s[i] for s in strings for i in range(3, len(s)) if s[i - k : i] == own]
            if follow:
                p = (follow.count(c) + len(set(follow)) * p) / (len(follow) + len(set(follow)))
        return p

    for s in strings:
        for i in range(3, len(s)):
            code = ((s[i - 3] * n + s[i - 2]) * n + s[i - 1]) * n + s[i]
            assert np.isclose(np.exp(table[code]), chance(s[i - 3 : i], s[i]))
    assert np.bincount(row).tolist() == [len(u) + 1 for u in urls]


# --- conversations --------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    #       1 -> 2 -> 4 -> 5      mean score (0+1+9+2)/4 = 3
    #         -> 3                mean score (0+5)/2 = 2.5
    rows = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "c", 5.0), ("t", 4, 2, "tool]x", "d[", 9.0), ("t", 5, 4, "assistant", None, 2.0), ("u", 1, 99, None, "lone", None), ("v", 1, 2, "user", "cycle", 1.0), ("v", 2, 1, "user", "cycle", 1.0)]
    messages = spark.createDataFrame(rows, "tree string, message long, parent long, role string, text string, score double")
    paths = chat.best_paths(messages, 2)
    assert sorted(tuple(r) for r in paths.collect()) == [("t", 1, 1, 1), ("t", 1, 2, 2), ("t", 1, 3, 4), ("t", 1, 4, 5), ("t", 2, 1, 1), ("t", 2, 2, 3), ("u", 1, 1, 1)]
    out = {(r.tree, r.path): r for r in chat.formatted(paths, messages).withColumn("turns", chat.parsed(F.col("conversation"))).withColumn("loss", chat.masked_text(F.col("conversation"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out["t", 1].turns] == [("user", "root"), ("assistant", "b"), ("tool]x", "d["), ("assistant", "")] and out["t", 1].loss == "b"
    assert out["t", 1].conversation == "<s>[INST]root[/INST]b</s>[ROLE]tool]x[TEXT]d[\\[/ROLE]</s>"
    assert [tuple(t) for t in out["u", 1].turns] == [("", "lone")]
    assert chat.best_paths(messages.limit(0)).count() == 0


def test_conversations(spark):
    odd = ["</s>[INST] ok [/INST]", "", None, "\\", "<\\[\\\\<s>", "line\nline\r\n", "x" * 200_000, "😀[ROLE]a[TEXT]b[/ROLE]", "<<SYS>>[/INST]<</SYS>>"]
    roles = ["user", "assistant", "system", "tool", None, "assistant", "user", "a[b]</s>", "assistant"]
    rows = [(i, k, r, t) for i, shift in enumerate(range(9)) for k, (r, t) in enumerate(zip(roles[shift:] + roles[:shift], odd, strict=True))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (51, None, "assistant", "no turn"), *[(52, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(70)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("depth", "tree", "message", "start", "open")})
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns.unionByName(chat.probe(spark), allowMissingColumns=True))).collect()}
    want = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, all_turns in want.items():
        all_turns.sort()
        flat, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in all_turns), "".join(t for _, _, r, t in all_turns if r == "assistant")
        row = got.pop(conv)
        assert (row.n_turns, row.turns_sha256) == (len(all_turns), hashlib.sha256(flat.encode()).hexdigest()), conv
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert not got
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_turns_without_a_conversation(spark):
    """Rows whose conv_id is null are a conversation of their own, whole and in order."""
    rows = [(None, 2, "user", "c"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (7, 0, "user", "x"), (7, 1, "assistant", None)]
    got = {r.tree: r.conversation for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: "<s>[INST]a[/INST]b</s>b</s>[INST]c[/INST]", 7: "<s>[INST]x[/INST]</s>"}
    messages = spark.createDataFrame([(None, m, m - 1 if m else None, "user", str(m), 1.0) for m in range(9)], "tree long, message long, parent long, role string, text string, score double")
    assert sorted(r.message for r in chat.best_paths(messages).filter("tree IS NULL").collect()) == [*range(9)]


def test_conversations_sql(spark, sf):
    same_rows(queries.QUERIES["op6_chat"](spark, sf).toPandas(), duck(sf).sql(queries.SQL["op6_chat"]).df())
