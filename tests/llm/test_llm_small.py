"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, common, embed_dedup, html_extract, langid, minhash, mixing, packing, suffix_dedup, toxicity, warc
from quillon.llm.queries import word_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, k string, row string"


def words(n, seed, stock=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) + str(r.randrange(stock)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [words(120, i) for i in range(12)]
    near = base[0].split(" ")
    near[60] = "changed"
    shared = words(90, 99)
    texts = base + [base[1], base[1], " ".join(near), base[2][:300] + " " + shared, shared + " " + base[3][:200], None, "", " \n\t", "short one", "Short  one", "ünïcode ß " + words(70, 5), words(6000, 7)]
    rows = [(i, t, "en", [None, "a", "b", "ü"][i % 4], 0, 1, 2, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id " + words(20, 3), None, None, None, 1, 2, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3, "n_chars").persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(400, 500)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    low = {}
    for x in list(parent):
        low[find(x)] = min(low.get(find(x), x), x)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(low[find(x)] == c for x, c in got.items()) and {x for e in edges if e[0] != e[1] for x in e} == set(got)


# 1: mixing


def webster(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_highest_quotients_against_seat_by_seat(spark):
    r = random.Random(2)
    for weights in ([5.0, 3.0, 1.0], [r.uniform(0, 50) for _ in range(23)], [7.0] * 6, [0.0, 3.0], [1000.0, 1.0, 1.0, 1.0]):
        for seats in (0, 1, 10, 97):
            x = spark.createDataFrame([("g", i, w, seats) for i, w in enumerate(weights)], "g string, i int, w double, s long")
            got = {r.i: r.won for r in mixing.highest_quotients(x, ["g"], ["i"], "w", "s").collect()}
            assert [got[i] for i in range(len(weights))] == webster(weights, seats)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs, block=4, shard_words=256).collect()
    assert len(got) == len(rows) and collections.Counter(got) == collections.Counter(mixing.mix(docs, block=4, shard_words=256).collect())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    by = {(r.source_size, round(r.target, 6)) for r in got}
    assert by == {(sizes[s], round(target[s], 6)) for s in names}
    taken = collections.Counter()
    for r in got:
        taken[round(r.target, 6)] += r.taken
    assert all(abs(taken[round(target[s], 6)] - target[s]) <= 0.03 * target[s] + 24 for s in names)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, keep=True).select("row.*").columns == docs.columns


# 7: MinHash


def brute_classes(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}

    sets = [shingles(t) for t in texts]
    df = collections.Counter(k for s in sets for k in s)
    w = [{k: c * (math.log((1 + len(texts)) / (1 + max(2, df[k]))) + 1) for k, c in s.items()} for s in sets]
    comp = list(range(len(texts)))
    for i in range(len(w)):
        for j in range(i):
            common_ = sum(min(v, w[j].get(k, 0)) for k, v in w[i].items())
            if common_ and common_ >= 0.8 * (sum(w[i].values()) + sum(w[j].values()) - common_):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return comp


def test_minhash_classes(docs, rows, empty):
    comp = brute_classes([r[1] for r in rows])
    ids = collections.defaultdict(list)
    for r, c in zip(rows, comp):
        ids[c].append(r[0])
    low = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    expected = collections.Counter((r[0], low[c] if len(ids[c]) > 1 else r[0], len(ids[c])) for r, c in zip(rows, comp))
    got = minhash.dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    kept = minhash.keep_one(docs).collect()
    assert len(kept) == len(ids) and {tuple(r) for r in kept} <= set(rows)
    assert minhash.dedup(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_large_groups_in_blocks_lose_no_link(docs, rows):
    one = {(r.doc_id, r.class_id) for r in minhash.dedup(docs).collect()}
    assert one == {(r.doc_id, r.class_id) for r in minhash.dedup(docs, block=200, frequent=2).collect()}  # nor do frequent shingles


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 200).astype(np.float32), rng.uniform(0.5, 3, 200).astype(np.float32)
    s = minhash.icws(np.r_[h, h], np.r_[a, b], np.array([0, 200]), 3000, 1)
    assert abs((s[:, 0] == s[:, 1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# 9: suffix array


def brute_repeats(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        out = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                out[i : i + n] = b"\1" * n
        yield len(t), sum(out), sum(bool(x) for x in bytes(out).split(b"\0")), hashlib.sha256(bytes(x for x, y in zip(t, out) if not y)).hexdigest()


def test_repeats_against_all_substrings(docs, rows, empty):
    keyed = docs.select("doc_id", suffix_dedup.text_key(F.col("text")).alias("k"))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in keyed.join(suffix_dedup.remove_repeats(docs), "k").collect())
    expected = collections.Counter((r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 400)))
    assert got == expected and suffix_dedup.remove_repeats(empty).count() == 0
    hot = keyed.join(suffix_dedup.remove_repeats(docs, hot=1500), "k").collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in hot) == expected


def test_difference_cover_sort_on_hard_texts():
    rng = np.random.default_rng(3)
    for trial in range(12):
        buf = rng.integers(97, 98 + trial % 3, 2500, dtype=np.uint8)
        if trial % 3 == 1:
            buf[:1200] = np.tile(buf[: 3 + trial], 400)[:1200]
        for _ in range(4):
            a, b, n = rng.integers(0, 2200), rng.integers(0, 2200), rng.integers(50, 300)
            buf[a : a + n] = buf[b : b + n].copy()
        at, n = np.arange(len(buf) - 48 + 1), 48
        seen = collections.Counter(bytes(buf[i : i + n]) for i in at)
        assert (suffix_dedup.repeated(buf, at, np.zeros(len(at), np.int64), n) == [seen[bytes(buf[i : i + n])] > 1 for i in at]).all()


def test_cover_covers():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


# 10: packing


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_bpe())
    got = packing.pack(docs, word_bpe(), capacity=256, keep_ids=True).collect()
    at = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 <= 256 and r.ids_crc32 == zlib.crc32(r.ids)
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 256
    assert len(at) <= -(-sum(r.length for r in got) // 256) + 2
    expected = collections.Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            expected[r[0], k // 256, k, np.array(ids[k : k + 256], "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == expected
    assert packing.pack(empty, word_bpe()).count() == 0


def test_fast_tokenizer_is_the_library():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(word_bpe()), packing.tokenizer(word_bpe())
    texts = ["", "It's we'll ÉCOLE naïve  x1y2 ½²", "a<|endoftext|>b <|startoftext|>", "日本語 text İstanbul ΣΑΣ", "tab\tnew\nline nbsp\x1cfs", "é combining", "a\0b !!?? $$$"]
    assert fast.encode_batch(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(4)
    length = rng.integers(1, 100, 300).tolist()
    a = packing.best_fit(range(300), length, 100)
    b = packing.best_fit(sorted(range(300), key=lambda i: -length[i]), length, 100)
    c = packing.crossover(a, b, length, 100, rng)
    assert sorted(i for x in c for i in x) == list(range(300)) and all(sum(length[i] for i in x) <= 100 for x in c)
    assert len(packing.evolve([a], length, 100, 20, rng)[0]) <= len(a)


# 8 and 2: classifiers


def test_toxicity(spark, empty):
    r = random.Random(5)
    stock = ["calm", "river", "table", "green", "walk", "paper", "music", "stone"]
    text = lambda bad, group: " ".join(r.choices(stock, k=30) + ["scum"] * bad + ["women"] * group)
    data = [(i, text(i % 2, (i % 2) and i % 5 > 0), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "women walk")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(900, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    test = spark.createDataFrame([(1, "such scum here", 0), (2, "women walk by the river", 0), (3, "men walk by the river", 0), (4, None, 0), (5, "calm " * 50_000 + "scum", 0)], "doc_id long, text string, score int")
    got = {x.row.doc_id: x for x in toxicity.score(test, model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 1] and abs(got[2].score - got[3].score) < 0.2 and got[1].row.score == 0
    fits = []
    for penalty in (0.0, 4.0):
        sample = toxicity.Sample()
        for s in range(0, 400, 150):
            sample.add([t for _, t, _ in data[s : s + 150]], [y for _, _, y in data[s : s + 150]])
        fits.append(toxicity.fit(sample, penalty=penalty))
    plain, held = fits
    gap = lambda m: abs(toxicity.logits(*toxicity.features(["women"]), m[0], 1)[0])
    assert gap(held) < 0.5 * gap(plain)
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(test, none).where("score > 0.001").isEmpty() and toxicity.score(empty, model).count() == 0


def test_swaps():
    assert toxicity.swapped(["no one", "Women and Jewish people"]) == ([1, 1], ["men and hindu people", "_ and _ people"])


def brute_marginals(e, trans):
    import itertools

    n, k = e.shape
    m = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = math.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, s in enumerate(path):
            m[i, s] += p
    return m / m.sum(1, keepdims=True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(6)
    sizes = np.array([3, 1, 5])
    e, trans = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    expected = np.concatenate([brute_marginals(x, trans) for x in np.split(e, [3, 4])])
    assert np.allclose(langid.marginals(e, sizes, trans), expected, atol=1e-6)


def test_language_id(spark, empty):
    r = random.Random(7)
    make = lambda parts: " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(60))
    one, two = ["the", "ing", "wh", "er"], ["que", "ción", "ar", "os"]
    docs = spark.createDataFrame([(i, make(one if i % 2 else two), "en" if i % 2 else "es") for i in range(60)] + [(70, None, "en"), (71, make(one), None), (72, "12 $ 3", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs, max_rows=25)
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # many batches in a task
    assert got == {x.doc_id: x for x in langid.predict(docs.coalesce(1), model).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert all(got[i].lang_pred == ("en" if i % 2 else "es") and 0.5 < got[i].score <= 1 for i in range(60))
    assert got[71].lang_pred == "en" and got[70].lang_pred == got[72].lang_pred == "und" and got[70].score == 0
    _, m = langid.label_words([make(one) + " " + make(two)], *model)
    assert m[:50].mean(0).argmax() == model[0].index("en") and m[-50:].mean(0).argmax() == model[0].index("es")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert langid.predict(docs, langid.train(empty)).where("lang_pred <> 'und'").isEmpty()


# 3 and 6: embeddings


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 12))
    x[50:90] = x[50] + rng.normal(size=(40, 12)) * 0.03
    x[90:100] = x[90]
    x[100] = x[99] * 3
    rows = [(i, [float(v) for v in r], i % 3 if i < 50 else 7) for i, r in enumerate(x)]
    odd = [(300, None, 7), (301, [0.0] * 12, 7), (302, [float("nan")] * 12, 7), (303, [None, *[1.0] * 11], 7), (304, rows[60][1], None), (305, rows[60][1], 8), (306, [], 7), (307, [1.0, 2.0], 7), (320, [float("inf")] * 12, 7)]
    return rows + odd + [rows[61]]


def test_ann(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v)) for i, v, _ in vectors if v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for q, found in got.items():
        v = next(v for i, v in good if i == q)
        best = sorted(((-float((v * x).sum()), i) for i, x in good if i != q))[:20]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in best] and [r for r, _, _ in sorted(found)] == list(range(1, 21))
    loose = ann.nearest(df, F.col("vec_id") % 20 == 0, factor=1.5, shard=64).collect()
    exact = {(q, i) for q, f in got.items() for _, i, _ in f}
    assert len({(r.query_id, r.vec_id) for r in loose} & exact) >= 0.9 * len(exact)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_ties(spark):
    """op3: of more equal scores than k, of equal vectors and of others, the smallest ids."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)) * 0.1
    x[100:400] = x[0] = [1, 1, 1, 1, 1, 1]  # equal vectors
    x[20], x[400:500] = [0, 0, 0, 0, 0, 9], 0
    x[400:500, 0], x[400:500, 5] = -np.arange(100) - 1, 8  # others of one score for 20
    rows = [(int(i), [float(v) for v in x[i]]) for i in rng.permutation(600)] + [(101, [1.0] * 6)] * 5
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 20, 120), factor=1.0, shard=10000).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for q in (0, 20, 120):
        best = sorted((-float((x[q] * np.array(v)).sum()), i) for i, v in rows if i != q)[:20]
        assert [i for _, i in sorted(set(got[q]))] == [i for _, i in best]


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_links(spark, vectors, block):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    ok = [n for n, (_, v, l) in enumerate(vectors) if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    comp, links = {n: n for n in ok}, collections.Counter()
    for a in ok:
        for b in ok:
            x, y = np.array(vectors[a][1]), np.array(vectors[b][1])
            if a < b and vectors[a][2] == vectors[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                low, high = sorted((comp[a], comp[b]))
                comp = {n: low if c == high else c for n, c in comp.items()}
    ids = collections.defaultdict(list)
    for n, c in comp.items():
        ids[c].append(vectors[n][0])
    expected = collections.Counter((v[0], links[n], min(ids[comp[n]]) if n in comp else v[0]) for n, v in enumerate(vectors))
    got = embed_dedup.near_vectors(df, block=block).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(9).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embed_dedup.hadamard(embed_dedup.hadamard(x)), x)


# 4: HTML


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body class="x"><nav>menu</nav><div class="ad">buy</div><article><header><h1>A &amp; B</h1></header><p>one <b>two</b><br>three<p>four<script>var t="</p>";</script>&eacute;<ul><li>five<li>six</ul><form>no</form><div class="comments">talk</div><pre> a\n b </pre></article><aside>side</aside><footer>f</footer>'
    plain = lambda i: f'<body><div class="top">Always here</div><div class="text"><p>Story {i} begins.</p><p>And {i * 7} ends.</p></div><div id="cookie-notice">ok?</div></body>'
    rows = [(1, "http://a.org/x", page), (2, "http://a.org/y", None), (3, None, ""), (4, "http://c.org", "<p>cut off <a href='x"), (4, "http://c.org", "<p>cut off <a href='x")] + [(10 + i, "http://b.org/" + str(i), plain(i)) for i in range(8)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "page_id long, url string, html string, salt int, host string")
    got = collections.defaultdict(list)
    for r in html_extract.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[1] == ["A & B\none two three\nfouré\nfive\nsix\na b"] and got[2] == got[3] == [""] and got[4] == ["cut off"] * 2
    assert got[12] == ["Story 2 begins.\nAnd 14 ends."]  # what each page of the host repeats is no text
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_tree_inside_and_outside_articles(spark):
    """op4: what each page of a host repeats goes from articles too, and an article is no reason to lose the rest."""
    article = lambda i: f'<body><article><h1>Title {i}</h1><p>Story {i}.</p><p>Sign up now.</p><div class="note">All rights.</div></article></body>'
    teaser = lambda i: f'<body><div class="text"><p>Body {i}.</p></div><aside><article>Read {i}</article></aside><div hidden><main>None {i}</main></div><article>Teaser</article></body>'
    rows = [(i, f"http://a.org/{i}", article(i)) for i in range(8)] + [(10 + i, f"http://b.org/{i}", teaser(i)) for i in range(8)]
    rows += [(20 + i, f"http://c.org/{i}", article(1)) for i in range(9)] + [(30, "http://c.org/z", "<article><h1>Other</h1><p>Text.</p></article>")]
    rows += [(40, "http://d.org", "<body><form><article>In a form</article></form></body>"), (41, "http://d.org", teaser(1))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Title {i}\nStory {i}." for i in range(8)]
    assert [got[10 + i] for i in range(8)] == [f"Body {i}." for i in range(8)]
    assert got[20] == "Title 1\nStory 1.\nSign up now.\nAll rights." and got[30] == "Other\nText."  # copies of a page are no template
    assert got[40] == "In a form" and got[41] == "Body 1.\nTeaser"


def test_html_hints_are_whole_names(spark):
    """op4: a word in a layout's class or in a section's or heading's id drops nothing; vague names leave it to the tree."""
    kept = ["container right-sidebar", "has-sidebar", "page-wrapper header-fixed", "social-policy", "legal-history", "search", "comment-on-the-method", "related-work"]
    gone = ["ad", "Sidebar", "ad-2", "cookie-notice", "box comments"]
    rows = [(i, None, f'<div class="{c}"><p>Text</p></div>') for i, c in enumerate(kept + gone)]
    rows += [(100 + i, None, f'<article><h2 id="comments">Head</h2><section id="{c}">Text</section></article>') for i, c in enumerate(kept)] + [(200, None, '<article class="post has-comments"><p>Text</p></article>')]
    rows += [(300 + i, f"http://a.org/{i}", f'<div class="legal">Same</div><div class="search">Found {i}</div><div class="ad">Buy {i}</div>') for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=6).collect()}
    assert [got[i] for i in range(len(kept + gone))] == ["Text"] * len(kept) + [""] * len(gone)
    assert [got[100 + i] for i in range(len(kept))] == ["Head\nText"] * len(kept) and got[200] == "Text"
    assert [got[300 + i] for i in range(8)] == [f"Found {i}" for i in range(8)]


# 5: WARC


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (1 + i % 5)) for i in range(300)] + [(5, None, None), (None, "u", "h"), (7, "http://x/7", "<p>é7</p>" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    damage = lambda x: x.where("page_id is null or page_id not in (11, 40)").withColumn("data", F.when(F.col("page_id").isin(5, 102), F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    got = warc.fixity(df, per_file=64, fanout=4, damage=damage).collect()
    assert len(got) == len(rows) and collections.Counter((r.page_id, r.status) for r in got if r.corrupt) == {(11, "missing"): 1, (40, "missing"): 1, (5, "changed"): 2, (102, "changed"): 1}
    by_file = collections.defaultdict(list)
    for r in got:
        by_file[r.file].append((r.record, r.offset, r.length))
    for f in by_file.values():
        end = 0
        for k, (n, offset, length) in enumerate(sorted(f)):
            assert n == k and offset == end
            end += length
    a = warc.tree(spark.createDataFrame([(0, 0, i, f"{i:064x}", i, i + 1) for i in range(20)], "file long, level int, n long, hash string, offset long, stop long"), fanout=4)
    b = warc.tree(spark.createDataFrame([(0, 0, i, f"{i + (i == 9):064x}", i, i + 1) for i in range(19)], "file long, level int, n long, hash string, offset long, stop long"), fanout=4)
    assert {(r.n, r.offset) for r in warc.audit(a, b, fanout=4).collect()} == {(9, 9), (19, 19)} and warc.audit(a, a, fanout=4).isEmpty()
    level = [hashlib.sha256(("node:" + "".join(f"{i:064x}" for i in range(k, min(k + 4, 20)))).encode()).hexdigest() for k in range(0, 20, 4)]
    assert [r.hash for r in a.where("level = 1").orderBy("n").collect()] == level
    assert warc.fixity(df.limit(0)).count() == 0


def test_warc_files_and_their_replicas(spark, tmp_path):
    """op5: files are written and read again; a replica with a changed, a lost, an added and a moved record, and one cut off, is told apart."""
    import gzip

    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (1 + i % 5)) for i in range(60)] + [(None, None, None)]
    written = warc.write_files(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), per_file=16)
    a = warc.read_files(spark, str(tmp_path / "a"))
    place = lambda df: sorted((r.file, r.n, r.offset, r.length) for r in df.collect())
    assert place(written) == place(a) and a.count() == len(rows) and a.where("not sound").isEmpty() and a.where("uri = 'http://x/7'").count() == 1
    (tmp_path / "b").mkdir()
    paths = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert all(gzip.open(p).read().startswith(b"WARC/1.1") for p in paths)
    for p in paths:
        parts = [p.read_bytes()[o : o + n] for o, n, _ in warc.members(str(p))]
        if p == paths[0]:
            parts[1] = gzip.compress(gzip.decompress(parts[1]).replace(b"<p>", b"<q>", 1))  # changed
            del parts[3]  # lost
            parts.insert(5, gzip.compress(gzip.decompress(parts[5]).replace(b"urn:uuid:", b"urn:uuid:f")))  # added
        if p == paths[1]:
            parts[0], parts[2] = parts[2], parts[0]  # moved
        data = b"".join(parts)
        (tmp_path / "b" / p.name).write_bytes(data[:-20] if p == paths[2] else data)  # cut off
    b = warc.read_files(spark, str(tmp_path / "b"))
    side = lambda x: x.select("file", "n", F.col("record_id").alias("uid"), F.col("sha256").alias("hash"), "offset", (F.col("offset") + F.col("length")).alias("stop"))
    got = sorted((r.file, r.status) for r in warc.compare(side(a), side(b), fanout=4).collect())
    assert got == [(0, "added"), (0, "changed"), (0, "missing"), (2, "missing")] and b.where("not sound").count() == 1
    assert warc.compare(side(a), side(a)).isEmpty()
