"""Long texts, overflow, ties and repeats, hard packings, entropies and the pipeline against plain recomputation."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, common, embed_dedup, html_extract, langid, minhash, packing, suffix_dedup, toxicity, words

from test_llm_small import brute_repeats
from test_llm_small import words as stock


# long texts: what is read in pieces is what is read whole


@pytest.mark.parametrize("overlap", [0, 4])
def test_pieces_cover_a_text(overlap):
    r = random.Random(overlap)
    text = b" ".join(bytes(r.choices(b"abc", k=r.randint(1, 12))) for _ in range(4000)) + b"x" * 3000
    parts = list(common.pieces(text, 1000, overlap))
    assert len(parts) > 20 and all(len(p) <= 1000 for _, p in parts) and parts[0][0] == 0
    assert b"".join(p[s:] for s, p in parts) == text
    short = [p for s, p in parts if s][: len(parts) // 2]
    assert all(len(p[:s].split()) == overlap for s, p in parts[1:20]) and (short or not overlap)


def test_long_texts_give_what_short_reads_give(monkeypatch):
    """op7, op8, op2, op9: pieces of a long text give the same shingles, features, labels and repeats."""
    text = stock(60_000, 3)  # 450 KB
    whole = minhash.slice_shingles([text.encode()], 5)
    real = common.pieces
    monkeypatch.setattr(minhash, "pieces", lambda t, most, overlap=0: real(t, 5000, overlap))
    cut = minhash.slice_shingles([text.encode()], 5)
    assert all((a == b).all() for a, b in zip(whole, cut))
    one = toxicity.features([text, "short text"])
    monkeypatch.setattr(words, "pieces", lambda t, most, overlap=0: real(t, 5000, overlap))
    assert all((a == b).all() for a, b in zip(one, toxicity.features([text, "short text"])))
    theta, trans = np.random.default_rng(1).normal(size=(langid.SIZE, 3)), np.eye(3)
    monkeypatch.undo()
    doc, m = langid.label_words([text, "ab cd"], ["a", "b", "c"], theta, trans)
    doc2, m2 = langid.label_words([text, "ab cd"], ["a", "b", "c"], theta, trans, most=5000)
    assert (doc == doc2).all() and np.abs(m - m2).max() < 0.35 and np.abs(m.mean(0) - m2.mean(0)).max() < 1e-3  # only words before a window's end lack what follows
    monkeypatch.setattr(suffix_dedup, "WINDOW", 700)
    starts = lambda found: sorted((d, x) for doc, a, b, _, _ in found for d, f, l in zip(doc, a, b) for x in range(f, l + 1))
    assert starts(suffix_dedup.runs([text.encode()[:5000], b"x" * 399, b"y" * 400], 400)) == [(0, i) for i in range(5000 - 399)] + [(2, 0)]


def test_a_long_periodic_text_and_hot_buckets(spark):
    """op9: one text of a repeated line, longer than a window, and a passage in many texts, above the size of a sub-bucket."""
    passage = stock(110, 1)
    texts = ["all work and no play " * 30_000] + [stock(30, 100 + i) + " " + passage + " " + stock(30, 300 + i) for i in range(60)] + [stock(200, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.select("doc_id", suffix_dedup.text_key(F.col("text")).alias("k"))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in keyed.join(suffix_dedup.remove_repeats(df, hot=8000), "k").collect())
    assert got == collections.Counter((i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in texts], 400)))


def test_hot_buckets_share_the_exchange_of_the_texts(spark):
    """op9: with hot buckets the texts are shuffled as often as without, once, and the same bytes go."""
    r, passage = random.Random(4), stock(110, 1)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) + " " + passage for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, found = [], []
    for hot in (1 << 40, 8000):
        before = spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
        found.append({x.k: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(df, hot=hot).collect()})
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        written.append(spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() - before)
    assert found[0] == found[1] and len(found[0]) == 120 and all(x[1] == 1 for x in found[0].values())
    assert written[0] > 2_000_000 and written[1] < 1.5 * written[0], written


# op3


def nearest_brute(rows, q, v, k=20):
    with np.errstate(over="ignore", invalid="ignore"):
        scores = [(-float((np.array(v) * np.array(x)).sum()), i) for i, x in rows if i != q]
    return [i for s, i in sorted(x for x in scores if not math.isnan(x[0]))[:k]]


def test_ann_corners(spark):
    """Equal distances everywhere, a repeated query row, and products beyond doubles."""
    tree = ann.VPTree(np.eye(1500), 96, 5)

    def depth(n):
        return 0 if isinstance(n, np.ndarray) else 1 + max(depth(n[3]), depth(n[4]))

    assert depth(tree.root) <= 6
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(120)]
    for data in (rows + [rows[40]] * 3, [(i, [x * 1e200 for x in v]) for i, v in rows]):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id") == 40, factor=1.0, k=20).collect():
            got[r.query_id].append((r.rank, r.vec_id))
        assert sorted(got[40]) == list(enumerate(nearest_brute(data, 40, dict(data)[40]), 1)) and got[40]


# op6


def test_embedding_links_of_huge_vectors(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-200, 1e-200], 1), (4, [1e200, -1e200], 1), (5, [1.7e308, 1.7e308], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


# op4


def test_style_tree_entropies(spark):
    """Low nodes, blocks and branches of a host, recomputed from its pages with plain counts."""
    r = random.Random(6)
    story = lambda i: "".join(f"<p>{stock(6, 50 * i + j)}</p>" for j in range(r.randint(1, 3)))
    page = lambda i: f'<body><div id="post-{i}"><div class="top-{i % 3}"><b>Site</b><p>{["Always", "Often"][i % 7 == 0]}</p></div><div class="text">{story(i)}<p>Sign up!</p></div><div class="foot"><ul><li>One<li>Two</ul><span>{i % 2}</span></div></div></body>'
    pages = [page(i) for i in range(24)]
    node, shown = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    block = collections.defaultdict(collections.Counter)
    for p in pages:
        styles, texts, kids = [], collections.defaultdict(list), collections.defaultdict(set)
        for path, w, s in html_extract.blocks(p, styles):
            texts[path, w].append(s)
        for path, w, children in styles:
            if w:
                kids[path].add(" ".join(children))
        for k, v in texts.items():
            node[k][" ".join(v)] += 1
            for s in set(v):
                block[k][s] += 1
        for k, v in kids.items():
            shown[k][tuple(sorted(v))] += 1

    def entropy(c):
        m = sum(c.values())
        return -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0

    value = {}
    for (path, w), c in node.items():
        e = entropy(c)
        value[path, w] = 0.75 * e + 0.25 * min(e, entropy(shown[path.rpartition("/")[0]]))
    low = {f"{p}@{w}" for (p, w), v in value.items() if v * w / 100 < 0.2 and sum(node[p, w].values()) >= 5}
    branches = set()
    for path, c in shown.items():
        below = [(k, v) for k, v in value.items() if k[0].startswith(path + "/")]
        if path.count("/") < 1 or sum(c.values()) < 5 or not below:
            continue
        m = {k: sum(node[k].values()) for k, _ in below}
        mean = sum(m[k] * v * k[1] / 100 for k, v in below) / sum(m.values())
        if 0.75 * mean + 0.25 * min(mean, entropy(c)) < 0.2 and max(v * k[1] / 100 for k, v in below if m[k] >= 5) < 0.2:
            branches.add(path)
    again = {(k, s) for k, c in block.items() for s, n in c.items() if f"{k[0]}@{k[1]}" not in low and sum(node[k].values()) >= 5 and (1 - math.log(n) / math.log(sum(node[k].values()))) * k[1] / 100 < 0.2}
    df = spark.createDataFrame([(i, f"http://a.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = html_extract.style_tree(df.withColumn("host", F.lit("a.org"))).first()
    assert set(got.low) == low and {b for b in got.branches if b.count("/") > 0} == branches and branches and low
    assert set(got.repeats) == {html_extract.digest(f"{k[0]}@{k[1]}", s) for k, s in again}
    texts = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert all("Sign up!" not in t and "Always" not in t and t.count("\n") in (0, 1, 2) and t for t in texts.values())
    far = {x.page_id: x.text for x in html_extract.extract(df, small=0).collect()}  # joined by host instead of broadcast
    assert far == texts


# op10


def test_genetic_packing_improves_on_best_fit():
    """Lengths that best fit packs badly: crossover gains bins, and so does a second epoch with another island's elite."""
    first = second = 0
    for seed in range(4):
        length = sorted(np.random.default_rng(seed).integers(300, 1030, 150).tolist(), reverse=True)
        fit = len(packing.best_fit(range(150), length, 2048))
        rng, other = np.random.default_rng(1), np.random.default_rng(2)
        a, b = packing.evolve([], length, 2048, 12, rng), packing.evolve([], length, 2048, 12, other)
        c = packing.evolve([*a, b[0]], length, 2048, 12, rng)
        assert len(c[0]) <= len(a[0]) <= fit and all(sorted(i for x in s for i in x) == list(range(150)) for s in (a[0], c[0]))
        first, second = first + fit - len(a[0]), second + len(a[0]) - len(c[0])
    assert first > 0 and second > 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage on all that the one before kept: toxic rows go, one of each class of near copies stays, repeats leave, and all is packed."""
    import corpus_pipeline

    r = random.Random(8)
    clean = [stock(90, i) for i in range(40)]
    near = clean[0].split(" ")
    near[45] = "other"
    passage = stock(110, 77)
    texts = clean + [clean[1], " ".join(near), stock(40, 501) + " " + passage, passage + " " + stock(40, 502), None, ""]
    toxic = [stock(60, 900 + i) + " scum " + stock(5, 950 + i) for i in range(25)]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), "x") for i, t in enumerate(texts + toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i >= len(texts))) for i in range(len(rows)) if r.random() < 0.9], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{name}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        kept.append(docs.collect())
    n = len(texts)
    assert {x.doc_id for x in kept[0]} == set(range(n)) and [len(x[0]) for x in kept[:4]] == [6] * 4
    assert {x.doc_id for x in kept[1]} == set(range(n)) - {40, 41}  # of copies the smallest doc_id
    before = {x.doc_id: (x.text or "").encode() for x in kept[1]}
    removed = {i: x[1] for i, x in zip(before, brute_repeats(list(before.values()), 400))}
    assert {x.doc_id: len(before[x.doc_id]) - len((x.text or "").encode()) for x in kept[2]} == removed and sum(v > 0 for v in removed.values()) == 2
    size = {x.doc_id: len((x.text or "").split()) for x in kept[2]}
    times = collections.Counter(x.doc_id for x in kept[3])
    assert set(times) <= set(size) and max(times.values()) <= 2 and abs(sum(size[i] * c for i, c in times.items()) - 1.5 * sum(size.values())) < 0.2 * 1.5 * sum(size.values())
    pieces = collections.Counter(x.doc_id for x in kept[4] if x.piece == 0)
    assert pieces == times
    none = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[1:]:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
