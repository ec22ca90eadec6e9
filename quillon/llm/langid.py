"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its letters' n-grams, its affixes and itself (the lexicon), hashed; labels
are the languages learned. Transitions are learned on training sequences that splice runs of words
from texts of different languages. Forward-backward over a whole text gives each word's label
probabilities; a text's language is the one with the largest mean, which is its score. Texts of more
than four million bytes are labelled in windows that begin with the 64 words before them, so that memory
is bounded; all their words count.

Fitting uses a bounded, seeded sample of labelled rows (`max_rows` for each language) in one task, by
AdaGrad on the sequences' log-likelihood; of a longer text one seeded part of `max_bytes` is taken. The
labels are all languages that occur, a catalogue. Only text is read for a prediction.

Defined cases: null text and text without letters are `und`, score 0; rows with null lang are not
learned from; without training rows all are `und`; repeated rows each give a row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, pieces, slices, small_batches
from .words import Words, groups

SIZE = 1 << 17
LETTER = re.compile(r"[^\W\d_]").search


def word_features(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in at, feature) of the words at, for all their features."""
    start, stop = w.start[at], w.stop[at]
    size = stop - start
    place, found = [], []

    def add(i, h):
        place.append(i), found.append((h & np.uint64(SIZE - 1)).astype(np.int64))

    i = np.arange(len(at))
    add(i, w.hash(start, stop, 100))
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(size >= n)
        add(long, w.hash(start[long], start[long] + n, n))
        add(long, w.hash(stop[long] - n, stop[long], 10 + n))
        count = size[long] - n + 1
        each = np.repeat(long, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        s = start[each] + offset
        add(each, w.hash(s, s + n, 20 + n))
    return np.concatenate(place), np.concatenate(found)


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of one occurrence of each word, and each word's place among these."""
    _, first, inverse = np.unique(w.hash(w.start, w.stop, 0), return_index=True, return_inverse=True)
    return first, inverse


class Emissions:
    """Scores (words, labels) of words: means over their features' weights. Words recur, so up to `most` keep theirs."""

    def __init__(self, theta: np.ndarray, most: int = 1 << 17):
        self.theta, self.most = theta, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, theta.shape[1]))

    def __call__(self, w: Words) -> np.ndarray:
        words, first, inverse = np.unique(w.hash(w.start, w.stop, 0), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, words)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == words[known]
        e = np.empty((len(words), self.theta.shape[1]))
        e[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        for s in range(0, len(new), 16384):
            part = new[s : s + 16384]
            i, f = word_features(w, first[part])
            n = np.maximum(np.bincount(i, minlength=len(part)), 1)
            e[part] = np.stack([np.bincount(i, weights=self.theta[f, k], minlength=len(part)) for k in range(self.theta.shape[1])], 1) / n[:, None]
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys, values = np.concatenate([self.keys, words[new]]), np.concatenate([self.values, e[new]])
            order = np.argsort(keys)[: self.most]
            self.keys, self.values = keys[order], values[order]
        return e[inverse]


def marginals(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over sequences that lie one after another; label probabilities of each word.

    All sequences advance together, longest first, so a step costs what it still has. pairs: gets the
    expected transitions."""
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    begin = (np.cumsum(sizes) - sizes)[order]
    p = np.exp(e - e.max(1, keepdims=True)) + 1e-12
    a = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(p), np.ones_like(p)
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), "left")  # sequences longer than t
    for t in range(steps):
        at = begin[: live[t]] + t
        x = p[at] if t == 0 else (alpha[at - 1] @ a) * p[at]
        alpha[at] = x / x.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        y = p[at + 1] * beta[at + 1]
        x = y @ a.T
        if pairs is not None:
            z = alpha[at][:, :, None] * a[None] * y[:, None, :]
            pairs += (z / z.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = x / x.sum(1, keepdims=True)
    m = alpha * beta
    return m / m.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: np.ndarray, n_labels: int, *, rounds: int = 30, rate: float = 0.5, l2: float = 1e-6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transitions) of lower-cased texts whose words all bear the text's label."""
    w = Words(texts)
    rng = np.random.default_rng(seed)
    first, inverse = distinct(w)
    i, f = word_features(w, first)
    count = np.maximum(np.bincount(i, minlength=len(first)), 1)
    # runs of 5 to 60 words, spliced at random into sequences of about 240
    cut = np.flatnonzero(np.r_[True, w.doc[1:] != w.doc[:-1]] | (rng.random(len(w.doc)) < 1 / 30)) if len(w.doc) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(w.doc)])
    shuffle = rng.permutation(len(cut))
    order = np.concatenate([np.arange(cut[k], cut[k] + size[k]) for k in shuffle]) if len(cut) else np.zeros(0, np.int64)
    word, gold = inverse[order], labels[w.doc[order]]
    sizes = np.diff(np.r_[np.arange(0, len(word), 240), len(word)])
    theta, trans = np.zeros((SIZE, n_labels)), np.zeros((n_labels, n_labels))
    g2, t2 = np.full(theta.shape, 1e-8), np.full(trans.shape, 1e-8)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(sizes) - 1] = False
    seen = np.zeros_like(trans)
    np.add.at(seen, (gold[inside], gold[np.flatnonzero(inside) + 1]), 1)
    for _ in range(rounds):
        e = np.stack([np.bincount(i, weights=theta[f, k], minlength=len(first)) for k in range(n_labels)], 1) / count[:, None]
        pairs = np.zeros_like(trans)
        m = marginals(e[word], sizes, trans, pairs)
        m[np.arange(len(m)), gold] -= 1
        per_word = np.stack([np.bincount(word, weights=m[:, k], minlength=len(first)) for k in range(n_labels)], 1) / (len(word) * count[:, None])
        g = np.stack([np.bincount(f, weights=per_word[i, k], minlength=SIZE) for k in range(n_labels)], 1) + l2 * theta
        g2 += g * g
        theta -= rate * 10 * g / np.sqrt(g2)
        gt = (pairs - seen) / len(word)
        t2 += gt * gt
        trans -= rate * gt / np.sqrt(t2)
    return theta, trans


def train(docs: DataFrame, *, max_rows: int = 300, max_bytes: int = 1 << 16, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learns from docs(doc_id, text, lang): max_rows rows for each language."""
    small_batches(docs.sparkSession)
    space = 1 << 40
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(space)).alias("h")
    known = docs.select("text", "lang", key).where("text is not null and lang is not null")
    counts = known.groupBy("lang").count().collect()
    langs = sorted(r.lang for r in counts)
    if not langs:
        return [], np.zeros((SIZE, 0)), np.zeros((0, 0))
    # the hash of each language's last row in the sample, found without the texts among about 4 * max_rows small hashes
    limits = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 4 * max_rows / r["count"]) * space)) for r in counts], "lang string, most long")
    small = known.select("lang", "h").join(F.broadcast(limits), "lang").where("h < most")
    cuts = small.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("h")).select("lang", F.element_at("h", F.least(F.size("h"), F.lit(max_rows))).alias("last"))
    sample = known.join(F.broadcast(cuts), "lang").where("h <= last").select("text", "lang")  # one row for each language

    def run(batches):
        texts, y = [], []
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                data = t.lower().encode("utf-8", "surrogatepass")
                parts = [x for _, x in pieces(data, max_bytes)]
                texts.append(parts[zlib.crc32(data) % len(parts)])
            y += [langs.index(v) for v in b.column(1).to_pylist()]
        theta, trans = fit(texts, np.array(y), len(langs))
        yield pa.RecordBatch.from_arrays([pa.array([theta.astype("<f4").tobytes()]), pa.array([trans.astype("<f8").tobytes()])], names=["theta", "trans"])

    r = sample.repartition(1).mapInArrow(gives_back(run), "theta binary, trans binary").first()
    n = len(langs)
    return langs, np.frombuffer(bytes(r.theta), "<f4").reshape(SIZE, n), np.frombuffer(bytes(r.trans), "<f8").reshape(n, n)


def label_words(texts: list[str], langs: list[str], theta: np.ndarray | Emissions, trans: np.ndarray, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(document, label probabilities) of every word of texts, in order."""
    emissions = theta if isinstance(theta, Emissions) else Emissions(theta)
    docs, found = [np.zeros(0, np.int64)], [np.zeros((0, len(langs)))]
    for places, skips, data in groups(texts, most, 64):
        w = Words(data)
        if not len(w.doc) or not langs:
            continue
        sizes = np.bincount(w.doc, minlength=len(data))
        m = marginals(emissions(w), sizes[sizes > 0], trans)
        new = w.start - w.begin[w.doc] >= skips[w.doc]
        docs.append(places[w.doc[new]]), found.append(m[new])
    return np.concatenate(docs), np.concatenate(found)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs(doc_id, text) as (doc_id, lang_pred, score)."""
    small_batches(docs.sparkSession)
    langs, theta, trans = model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        emissions = Emissions(theta)
        for b in batches:  # whole: all their sequences advance together
            texts = [t or "" for t in b.column(1).to_pylist()]
            doc, m = label_words(texts, langs, emissions, trans)
            n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
            mean = np.stack([np.bincount(doc, weights=m[:, k], minlength=len(texts)) for k in range(len(langs))], 1) / n[:, None] if langs else np.zeros((len(texts), 0))
            pred, score = [], []
            for t, v in zip(texts, mean):
                known = len(v) and v.max() > 0 and LETTER(t)
                pred.append(langs[int(v.argmax())] if known else "und")
                score.append(min(1.0, float(v.max())) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(gives_back(run), f"doc_id {kind}, lang_pred string, score double")
