"""Toxicity: a linear-chain conditional random field marks toxic words; documents score by its marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import grams as G
from tidemark.llm.common import table, text_of

CUT = 0.3
SAMPLE_TOXIC = 1000  # labelled documents of each kind that the model is fitted on
SAMPLE_CLEAN = 4000
SAMPLE_CHARS = 20_000  # longer documents are not in the sample
CHAIN_DOCS = 300  # of each kind, with CHAIN_WORDS at most, for the weights of the chain
CHAIN_WORDS = 800
MAX_FEATURES = 512
MIN_DOCS = 4
MIN_RATIO = 10.0
PREFIXES = (4, 5, 6, 7)  # bytes
SPAN_CUT = 0.5

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))

SCORED = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("chances", T.ArrayType(T.DoubleType())),
])


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def token_features(data: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its first bytes; zero where the word is no longer than that."""
    letters = np.frombuffer(data, np.uint8)
    out = [h]
    lengths = ends - starts
    sums = np.zeros(len(h), np.uint64)
    power = G.powers(max(PREFIXES))
    for k in range(max(PREFIXES)):
        at = np.minimum(starts + k, max(len(letters) - 1, 0))
        sums = sums + G._RANDOM[letters[at]] * power[k] if len(h) else sums
        if k + 1 in PREFIXES:
            out.append(np.where(lengths > k + 1, G.mix(sums + np.uint64((k + 1) << 40)), np.uint64(0)))
    return out


def tokens(texts: list[bytes]):
    data, h, s, e, first = G.joined_words(texts)
    return token_features(data, h, s, e), s, e, first


@dataclass(frozen=True)
class Model:
    """Features by hash with their weights, the chain, and the logistic score of a document."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    moves: tuple[float, float, float]  # into the toxic state, out of it, staying in it; staying out is 0
    score: np.ndarray
    prior: float

    def emissions(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words with any feature, and their weights."""
        total = np.zeros(len(hashes[0]))
        hit = np.zeros(len(total), bool)
        if len(self.features):
            bitmap = np.zeros(1 << 16, bool)
            bitmap[self.features >> np.uint64(48)] = True
            for h in hashes:
                maybe = np.flatnonzero(bitmap[h >> np.uint64(48)])
                at = np.searchsorted(self.features, h[maybe]) % len(self.features)
                same = self.features[at] == h[maybe]
                total[maybe[same]] += self.weights[at[same]]
                hit[maybe[same]] = True
        return np.flatnonzero(hit), total[hit]

    def chances(self, places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Forward-backward marginals of the toxic state at ``places`` of a text of ``n`` words.

        Words without features are alike, so a stretch of them is a power of one matrix.
        """
        step = np.exp(np.array([[0.0, self.moves[0]], [self.moves[1], self.moves[2]]]))
        plain = step * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(plain)
        top = int(np.argmax(values.real))
        values, vectors = values.real / values.real[top], vectors.real
        inverse = np.linalg.inv(vectors)
        stretch = lambda k: (vectors * values**k) @ inverse
        gaps = np.diff(np.concatenate(([-1], places, [n]))) - 1
        forward, a = [], np.array([1.0, 0.0])  # as if a clean word stood before the first
        for gap, w in zip(gaps, weights):
            a = a @ stretch(gap) @ (step * np.array([1.0, np.exp(self.bias + w)]))
            a = a / a.sum()
            forward.append(a)
        out = np.empty(len(weights))
        b = stretch(gaps[-1]) @ np.ones(2)
        for k in range(len(weights) - 1, -1, -1):
            both = np.maximum(forward[k] * b, 0)
            out[k] = both[1] / both.sum()
            b = stretch(gaps[k]) @ ((step * np.array([1.0, np.exp(self.bias + weights[k])])) @ b)
            b = b / b.sum()
        return out

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[int], list[float]]]:
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        plain = [t.translate(_LETTERS) for t in encoded]
        out = []
        for a, b in G.groups(plain):
            hashes, starts, ends, first = tokens(plain[a:b])
            places, weights = self.emissions(hashes)
            offset = np.cumsum([0] + [len(t) + 1 for t in plain[a:b]])
            bounds = np.searchsorted(places, first)
            for d in range(b - a):
                lo, hi = bounds[d], bounds[d + 1]
                n = int(first[d + 1] - first[d])
                here = places[lo:hi]
                chances = self.chances(here - first[d], weights[lo:hi], n) if hi > lo else np.empty(0)
                value = self.document(chances, hashes[0][here], n)
                bad = chances >= SPAN_CUT
                text = encoded[a + d]
                s, e = (code_points(text, edges[here[bad]] - offset[d]) for edges in (starts, ends))
                out.append((value, s, e, chances[bad].tolist()))
        return out

    def document(self, chances: np.ndarray, words: np.ndarray, n: int) -> float:
        if not len(self.score):
            return self.prior
        z = float(self.score @ summary(chances, words, n))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def summary(chances: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """What the score of a document sees: any toxic word, how many, how many different ones, how dense."""
    if not len(chances):
        return np.array([1.0, 0, 0, 0, 0])
    none = np.log1p(-np.minimum(chances, 1 - 1e-9)).sum()
    _, first = np.unique(words, return_index=True)
    return np.array([1.0, 1 - np.exp(none), np.log1p(chances.sum()), np.log1p(chances[first].sum()), np.log1p(100 * chances.sum() / max(n, 1))])


def code_points(text: bytes, places: np.ndarray) -> list[int]:
    """How many code points stand before each place of a text in bytes: one count for all places."""
    if not len(places):
        return []
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))[places].tolist()


def pick_features(hashes: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that stand in many more toxic than clean documents, the strongest first, at most ``MAX_FEATURES``."""
    n_bad, n_good = max(toxic.sum(), 1), max((~toxic.astype(bool)).sum(), 1)
    names, worth = [], []
    for h in hashes:  # one kind of feature at a time: the arrays of a kind are all that is held
        order = np.argsort(h, kind="stable")  # documents stay in order
        name, of = h[order], doc[order]
        once = np.append(True, (name[1:] != name[:-1]) | (of[1:] != of[:-1])) & (name != 0) if len(h) else np.empty(0, bool)
        name, of = name[once], of[once]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.empty(0, np.int64)
        bad = np.add.reduceat(toxic[of], first) if len(first) else np.empty(0)
        good = np.diff(np.append(first, len(name))) - bad
        ratio = np.log((bad + 1e-9) / n_bad / ((good + 1) / n_good))
        strong = (bad >= MIN_DOCS) & (ratio >= np.log(MIN_RATIO))
        names.append(name[first][strong])
        worth.append((bad * ratio)[strong])
    names, worth = np.concatenate(names), np.concatenate(worth)
    return np.sort(names[np.argsort(-worth, kind="stable")[:MAX_FEATURES]])


def fit_chain(features: np.ndarray, hashes: list[np.ndarray], doc: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, tuple]:
    """Weights of the chain by gradient ascent on the likelihood of the labelled words.

    All chains advance together: at step ``t`` those with more than ``t`` words.
    """
    n_docs = int(doc.max()) + 1 if len(doc) else 0
    lengths = np.bincount(doc, minlength=n_docs)
    by_length = np.argsort(-lengths, kind="stable")
    first = np.cumsum(lengths) - lengths
    alive = [int((lengths > t).sum()) for t in range(int(lengths.max()))]
    steps = [first[by_length[:k]] + t for t, k in enumerate(alive)]
    pairs = []
    for h in hashes:
        at = np.searchsorted(features, h) % len(features)
        word = np.flatnonzero(features[at] == h)
        pairs.append((word, at[word]))
    word = np.concatenate([p[0] for p in pairs])
    feature = np.concatenate([p[1] for p in pairs])
    k = len(features)
    theta = np.zeros(k + 4)  # weights, bias, in, out, stay
    theta[k] = -3.0
    seen = np.zeros(k + 4)
    seen[:k] = np.bincount(feature, weights=label[word], minlength=k)
    seen[k] = label.sum()
    for t in range(1, len(steps)):
        a, b = label[steps[t - 1][: alive[t]]], label[steps[t]]
        seen[k + 1 :] += [((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()]
    speed = np.zeros(k + 4)
    scale = np.maximum(np.bincount(feature, minlength=k), 1)
    norm = np.concatenate((scale, [max(label.sum(), 1) * 4] * 4)).astype(float)
    for _ in range(rounds):
        unary = np.full(len(doc), theta[k])
        np.add.at(unary, word, theta[feature])
        up = np.exp(np.clip(unary, -30, 30))
        go = np.exp(theta[k + 1 :])
        move = np.array([[1.0, go[0]], [go[1], go[2]]])
        f = np.empty((len(doc), 2))
        start = steps[0]
        f[start] = np.stack([np.ones(len(start)), go[0] * up[start]], 1)
        f[start] /= f[start].sum(1, keepdims=True)
        for t in range(1, len(steps)):
            now = steps[t]
            v = f[steps[t - 1][: alive[t]]] @ move
            v[:, 1] *= up[now]
            f[now] = v / v.sum(1, keepdims=True)
        back = np.ones((n_docs, 2))
        marginal = np.empty(len(doc))
        moves = np.zeros(3)
        for t in range(len(steps) - 1, -1, -1):
            now = steps[t]
            b = back[: alive[t]]
            both = f[now] * b
            marginal[now] = both[:, 1] / both.sum(1)
            w = b * np.stack([np.ones(len(now)), up[now]], 1)
            if t:
                before = f[steps[t - 1][: alive[t]]]
                joint = before[:, :, None] * move[None] * w[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                moves += [joint[:, 0, 1].sum(), joint[:, 1, 0].sum(), joint[:, 1, 1].sum()]
                v = w @ move.T
                back[: alive[t]] = v / v.sum(1, keepdims=True)
        expected = np.concatenate((np.bincount(feature, weights=marginal[word], minlength=k), [marginal.sum()], moves))
        step = (seen - expected) / norm - 0.002 * theta
        speed = 0.8 * speed + step
        theta = np.clip(theta + np.clip(speed, -1, 1), -12, 12)
    return theta[:k], float(theta[k]), tuple(theta[k + 1 :].tolist())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * np.append(0, w[1:])
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w


def fit(rows: list[tuple[str, int]], prior: float) -> Model:
    """A model from labelled texts. With one class only, every text scores the share of that class."""
    nothing = Model(np.empty(0, np.uint64), np.empty(0), 0.0, (0.0, 0.0, 0.0), np.empty(0), prior)
    rows = sorted(set(rows))
    toxic = np.array([r[1] for r in rows], float)
    if not len(rows) or toxic.min() == toxic.max():
        return nothing
    texts = [r[0].encode("utf-8", "surrogatepass").translate(_LETTERS) for r in rows]
    hashes, _, _, first = tokens(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    features = pick_features(hashes, doc, toxic)
    if not len(features):
        return nothing
    # the label of a word: it has such a feature, and its document is toxic
    marked = np.zeros(len(doc), bool)
    for h in hashes:
        marked |= np.isin(h, features)
    label = marked & (toxic[doc] > 0)
    sizes = np.diff(first)
    short = [np.flatnonzero((toxic == v) & (sizes <= CHAIN_WORDS) & (sizes > 0)) for v in (0, 1)]
    # clean documents that hold a feature teach most, so they come first
    hits = np.bincount(doc, weights=marked, minlength=len(texts))
    chosen = np.concatenate([s[np.argsort(hits[s] == 0, kind="stable")][:CHAIN_DOCS] for s in short])
    take = np.isin(doc, chosen)
    number = np.full(len(texts), -1)
    number[np.sort(chosen)] = np.arange(len(chosen))
    weights, bias, moves = fit_chain(features, [h[take] for h in hashes], number[doc[take]], label[take].astype(float))
    model = Model(features, weights, bias, moves, np.empty(0), prior)
    places, w = model.emissions(hashes)
    bounds = np.searchsorted(places, first)
    x = []
    for d in range(len(texts)):
        here = places[bounds[d] : bounds[d + 1]]
        n = int(sizes[d])
        x.append(summary(model.chances(here - first[d], w[bounds[d] : bounds[d + 1]], n) if len(here) else np.empty(0), hashes[0][here], n))
    score = fit_logistic(np.array(x), toxic)
    share = toxic.mean()
    score[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(features, weights, bias, moves, score, prior)


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> Model:
    """Fits on a sample of at most ``n_toxic`` and ``n_clean`` labelled documents, by hash of their id.

    The sample bounds what the driver holds; held-out rows are left out before anything is drawn. Of the
    rows of a sampled id one is taken, with the least text, however often the id repeats.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return fit([], 0.0)
    prior = counts.get(1, 0) / total
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [known.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, n_toxic), (0, n_clean))]
    sample = sample[0].unionByName(sample[1]).select("doc_id", F.col("toxic").alias("__toxic"))
    rows = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(sample), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__toxic").alias("toxic"))
    return fit([(r["text"], int(r["toxic"])) for r in once.orderBy("doc_id").collect()], prior)


def score_column(spark: SparkSession, model: Model):
    """A function of a text column: score, and offsets (code points) and chances of offending words."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCORED)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(sent.value.scores(texts.tolist()), columns=["score", "starts", "ends", "chances"])

    return scored


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` as ``row``, with ``toxicity``: score and offending spans of every whole text.

    Words are runs of letters; their features are the word and its beginnings, and nothing but the
    text is looked at. Null or empty text has no toxic word and scores as such. Labels of one document
    that differ count as toxic; labels without a document are ignored. Where the labels are all of
    one kind, or none, every text scores the share of toxic labels. All columns stay in ``row``.
    """
    model = train(docs, labels)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.select("row", score_column(docs.sparkSession, model)(F.coalesce("row.text", F.lit(""))).alias("toxicity"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    return score_toxicity(docs, labels).where(F.col("toxicity.score") < cut).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "toxicity.score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
