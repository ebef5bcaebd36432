"""Quality by attention-based multiple-instance learning over passages, in numpy.

A text is a bag of passages of ``WIDTH`` words. A passage's input is the sum of its words' vectors (an embedding of the whole
word and one of its character trigrams, both by hash), each word once, over the number of its words, repeats included, the
mean of their surface figures, and how they repeat. A hidden
layer encodes every passage; gated attention (a hyperbolic tangent times a sigmoid) weighs them within their text; the
weighted representation gives the text's logit. Only labels of documents are learned from, so which passages speak for a
label is found by the attention.

The network is fitted on the driver to a bounded sample of labelled rows (``PER_CLASS`` documents of each label), each with
all of its passages, and sent to the executors, which encode every passage of every whole text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .toxicity import sigmoid, word_hashes

#: Words of a passage; rows of the word and trigram tables, length of their vectors; sizes of the layers.
WIDTH, WORDS, GRAMS, SIZE, HIDDEN, GATES = 64, 1 << 14, 1 << 13, 8, 16, 8
#: Documents of each label that are learned, and how often; rate, decay, share of words left out in a step.
PER_CLASS, EPOCHS, BATCH, RATE, DECAY, DROPPED = 400, 24, 32, 0.01, 0.3, 0.5
THRESHOLD = 0.5
#: Words whose inputs a worker keeps.
KEPT = 300_000
SURFACE = 8


def surface(words: list[str]) -> np.ndarray:
    """Of each word, by its UTF-8 bytes: shares of upper-case letters, digits and other signs of ASCII, whether it is in upper
    case, has several signs, no letter, ends with a sign; its length."""
    raw = [w.encode("utf-8", "replace") for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(n) - n
    if not len(data):
        return np.zeros((len(words), SURFACE), np.float32)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    sign = (data < 128) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    count = lambda x: np.add.reduceat(x.astype(np.int32), np.minimum(starts, len(data) - 1)) * (n > 0)
    u, d, s, ascii_letters = count(upper), count(digit), count(sign), count((data | 32 >= 97) & (data | 32 <= 122))
    size = np.maximum(1, n)
    last = sign[np.maximum(0, starts + n - 1)] & (n > 0)
    figures = (u / size, d / size, s / size, (u == ascii_letters) & (u > 1), s > 1, (d + s == n) & (n > 0), last, np.minimum(n, 24) / 24)
    return np.stack([np.asarray(f, np.float32) for f in figures], axis=1)


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        put = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        self.p = {"words": put(WORDS, SIZE, scale=0.1), "grams": put(GRAMS, SIZE, scale=0.1)}
        self.p |= {"w": put(SIZE + SURFACE + 3, HIDDEN, scale=0.4), "b": np.zeros(HIDDEN, np.float32)}
        self.p |= {"v": put(HIDDEN, GATES, scale=0.3), "g": put(HIDDEN, GATES, scale=0.3), "a": put(GATES, scale=0.3)}
        self.p |= {"u": put(HIDDEN, scale=0.3), "u0": np.zeros(1, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def vectors(self, words: list[str], kept: np.ndarray | None = None):
        """Vectors of distinct words, and what leads back to the tables; kept: 0 for words whose own vector is left out."""
        if not words:
            empty = np.empty(0, np.int64)
            return np.zeros((0, SIZE), np.float32), (empty, np.zeros((0, 1), np.float32), empty, empty, np.zeros(0, np.float32))
        row, grams, firsts = word_hashes(words)
        counts = np.diff(np.append(firsts, len(grams)))
        scale = (1 / np.sqrt(counts)).astype(np.float32)
        kept = np.ones((len(words), 1), np.float32) if kept is None else kept
        x = self.p["words"][row] * kept + np.add.reduceat(self.p["grams"][grams], firsts) * scale[:, None]
        return x, (row, kept, grams, np.repeat(np.arange(len(words)), counts), np.repeat(scale, counts))

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int, keep: list | None = None) -> np.ndarray:
        """Logits of n texts from their passages' inputs; doc: each passage's text, in order, all texts have one."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["g"])
        score = (t * g) @ p["a"]
        starts = np.searchsorted(doc, np.arange(n))
        weight = np.exp(score - np.maximum.reduceat(score, starts)[doc])
        weight = weight / np.add.reduceat(weight, starts)[doc]
        z = np.add.reduceat(weight[:, None] * h, starts)
        if keep is not None:
            keep += [h, t, g, weight, z, starts]
        return z @ p["u"] + p["u0"][0]

    def gradients(self, x: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the layers, and of the passages' inputs."""
        p, keep, n = self.p, [], len(labels)
        prob = sigmoid(self.forward(x, doc, n, keep))
        h, t, g, weight, z, starts = keep
        loss = float(-np.mean(np.log(np.where(labels == 1, prob, 1 - prob) + 1e-9)))
        dlogit = (prob - labels) / n
        dz = dlogit[doc, None] * p["u"]
        dweight = (h * dz).sum(axis=1)
        dscore = weight * (dweight - np.add.reduceat(weight * dweight, starts)[doc])
        dgate = dscore[:, None] * p["a"]
        dt, dg = dgate * g * (1 - t**2), dgate * t * g * (1 - g)
        dh = weight[:, None] * dz + dt @ p["v"].T + dg @ p["g"].T
        before = dh * (1 - h**2)
        out = {"u": z.T @ dlogit, "u0": np.array([dlogit.sum()]), "a": (t * g).T @ dscore, "v": h.T @ dt, "g": h.T @ dg}
        out |= {"w": x.T @ before, "b": before.sum(axis=0)}
        return loss, out, before @ p["w"].T

    def adam(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, v in grads.items():
            m, s = self.moments[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-7)
            if v.ndim > 1:
                self.p[k] *= 1 - rate * DECAY


def summed(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Rows of values, added up by index."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        place, starts = np.unique(index[order], return_index=True)
        out[place] = np.add.reduceat(values[order], starts)
    return out


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of so many words: each passage's text, and its first word counted over all; a text of none has one passage."""
    many = np.maximum(1, -(-sizes // WIDTH))
    doc = np.repeat(np.arange(len(sizes)), many)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, (np.cumsum(sizes) - sizes)[doc] + WIDTH * within


class Passages:
    """Passages of texts whose words are numbers: each passage's text (``doc``) and words (``count``), each word's passage
    (``of_word``) and whether it is the first of its like there (``fresh``), and how the words of each passage repeat: shares
    of words like the one before, of words met before in the passage, log of their number."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray):
        self.doc, first = passages(sizes)
        self.count = np.minimum(first + WIDTH, np.cumsum(sizes)[self.doc]) - first
        self.of_word = np.repeat(np.arange(len(self.doc)), self.count)
        key = self.of_word * (int(index.max(initial=0)) + 1) + index
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.fresh = np.ones(len(index), bool)
        self.fresh[order[1:][key[1:] == key[:-1]]] = False
        like = np.flatnonzero((index[1:] == index[:-1]) & (self.of_word[1:] == self.of_word[:-1]))
        share = lambda at: np.bincount(at, minlength=len(self.doc)) / np.maximum(1, self.count)
        figures = share(self.of_word[like]), share(self.of_word[~self.fresh]), np.log1p(self.count) / np.log1p(WIDTH)
        self.repeats = np.stack(figures, axis=1).astype(np.float32)

    def inputs(self, vectors: np.ndarray, look: np.ndarray) -> np.ndarray:
        """Passages' inputs from the vectors and the surface figures of their words."""
        sums = np.zeros((len(self.count), SIZE + SURFACE), np.float32)
        full = np.flatnonzero(self.count)
        if len(full):
            rows = np.concatenate([vectors * self.fresh[:, None], look], axis=1)
            sums[full] = np.add.reduceat(rows, (np.cumsum(self.count) - self.count)[full]) / self.count[full, None]
        return np.concatenate([sums, self.repeats], axis=1)


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to whole texts, all passages of each; without texts it stays as it began."""
    net, rng = Network(seed), np.random.default_rng(seed)
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in (t or "").split()), np.int64) for t in texts]
    words, labels = list(ids), np.asarray(labels)
    look = surface(words)
    total = epochs * -(-len(docs) // BATCH)
    for _ in range(epochs if docs else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(docs[i]) for i in part])
            used, index = np.unique(np.concatenate([docs[i] for i in part]), return_inverse=True)
            bags = Passages(index, sizes)
            kept = (rng.random((len(used), 1)) >= DROPPED).astype(np.float32)
            x, (row, kept, grams, word, scale) = net.vectors([words[i] for i in used], kept)
            _, grads, dx = net.gradients(bags.inputs(x[index], look[used][index]), bags.doc, labels[part])
            dword = (dx[:, :SIZE] / np.maximum(1, bags.count)[:, None])[bags.of_word[bags.fresh]]
            dword = summed(dword, index[bags.fresh], len(used))
            grads["words"] = summed(dword * kept, row, WORDS)
            grads["grams"] = summed(dword[word] * scale[:, None], grams, GRAMS)
            net.adam(grads, RATE * (1 + np.cos(np.pi * net.steps / total)) / 2)
    return net


class Scorer:
    """Scores whole texts; keeps the inputs of words."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.vectors, self.look = np.zeros((0, SIZE), np.float32), np.zeros((0, SURFACE), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text, from all of its passages."""
        if not texts:
            return np.empty(0)
        docs = [(t or "").split() for t in texts]
        new = list({w: None for words in docs for w in words if w not in self.ids})
        if len(self.ids) + len(new) > KEPT:
            self.clear()
            new = list(dict.fromkeys(w for words in docs for w in words))
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.vectors = np.concatenate([self.vectors, self.net.vectors(new)[0]])
            self.look = np.concatenate([self.look, surface(new)])
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        index = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs)), np.int64, sizes.sum())
        bags = Passages(index, sizes)
        return sigmoid(self.net.forward(bags.inputs(self.vectors[index], self.look[index]), bags.doc, len(docs)))


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: whether crc32 of the id as text is 1 modulo 3; such rows' labels are never learned."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """A network fitted to at most ``per_class`` labelled documents of each label, those first by a hash of their id.

    Rows without id or label, and held-out ones, aren't learned; of rows of one id, the least text is; an id with both labels
    counts as low; without any rows the network stays as it began. The sample holds more of the rarer label than
    there is, so the logits are moved back by what that adds to the odds.
    """
    known = held_out(labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")).where("not held_out")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("at", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("quality") == y).orderBy("at", "doc_id").limit(per_class).collect() for y in (0, 1)]
    label = {r.doc_id: r.quality for rows in chosen for r in rows}
    own = docs.where(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = sorted((r.doc_id, r.text or "") for r in own.collect()) if label else []
    net = train([t for _, t in texts], [label[i] for i, _ in texts])
    all_rows = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if all(chosen):
        net.p["u0"] = net.p["u0"] + np.float32(np.log(all_rows[1] / all_rows[0]) - np.log(len(chosen[1]) / len(chosen[0])))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Adds ``score`` (0 to 1) to each row. Null and empty texts have a score too, that of a passage of no words; all other
    columns are kept, one named score is replaced. Equal texts have equal scores, all passages of very long texts are
    encoded, an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        model = Network.__new__(Network)
        model.p = sent.value
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(part) for part in slices(batch.column("text"))] if len(batch) else [np.empty(0)]
            names = [n for n in batch.schema.names if n != "score"]
            made = pa.array(np.concatenate(scores), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, "score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score"]
    return docs.mapInArrow(run, ", ".join([*kept, "score double"]))


def op11_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: every document's score, and whether it is good. Rows come back as often as they came, also those without
    id or text; without usable labels the network scores as it began; an empty table gives an empty table."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return held_out(scored).select("doc_id", "held_out", "score", predicted.alias("predicted"))
