"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of an embedding of the whole word and one of its character trigrams, both by hash. Windows of
``WIDTH`` words, each starting ``STEP`` after the one before and the last ending with the text, are read in both
directions; attention pools the states of a window into a logit. A document's logit is its highest window's, since one
toxic passage is enough; in training, a smooth maximum stands for it.

The network is fitted on the driver on a bounded sample of labelled rows (``PER_CLASS`` documents of each label) and sent
to the executors, which score every window of every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

WIDTH, STEP = 48, 32
WORDS, GRAMS, SIZE, HIDDEN = 1 << 14, 1 << 13, 12, 8
#: Bounds of training: documents of each label, epochs.
PER_CLASS, EPOCHS = 400, 10
#: Against learning single words by heart: share of words whose own vector is left out of a step (their trigrams stay),
#: decay of the parameters; the rate of learning falls to nothing along a cosine in the second half.
DROPPED, DECAY, RATE = 0.5, 1.0, 0.012
THRESHOLD = 0.3
#: Words whose inputs a worker keeps, and windows that it reads at once.
KEPT, BATCH = 300_000, 2048


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row of the word table; the rows of all words' trigrams and where each word's begin."""
    raw = [b"^" + w.encode("utf-8", "replace") + b"$\0\0" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = np.ones(len(data) - 2, bool)  # what begins at the padding of a word would reach into the next
    own[ends - 1] = own[ends - 2] = False
    with np.errstate(over="ignore"):
        mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) * own
        grams = (mixed >> np.uint32(8)).astype(np.int64) % GRAMS
        place = (np.arange(len(mixed)) - np.repeat(starts, sizes) + 1).astype(np.uint32)
        whole = np.add.reduceat(mixed * (place * np.uint32(0x27D4EB2F) | np.uint32(1)), starts)
    inside = own.copy()  # a trigram begins at all but the last two signs of a word
    inside[ends - 3] = inside[ends - 4] = False
    counts = sizes - 4
    # "^$" has no trigram: it gets the one of its two signs and the padding
    none = counts == 0
    inside[starts[none]] = True
    counts[none] = 1
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return (whole >> np.uint32(7)).astype(np.int64) % WORDS, grams[inside], firsts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward passes; arrays over windows have time first."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        put = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        self.p = {"words": put(WORDS, SIZE, scale=0.1), "grams": put(GRAMS, SIZE, scale=0.1)}
        for d in "fb":
            self.p[f"x{d}"] = put(SIZE, 3 * HIDDEN, scale=0.4)
            self.p[f"h{d}"] = put(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"a": put(2 * HIDDEN, HIDDEN, scale=0.3), "a0": np.zeros(HIDDEN, np.float32)}
        self.p |= {"v": put(HIDDEN, scale=0.5), "u": put(2 * HIDDEN, scale=0.5), "u0": np.array([-1.0], np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps, self.rng, self.rate = 0, None, RATE

    def inputs(self, words: list[str], rng: np.random.Generator | None = None):
        """Input vectors of distinct words, and what leads back to the tables; rng: draws the words that are left out."""
        row, grams, firsts = word_hashes(words)
        counts = np.diff(np.append(firsts, len(grams)))
        scale = (1 / np.sqrt(counts)).astype(np.float32)
        kept = np.ones((len(words), 1), np.float32) if rng is None else (rng.random((len(words), 1)) >= DROPPED).astype(np.float32)
        x = self.p["words"][row] * kept + np.add.reduceat(self.p["grams"][grams], firsts) * scale[:, None]
        return x, (row, kept, grams, np.repeat(np.arange(len(words)), counts), np.repeat(scale, counts))

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the inputs add to the gates of both directions."""
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def run(self, d: str, gates: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States of one direction; gates (time, windows, 3 * HIDDEN); mask: which places hold a word (None: all)."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        w, n = self.p[f"h{d}"], 2 * HIDDEN
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            by_state = h @ w
            rz = sigmoid(gates[t, :, :n] + by_state[:, :n])
            new = np.tanh(gates[t, :, n:] + rz[:, :HIDDEN] * by_state[:, n:])
            after = new + rz[:, HIDDEN:] * (h - new)
            if mask is not None:
                after = np.where(mask[t][:, None], after, h)
            if keep is not None:
                keep.append((t, h, by_state[:, n:], rz, new))
            h = out[t] = after
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows from their states, by attention."""
        hidden = np.tanh(states @ self.p["a"] + self.p["a0"])
        score = hidden @ self.p["v"]
        if mask is not None:
            score = np.where(mask, score, -1e4)
        weight = np.exp(score - score.max(axis=0))
        if mask is not None:
            weight = weight * mask
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep += [hidden, weight, pooled]
        return pooled @ self.p["u"] + self.p["u0"][0]

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows (time, windows) of rows of gates."""
        return self.pool(np.concatenate([self.run(d, gates[d][index], mask) for d in "fb"], axis=2), mask)

    def learn(self, words: list[str], index: np.ndarray, mask: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> float:
        """One step of Adam on documents given as windows; doc: each window's document (in order). Returns the loss."""
        x, back = self.inputs(words, self.rng)
        gates, kept, states, g = self.gates(x), {"f": [], "b": []}, [], {}
        for d in "fb":
            states.append(self.run(d, gates[d][index], mask, kept[d]))
        states, pooling = np.concatenate(states, axis=2), []
        z = self.pool(states, mask, pooling)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        top = np.maximum.reduceat(z, starts)
        share = np.exp(3 * (z - top[doc]))
        total = np.add.reduceat(share, starts)
        of_doc = top + np.log(total) / 3
        p = sigmoid(of_doc)
        loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-9))
        dz = ((p - labels) / len(labels))[doc] * share / total[doc]
        hidden, weight, pooled = pooling
        g["u"], g["u0"] = pooled.T @ dz, np.array([dz.sum()])
        dpooled = dz[:, None] * self.p["u"]
        dstates = weight[:, :, None] * dpooled
        dweight = np.einsum("tbh,bh->tb", states, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", dscore, hidden)
        dhidden = dscore[:, :, None] * self.p["v"] * (1 - hidden**2)
        g["a"], g["a0"] = np.einsum("tbi,tbj->ij", states, dhidden), dhidden.sum(axis=(0, 1))
        dstates = dstates + dhidden @ self.p["a"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            w, n, later = self.p[f"h{d}"], 2 * HIDDEN, np.zeros((len(z), HIDDEN))
            dgates, dw = np.zeros((*index.shape, 3 * HIDDEN), np.float32), np.zeros_like(w)
            for t, h, by_n, rz, new in reversed(kept[d]):
                total_h = dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN] + later
                m = mask[t][:, None]
                dh = np.where(m, total_h, 0)
                r, u = rz[:, :HIDDEN], rz[:, HIDDEN:]
                dn = dh * (1 - u) * (1 - new**2)
                du = dh * (h - new) * u * (1 - u)
                dr = dn * by_n * r * (1 - r)
                by_state = np.concatenate([dr, du, dn * r], axis=1)
                dgates[t] = np.concatenate([dr, du, dn], axis=1)
                dw += h.T @ by_state
                later = np.where(m, dh * u, total_h) + by_state @ w.T
            g[f"h{d}"], g[f"c{d}"] = dw, dgates.sum(axis=(0, 1))
            by_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(by_word, index.ravel(), dgates.reshape(-1, 3 * HIDDEN))
            g[f"x{d}"] = x.T @ by_word
            dx += by_word @ self.p[f"x{d}"].T
        row, whole, grams, word, scale = back
        g["words"], g["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(g["words"], row, dx * whole)
        np.add.at(g["grams"], grams, dx[word] * scale[:, None])
        self._adam(g)
        return float(loss)

    def _adam(self, g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, v in g.items():
            m, s = self.moments[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-7)
            if v.ndim > 1:
                self.p[k] *= 1 - self.rate * DECAY


def windows(n: int) -> np.ndarray:
    """Starts of a text's windows; a text of fewer words than a window has one."""
    if n <= WIDTH:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WIDTH, STEP), n - WIDTH)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to whole texts, all windows of each."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.rng = np.random.default_rng(seed + 1)
    ids: dict[str, int] = {"": 0}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int64) for t in texts]
    words, labels = list(ids), np.asarray(labels)
    docs.append(np.empty(0, np.int64))  # an empty text is clean
    labels = np.append(labels, 0)
    steps = epochs * -(-len(docs) // 24)
    for _ in range(epochs if len(docs) > 1 else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 24):
            part, index, doc = order[at : at + 24], [], []
            for k, i in enumerate(part):
                starts = windows(len(docs[i]))
                for a in starts:
                    piece = docs[i][a : a + WIDTH]
                    index.append(np.pad(piece, (0, WIDTH - len(piece)), constant_values=-1))
                doc += [k] * len(starts)
            index = np.array(index).T
            mask = index >= 0
            used, place = np.unique(np.where(mask, index, 0), return_inverse=True)
            net.rate = RATE * (1 + np.cos(np.pi * max(0.0, 2 * net.steps / steps - 1))) / 2
            net.learn([words[i] for i in used], place.reshape(index.shape), mask, np.array(doc), labels[part])
    return net


class Scorer:
    """Scores whole texts; keeps what words add to the gates."""

    def __init__(self, net: Network):
        self.net, self.ids = net, {}
        self.gates = {d: np.empty((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = {w: None for words in texts for w in words if w not in self.ids}
        if len(self.ids) + len(new) > KEPT:
            self.ids, self.gates = {}, {d: g[:0] for d, g in self.gates.items()}
            new = dict.fromkeys(w for words in texts for w in words)
        if not self.ids:
            new = {"": None} | new
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            more = self.net.gates(self.net.inputs(list(new))[0])
            self.gates = {d: np.concatenate([g, more[d]]) for d, g in self.gates.items()}
        get = self.ids.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: that of its highest window."""
        out = np.empty(len(texts))
        docs = self._ids([words_of(t) for t in texts])
        out = np.full(len(docs), -np.inf)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat, begin = np.concatenate([*docs, np.zeros(WIDTH, np.int64)]), np.concatenate([[0], np.cumsum(sizes)])
        for short in (False, True):
            mine = np.flatnonzero((sizes < WIDTH) == short)
            starts = [windows(sizes[i]) for i in mine]
            doc = np.repeat(mine, [len(s) for s in starts])
            first = np.concatenate([np.empty(0, np.int64), *starts]) + begin[doc]
            for at in range(0, len(doc), BATCH):
                d = doc[at : at + BATCH]
                index = flat[first[at : at + BATCH] + np.arange(WIDTH)[:, None]]
                mask = np.arange(WIDTH)[:, None] < sizes[d] if short else None
                np.maximum.at(out, d, self.net.logits(self.gates, index, mask))
        return sigmoid(out)


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: whether crc32 of the id as text is 2 modulo 4; such rows' labels are never learned."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """A network fitted to at most ``per_class`` labelled documents of each label, those first by a hash of their id.

    Rows without id or label, and held-out ones, aren't learned; of rows of one id, the least text is; an id with both
    labels counts as toxic; without any rows the network stays as it began. Since the sample holds more of the rarer
    label than there is, the logits are moved back by what that adds to the odds.
    """
    known = held_out(labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")).where("not held_out")
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("at")).distinct()
    chosen = [known.where(F.col("toxic") == y).orderBy("at", "doc_id").limit(per_class).collect() for y in (0, 1)]
    label = {r.doc_id: r.toxic for rows in chosen for r in rows}
    own = docs.where(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = sorted((r.doc_id, r.text or "") for r in own.collect()) if label else []
    net = train([t for _, t in texts], [label[i] for i, _ in texts])
    all_rows = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = [len(rows) for rows in chosen]
    if all(taken):
        odds = np.log(all_rows[1] / all_rows[0]) - np.log(taken[1] / taken[0])
        net.p["u0"] = net.p["u0"] + np.float32(odds)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Adds ``score`` (0 to 1) to each row. Null and empty texts have a score too; all other columns are kept, one named
    score is replaced. Repeated rows have equal scores, all windows of very long texts are read, an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        model = Network.__new__(Network)
        model.p = sent.value
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(part) for part in slices(batch.column("text"))]
            made = pa.array(np.concatenate(scores), pa.float64()) if len(batch) else pa.array([], pa.float64())
            names = [n for n in batch.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, "score"])

    drop = {"score"}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in drop]
    return docs.mapInArrow(run, ", ".join([*kept, "score double"]))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: every document's score, and whether it is toxic. Rows come back as often as they came, also those without
    id or text; without usable labels, the network scores as it began; an empty table gives an empty table."""
    net = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), net).drop("text")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return held_out(scored).select("doc_id", "held_out", "score", predicted.alias("predicted"))
