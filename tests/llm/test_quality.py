"""The quality classifier: gradients, a plain forward pass, held-out labels, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import quality, queries, toxicity
from strandwise.llm.common import read_table

TEXTS = ["one two three", "", None, "A " * 500, "Señor !! §§ 12 12 12", " \n\t", "x" * 5000]


def plainly(net, text):
    """A text's score, passage by passage."""
    p, words = net.p, (text or "").split()
    encoded = []
    for part in [words[i : i + quality.WIDTH] for i in range(0, len(words), quality.WIDTH)] or [[]]:
        vector = sum((net.vectors([w])[0][0] for w in dict.fromkeys(part)), np.zeros(quality.SIZE)) / max(1, len(part))
        look = sum((quality.surface([w])[0] for w in part), np.zeros(quality.SURFACE)) / max(1, len(part))
        like = sum(a == b for a, b in zip(part, part[1:])) / max(1, len(part))
        again = (len(part) - len(set(part))) / max(1, len(part))
        encoded.append(np.tanh(np.concatenate([vector, look, [like, again, np.log1p(len(part)) / np.log1p(quality.WIDTH)]]) @ p["w"] + p["b"]))
    score = np.array([(np.tanh(h @ p["v"]) * quality.sigmoid(h @ p["g"])) @ p["a"] for h in encoded])
    weight = np.exp(score) / np.exp(score).sum()
    return quality.sigmoid(weight @ np.array(encoded) @ p["u"] + p["u0"][0])


def test_scores_equal_a_plain_pass(monkeypatch):
    monkeypatch.setattr(quality, "KEPT", 40)
    net, r = quality.Network(7), random.Random(2)
    texts = TEXTS + [" ".join(r.choice(["der", "The", "cat!!", "9", "&&&", "ü", "Ünd"]) + r.choice("abcdef") for _ in range(r.randrange(300))) for _ in range(12)]
    scorer = quality.Scorer(net)
    found = np.concatenate([scorer.score(texts[:9]), scorer.score([]), scorer.score(texts[9:])])
    assert np.allclose(found, [plainly(net, t) for t in texts], atol=1e-5)


def test_gradients():
    """Against differences of the loss."""
    net, r = quality.Network(3), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, doc, labels = r.normal(size=(7, quality.SIZE + quality.SURFACE + 3)), np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1, 0, 1, 0])
    loss = lambda: net.gradients(x, doc, labels)[0]
    _, grads, dx = net.gradients(x, doc, labels)
    for value, grad in [*((net.p[k], g) for k, g in grads.items()), (x, dx)]:
        at = tuple(r.integers(0, s) for s in value.shape)
        kept, e = value[at], 1e-5
        value[at] = kept + e
        above = loss()
        value[at] = kept - e
        assert abs((above - loss()) / (2 * e) - grad[at]) < 1e-5
        value[at] = kept


@pytest.mark.parametrize("folder, recall", [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_held_out_labels(spark, folder, recall):
    """Most held-out low documents are found, hardly any good one is refused, and no held-out label was read."""
    path = f"/root/testdata/{folder}"
    labels = read_table(spark, path, "labels")
    rows = queries.op11_quality(spark, path).join(labels, "doc_id").where("held_out").collect()
    assert rows and all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in rows)
    low, good = [[x.predicted for x in rows if x.quality == y] for y in (0, 1)]
    assert low.count(0) / len(low) >= recall and good.count(1) / len(good) >= 0.98
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    nets = [quality.fit(read_table(spark, path, "documents"), x, 20) for x in (labels, turned)]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)


def test_odd_rows(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "one two three"), (0, "one two three")], "doc_id long, text string")
    docs = docs.withColumns({"score": F.lit("old"), "held_out": F.lit("old")})
    net = quality.Network(1)
    rows = quality.score(docs, net).collect()
    assert [c for c, _ in quality.score(docs, net).dtypes] == ["doc_id", "text", "held_out", "score"]
    assert len(rows) == len(TEXTS) + 2 and all(0 <= x.score <= 1 and x.held_out == "old" for x in rows)
    assert len({x.score for x in rows if x.text == "one two three"}) == 1
    assert len({x.score for x in rows if not (x.text or "").split()}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, 0)], none.schema)
    assert quality.op11_quality(docs, none).count() == quality.op11_quality(docs, odd).count() == len(rows)
    assert quality.op11_quality(docs.limit(0), odd).count() == 0


def test_hashes_of_a_word_stand_alone():
    words = ["", "a", "ab", "cat", "café", "", "中"]
    rows, grams, firsts = toxicity.word_hashes(words)
    for i, word in enumerate(words):
        row, own, first = toxicity.word_hashes([word])
        assert rows[i] == row[0] and first.tolist() == [0] and len(own) == max(1, len(word.encode()))
        assert grams[firsts[i] :][: len(own)].tolist() == own.tolist()
