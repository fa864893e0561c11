"""The toxicity classifier: scoring against plain loops, held-out accuracy, bounds and odd tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexarium.llm import toxicity as tx

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt".split(), "fr": "ou le qu eau tion ment re an en ai er que oi".split()}


def some_text(rng, lang, bad):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
    for _ in range(rng.randint(2, 4) if bad else 0):
        words.insert(rng.randrange(len(words)), rng.choice(["zorkle", "brakken"]) if lang == "en" else "vilzu" + "".join(rng.choices(SYLLABLES["fr"], k=1)))
    return " ".join(w + rng.choice(["", "", ".", ",\n"]) for w in words)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    rows = []
    for k in range(900):
        lang, bad = "en" if k % 3 else "fr", k % 7 == 0
        rows.append((k, some_text(rng, lang, bad), lang, int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(sample):
    rows = [r for r in sample if zlib.crc32(str(r[0]).encode()) % 5]
    return tx.train(pa.array([r[1] for r in rows]), np.array([r[3] for r in rows]), [r[2] for r in rows], 0.14)


def plain_bucket(word: bytes, salt: int) -> int:
    h = 0xCBF29CE484222325
    for b in word[:64]:
        h = (h ^ b) * 0x100000001B3 % 2**64
    if salt == 0 and len(word) > 64:
        h ^= zlib.crc32(word[64:])
    return 1 + ((h ^ (h >> 29)) + salt * 7919) % 2**64 % (tx.BUCKETS - 1)


def plain_score(m, text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower())]
    vectors, langs = [], np.zeros(m.words_by_lang.shape[1])
    for w in words:
        raw = w.encode()
        ids = [plain_bucket(raw, 0)] + [plain_bucket(raw[:n], n) for n in tx.STEMS if len(raw) > n] if raw else []
        vectors.append(sum((m.embed[i] for i in ids), np.zeros(tx.DIM)))
        langs += m.words_by_lang[ids[0] if ids else 0]
    pooled, at = [], 0
    for span in tx.SPANS:
        for f in range(tx.FILTERS):
            pooled.append(max(sum(vectors[k + j] @ m.filters[:, at + j * tx.FILTERS + f] for j in range(span) if k + j < len(vectors)) for k in range(len(vectors))))
        at += span * tx.FILTERS
    z = np.maximum(np.array(pooled) + m.shift, 0) @ m.out + m.bias
    return 1 / (1 + np.exp(-(m.scale * z + m.offsets[int(langs.argmax())])))


def test_scores_equal_plain_loops(model, monkeypatch):
    rng = random.Random(9)
    texts = [some_text(rng, "en", k % 2) for k in range(6)] + [None, "", " .\n", "zorkle", "a zorkle", "Ünïcode ß 12 vilzuou", "x" * 500 + " brakken", "one " * 300 + "zorkle"]
    want = [plain_score(model, t) for t in texts]
    for stream in (tx.STREAM, 5, 64):  # pieces of a few words
        monkeypatch.setattr(tx, "STREAM", stream)
        assert np.allclose(model.score(pa.array(texts, pa.string())), want, atol=1e-4)
    assert np.allclose(model.score(pa.array(["pad", *texts], pa.string()).slice(1)), want, atol=1e-4)


def test_held_out_accuracy(spark, sample, tmp_path):
    """Labels of held-out rows are turned round: they must not count."""
    docs = spark.createDataFrame([(k, t, g, "x") for k, t, g, _ in sample] + [(None, "zorkle zorkle brakken", "en", "x"), (5000, None, None, None), (5001, "", None, None), (3, "repeated id", "en", "y")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, y if zlib.crc32(str(k).encode()) % 5 else 1 - y) for k, _, _, y in sample] + [(None, 1), (7777, 1), (1, None)], "doc_id long, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = tx.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(sample) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    true = {k: y for k, _, _, y in sample}
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == true[r.doc_id] for r in held]
    found = [r.predicted for r in held if true[r.doc_id]]
    assert len(held) > 150 and np.mean(right) > 0.95 and np.mean(found) > 0.8
    assert sorted(map(str, tx.op12_toxicity(spark, str(tmp_path)).collect())) == sorted(map(str, rows)), "reruns agree"


def test_bounds_and_single_class(spark, sample, monkeypatch):
    docs = spark.createDataFrame([(k, t, g) for k, t, g, _ in sample], "doc_id long, text string, lang string")
    none = tx.fit(docs, spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int"))
    n = sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(50))
    assert np.allclose(none.score(pa.array(["any", None])), 1 / (n + 3))
    assert tx.score(docs.limit(0), none).count() == 0
    given = []
    monkeypatch.setattr(tx, "train", lambda texts, y, langs, share: given.append((texts, y)))
    monkeypatch.setattr(tx, "PER_CLASS", 20)
    labels = spark.createDataFrame([(k, y) for k, _, _, y in sample], "doc_id long, toxic int")
    tx.fit(docs.union(docs), labels)
    monkeypatch.setattr(tx, "MOST_CHARS", 2000)
    tx.fit(docs, labels)
    assert [len(t) for t, _ in given][0] == 40 and 2 <= len(given[1][0]) < 15 and set(given[1][1]) == {0, 1}
    assert all(t in {x[1] for x in sample} for t, in zip(given[1][0].to_pylist()))
