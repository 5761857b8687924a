import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm.crf import Chains, marginals, train
from sheaf.llm.textbytes import text_chunks
from sheaf.llm.toxicity import Tagger, Tagging, Tokens, toxicity_scores, train_tagger


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    length = np.array([3, 1, 5, 2])
    start = np.array([0, 3, 4, 9])
    emission, transition = rng.uniform(0.1, 4, 11), rng.uniform(0.2, 3, (2, 2))
    got = marginals(emission, transition, Chains(start, length))
    for s, n in zip(start, length):
        total, one = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([emission[s + i] for i in range(n) if states[i]])
            w *= np.prod([transition[states[i], states[i + 1]] for i in range(n - 1)])
            total += w
            one += w * np.array(states)
        assert np.allclose(got[s: s + n], one / total)


def test_training_separates_words():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 5, 4000)
    label = (word == 3).astype(int)
    chains = Chains(np.arange(0, 4000, 10), np.full(400, 10))
    weights, transition = train(word, label, chains, 6)
    p = marginals(np.exp(weights)[word], np.exp(transition), chains)
    assert p[label == 1].min() > 0.9 and p[label == 0].max() < 0.1


def test_tokens_stems_and_sentences():
    text = "Été IDIOT! idiots\nab"
    (_, c), = text_chunks(pa.array([text]))
    t = Tokens(c)
    assert t.first.tolist() == [True, False, True, True]
    row, h = t.stems(5)
    assert row.tolist() == [1, 2] and h[0] == h[1]
    row, _ = t.stems(3)
    assert row.tolist() == [0, 1, 2]
    (_, low), = text_chunks(pa.array(["été"]))
    assert Tokens(low).word[0] == t.word[0]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in ("r", "nt", "l", "s")]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "Vermin", "quxor", "quxat", "quxis"])
        rows.append((d, ". ".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9))))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus(700, 2)
    docs = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out, _ = toxicity_scores(docs, lab)
    got, truth, texts = {r.doc_id: r for r in out.collect()}, dict(labels), dict(rows)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.97
    for r in got.values():
        for s in r.spans:
            word = texts[r.doc_id][s.start: s.start + s.length].lower()
            assert any(w.startswith(("vile", "vermin", "qux")) for w in word.split())
    # labels of the held-out fifth are never used
    turned = [(d, 1 - t if got[d].held_out else t) for d, t in labels]
    again, _ = toxicity_scores(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert {r.doc_id: r.score for r in again.collect()} == {d: r.score for d, r in got.items()}


def test_edge_cases(spark):
    rows, labels = corpus(300, 3)
    odd = [(1000, None), (1001, ""), (1002, "\n.!"), (1003, "vile " * 30_000), (1003, "vile " * 30_000), (None, "vile")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (1000, 1)], "doc_id long, toxic int")
    out = toxicity_scores(docs, lab, Tagging(support=3))[0].collect()
    assert len(out) == 306
    got = {r.doc_id: r for r in out}
    assert got[1000].spans == [] and got[1000].score == got[1001].score == got[1002].score < 0.5
    assert len(got[1003].spans) == 1 and got[1003].predicted == 1
    assert toxicity_scores(docs.limit(0), lab.limit(0))[0].count() == 0
    none = toxicity_scores(docs, lab.limit(0))[0]
    assert {r.score for r in none.collect()} == {0.0}


def test_no_texts_give_a_tagger_that_tags_nothing():
    tagger = train_tagger(pa.chunked_array([pa.array([], pa.string())]), np.empty(0, bool))
    assert isinstance(tagger, Tagger) and tagger.logistic is None


@pytest.mark.parametrize("text", ["", "x", "..", "\n"])
def test_tiny_chunks(text):
    (_, c), = text_chunks(pa.array([text]))
    t = Tokens(c)
    assert len(Tagger().marginals(t)) == len(t.s)


def test_query_returns_spans(spark, tmp_path):
    from sheaf.llm.queries import op10_toxicity

    rows, labels = corpus(300, 4)
    spark.createDataFrame(rows + [(900, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got, texts = op10_toxicity(spark, str(tmp_path)).collect(), dict(rows)
    assert len(got) == 301 and all(r.n_spans == len(r.spans) for r in got)
    found = [texts[r.doc_id][s.start: s.start + s.length].lower() for r in got for s in r.spans]
    assert found and all(any(w.startswith(("vile", "vermin", "qux")) for w in x.split()) for x in found)


def test_a_task_trains_the_tagger(spark, monkeypatch):
    """The driver gets the tagger only, no texts; it is the one that the rows in their order give."""
    from pyspark.sql import functions as F

    from sheaf.llm.textstats import labelled_sample
    from sheaf.llm.toxicity import learn
    made = corpus(300, 4)
    docs = spark.createDataFrame([(r[0], r[1]) for r in made[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[1])) for r in made[1]], "doc_id long, toxic int")
    rows = docs.join(labelled_sample(labels, "toxic", 5000), "doc_id").groupBy("text").agg(F.max("label").alias("label")).orderBy(
        F.xxhash64("text"), "text").collect()
    want = train_tagger(pa.chunked_array([pa.array([r.text for r in rows])]), np.array([r.label == 1 for r in rows]))

    def refuse(self, *args, **kwargs):
        raise AssertionError("rows come to the driver")
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    monkeypatch.setattr(type(docs), "toPandas", refuse)
    got = learn(docs, labels)
    assert got.stems and got.stems.keys() == want.stems.keys() and all((got.stems[k] == want.stems[k]).all() for k in want.stems)
    assert (got.words == want.words).all() and np.allclose(got.weights, want.weights) and np.allclose(got.logistic, want.logistic)
    assert learn(docs, labels.limit(0)).stems == {}
