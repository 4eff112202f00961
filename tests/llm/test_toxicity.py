import math
import random
import zlib

import pytest
from crashgrid.llm.toxicity import (SENTENCE, ToxicityModel, copy_weights, drop_toxic, fit_noisy_or, held_out, offending_sentences,
                                    score_toxicity, sentence_words, train_toxicity, word_features)

draw = random.Random(7)
CLEAN = [f"mild{i}" for i in range(300)]
RUDE = ["vileword", "nastyterm", "foulname"]


def sentence(rude=False):
    words = [draw.choice(CLEAN) for _ in range(8)]
    return " ".join(words[:4] + [draw.choice(RUDE)] * rude + words[4:]).capitalize()


def document(toxic):
    parts = [sentence() for _ in range(draw.randint(2, 12))]
    if toxic:
        parts[draw.randrange(len(parts))] = sentence(True)
    return ". ".join(parts) + "."


ROWS = [(i, document(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def model():
    taught = [r for r in ROWS if zlib.crc32(str(r[0]).encode()) % 5]
    return ToxicityModel(*fit_noisy_or([t for _, t, _ in taught], [y for _, _, y in taught], 500))


def test_held_out_accuracy_and_the_offending_sentence(model):
    kept = [r for r in ROWS if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((model.judge(t)[0] >= 0.5) == y for _, t, y in kept) / len(kept) > 0.97
    hits = 0
    for _, t, _ in (r for r in kept if r[2]):
        start, end = model.judge(t)[3:5]
        hits += any(w in t[start:end].lower() for w in RUDE)
    assert hits / sum(r[2] for r in kept) > 0.95


def test_noisy_or_is_one_minus_the_product_of_complements(model):
    text = ROWS[0][1]
    from crashgrid.llm.toxicity import logistic
    product = 1.0
    for _, _, z in model.sentences(text):
        product *= 1 - logistic(z)
    assert model.judge(text)[0] == pytest.approx(1 - product, abs=1e-9)


def test_wrong_labels_of_copied_texts_do_not_teach():
    texts, labels = [t for _, t, _ in ROWS], [y for _, _, y in ROWS]
    texts += ["Oddword mild1 mild2 mild3 mild4 mild5. " + document(False)] * 30
    labels += [1] * 30
    fitted = ToxicityModel(*fit_noisy_or(texts, labels, 500))
    assert sum(fitted.judge(t)[0] >= 0.5 for t in [document(False) for _ in range(100)]) <= 3


def test_scores_of_edge_cases_and_held_out_rows(documents, spark, model):
    docs = documents([(1, None), (2, ""), (3, " .!?\n"), (4, "Vileword. Mild1 mild2"), (4, "Vileword. Mild1 mild2"),
                      (None, "mild3"), (5, ("mild1 mild2. " * 20_000) + "vileword nastyterm!")])
    rows = sorted((str(r["doc_id"]), r["score"], r["predicted"], r["worst_start"]) for r in
                  score_toxicity(docs, model).collect())
    assert len(rows) == 7
    assert [r[1:] for r in rows[:3]] == [(0.0, 0, None)] * 3
    assert rows[3] == rows[4] and rows[3][2] == 1 and rows[3][3] == 0
    assert all(0 <= r[1] <= 1 for r in rows)
    found = offending_sentences(docs.where("doc_id = 4"), model).collect()
    assert [(r["start"], r["end"]) for r in found] == [(0, 8)] * 2
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and 4 not in [r["doc_id"] for r in kept.collect()]
    ids = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "i long")
    got = {r["i"]: r["h"] for r in ids.select("i", held_out(ids["i"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)} | {None: False}


def test_training_reads_only_rows_that_are_not_held_out(documents, spark):
    docs = documents([(i, t) for i, t, _ in ROWS])
    labels = [(i, 1, y) for i, _, y in ROWS]
    flipped = [(i, 1, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in ROWS]
    shape = "doc_id long, quality int, toxic int"
    one = train_toxicity(docs, spark.createDataFrame(labels, shape))
    extra = spark.createDataFrame(flipped + [flipped[1], (None, 1, 1), (7, 1, None), (8, 1, 9)], shape)
    two = train_toxicity(docs, extra)
    assert one.weights == two.weights and one.bias == two.bias and max(one.weights.values()) > 1


def test_without_both_labels(documents, spark):
    docs, shape = documents([(1, "a b"), (2, None)]), "doc_id long, toxic int"
    for rows, score in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = train_toxicity(docs, spark.createDataFrame(rows, shape))
        assert {r["score"] for r in score_toxicity(docs, model).collect()} == {score}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_the_cap_on_training_rows_does_not_move_the_scores(documents, spark):
    # "greyword" is in every toxic document and in 3 of 10 clean ones; 1 of 10 is toxic, so it means 0.27
    rows = []
    for i in range(2_000):
        toxic = i % 10 == 0
        grey = toxic or draw.random() < 0.3
        rows.append((i, document(False) + " Greyword" * grey + ".", int(toxic)))
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, capped = (train_toxicity(docs, labels, max_training_rows=cap) for cap in (6_000, 300))
    texts = [f"{document(False)} Greyword." for _ in range(100)]
    above, below = ([m.judge(t)[0] for t in texts] for m in (capped, whole))
    print(sum(below) / 100, sum(above) / 100)
    assert sum(s >= 0.5 for s in above) <= 5 and sum(s >= 0.5 for s in below) <= 5
    assert abs(sum(above) - sum(below)) / 100 < 0.1


def plain_cost(texts, labels, weights, bias, noise=0.03, l2=3e-5):
    """Noisy-or likelihood of the labels, document by document and sentence by sentence."""
    share = copy_weights(texts)
    total = 0.0
    for text, y, part in zip(texts, labels, share, strict=True):
        clean = 1.0
        for m in SENTENCE.finditer(text):
            words = set(sentence_words(m[0]))
            if words:
                z = bias + sum(weights.get(f, 0.0) for w in words for f in word_features(w))
                clean *= 1 / (1 + math.exp(z))
        p = noise + (1 - 2 * noise) * ((1 - clean) if y else clean)
        total -= part / share.sum() * math.log(p)
    return total + l2 / 2 * sum(w * w for w in weights.values())


def test_fit_is_a_minimum_of_the_plain_likelihood():
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "vile"]
    texts, labels = [], []
    for i in range(60):
        toxic = i % 3 == 0
        sentences = [" ".join(rng.choices(words[:4], k=4)) for _ in range(3)]
        if toxic or rng.random() < 0.05:
            sentences[rng.randrange(3)] += " vile"
        texts.append(". ".join(sentences) + f". unique{i} u{i}a u{i}b u{i}c u{i}d")
        labels.append(int(toxic))
    weights, bias = fit_noisy_or(texts, labels, 20, steps=2000, rate=0.03)
    best = plain_cost(texts, labels, weights, bias)
    assert best < plain_cost(texts, labels, {}, bias) and best < plain_cost(texts, labels, {}, -3.0)
    for _ in range(60):
        near = {k: w + rng.gauss(0, 0.2) for k, w in weights.items()}
        assert plain_cost(texts, labels, near, bias + rng.gauss(0, 0.2)) > best - 1e-3
    model = ToxicityModel(weights, bias)
    for text in texts[:10]:  # the score is the plain noisy-or
        clean = 1.0
        for m in SENTENCE.finditer(text):
            z = bias + sum(weights.get(f, 0.0) for w in set(sentence_words(m[0])) for f in word_features(w))
            clean *= 1 / (1 + math.exp(z))
        assert model.judge(text)[0] == pytest.approx(1 - clean)
