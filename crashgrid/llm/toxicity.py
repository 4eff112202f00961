"""Toxicity by multiple-instance learning over sentences.

Labels exist for documents only. A sentence's probability is the logistic of
its summed word weights; a document's is the noisy-or of its sentences: one
minus the product of their complements. Both are trained together from
document labels, so the fitted weights also locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import broadcast_plain, materialize, per_worker

SENTENCE = re.compile(r"[^.!?\n]+")
#: Letters, digits, underscore and all non-ASCII bytes are word bytes.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() or chr(b) == "_" else 0x20 for b in range(256))

RESULT = ("score double, n_sentences int, n_offending int, worst_start int, worst_end int, "
          "worst_probability double")


def word_features(word: bytes) -> list[bytes]:
    """The word, marked by a trailing space, and its prefixes of 4 to 9 bytes."""
    return [word + b" ", *(word[:k] for k in range(4, min(len(word), 9) + 1))]


class _WordLogits(dict):
    """Summed feature weights by word, filled on demand and emptied when it holds ``room`` words."""

    def __init__(self, weights: dict[bytes, float], room: int = 200_000):
        super().__init__()
        self.weights, self.room = weights, room

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.room:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return total


class ToxicityModel:
    """Feature weights, bias, and the score given when nothing could be learned."""

    def __init__(self, weights: dict[bytes, float], bias: float, base_rate: float | None = None):
        self.weights, self.bias, self.base_rate = weights, bias, base_rate
        self.logits = _WordLogits(weights)

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of every sentence that has words; offsets in code points."""
        logits = self.logits
        for m in SENTENCE.finditer(text or ""):
            words = set(sentence_words(m[0]))
            if words:
                yield m.start(), m.end(), self.bias + sum(map(logits.__getitem__, words))

    def judge(self, text: str | None) -> tuple[float, int, int, int | None, int | None, float | None]:
        """A row of ``RESULT``: noisy-or score, sentence counts, the worst sentence."""
        total, count, offending, worst = 0.0, 0, 0, (None, None, -math.inf)
        for start, end, z in self.sentences(text):
            total += softplus(z)
            count += 1
            offending += z >= 0
            if z > worst[2]:
                worst = (start, end, z)
        score = self.base_rate if self.base_rate is not None else -math.expm1(-total)
        return score, count, offending, worst[0], worst[1], (logistic(worst[2]) if count else None)


def sentence_words(sentence: str) -> list[bytes]:
    return sentence.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def copy_weights(texts: list[str | None]) -> np.ndarray:
    """Weight of each text: 1 over the number of texts that share its sketch.

    The sketch is the smallest hash of the text's five-word shingles (of all
    its words, if fewer), so a group of near copies counts about once and one
    wrong label that was copied with its text does not count many times.
    """
    sketches = []
    for text in texts:
        words = sentence_words(text or "")
        grams = zip(*(words[i:] for i in range(5)), strict=False) if len(words) >= 5 else [words]
        sketches.append(min(xxhash.xxh64_intdigest(b" ".join(g)) for g in grams))
    sizes = Counter(sketches)
    return np.asarray([1 / sizes[k] for k in sketches])


def _sentence_sets(text: str | None) -> list[set[bytes]]:
    return [set(sentence_words(m[0])) for m in SENTENCE.finditer(text or "")]


def fit_noisy_or(texts: list[str | None], labels: list[int], max_features: int, min_documents: int = 3,
                 steps: int = 250, rate: float = 0.1, l2: float = 3e-5, noise: float = 0.03,
                 stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[dict[bytes, float], float]:
    """Weights and bias that maximise the noisy-or likelihood of the document labels (Adam).

    Features are the ``max_features`` words and word beginnings that occur in at least
    ``min_documents`` texts and whose document rates differ most between the
    labels, in standard errors (ties by the feature itself); near copies count as
    one text, see ``copy_weights``. ``noise`` is the
    share of labels assumed to be wrong: it bounds what one mislabelled
    document can gain, so no weights are bent to explain it. ``stands_for``
    gives the number of labelled documents that a text of label 0 and of label
    1 stands for, so a sample drawn by label teaches the rate of the whole table.
    """
    share, y = copy_weights(texts), np.asarray(labels)
    counts: dict[bytes, list[float]] = {}
    n = [max(1.0, share[y == 0].sum()), max(1.0, share[y == 1].sum())]
    all_clean, all_toxic = n[0] * stands_for[0], n[1] * stands_for[1]
    for text, label, part in zip(texts, labels, share, strict=True):
        for feature in {f for word in set().union(*_sentence_sets(text)) for f in word_features(word)}:
            counts.setdefault(feature, [0.0, 0.0])[label] += part
    gap = {}
    for word, (q, p) in counts.items():
        if p + q >= min_documents - 1e-9:
            rate_all = (p * stands_for[1] + q * stands_for[0]) / (all_clean + all_toxic)
            spread = math.sqrt(max(rate_all * (1 - rate_all), 1e-12) * (1 / n[0] + 1 / n[1]))
            gap[word] = abs(p / n[1] - q / n[0]) / spread
    chosen = sorted(gap, key=lambda w: (-gap[w], w))[:max_features]
    place = {w: i for i, w in enumerate(chosen)}
    del counts, gap

    # texts are cut a second time: keeping the words of all of them would hold many times their bytes
    ids, of_sentence, of_doc = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for words in _sentence_sets(text):
            if words:
                of_doc.append(d)
                found = [place[f] for w in words for f in word_features(w) if f in place]
                ids.extend(found)
                of_sentence.extend([len(of_doc) - 1] * len(found))
    ids, of_sentence, of_doc = (np.asarray(x, dtype=np.int64) for x in (ids, of_sentence, of_doc))
    rows = np.where(y == 1, stands_for[1], stands_for[0])
    keep, cost = 1 - 2 * noise, share * rows / (share * rows).sum()
    w, bias = np.zeros(len(chosen)), -math.log(max(2, rows[of_doc].sum()) / max(1, rows.sum())) - 3
    moments = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, steps + 1):
        z = np.bincount(of_sentence, w[ids], len(of_doc)) + bias
        total = np.bincount(of_doc, np.logaddexp(0, z), len(texts))
        clean = np.exp(-total)
        by_total = keep * clean * np.where(y == 1, -1 / (noise + keep * (1 - clean)),
                                           1 / (noise + keep * clean)) * cost
        by_z = by_total[of_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(ids, by_z[of_sentence], len(chosen)) + l2 * w, by_z.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return {k: float(v) for k, v in zip(chosen, w, strict=True)}, float(bias)


def held_out(id_column):
    """Rows that must not teach: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_training_rows: int = 6_000,
                   max_features: int = 3_000) -> ToxicityModel:
    """Fit on at most ``max_training_rows`` labelled documents that are not held out.

    The sample is the rows with the smallest seeded hash of the id, half of
    it open to each label, so it does not depend on row order or cluster size.
    Each row counts for its label's full count over its sampled count, so the
    rate of toxic labels, and with it the scores, do not depend on the cap.
    It is fitted inside one task; only the weights (at most ``max_features``)
    reach the driver. Labels of repeated ids count once (the largest); null
    ids and labels other than 0 and 1 are ignored. Without both labels the
    model scores every text with the label's rate (0 if there are no labels).
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    marks = materialize(marks.groupBy("id").agg(F.max("y").alias("y")), "label-marks")
    order = (F.xxhash64("id", F.lit("sample")), "id")
    half = max(1, max_training_rows // 2)
    full = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands_for = tuple(max(1.0, full.get(label, 0) / half) for label in (0, 1))
    sample = marks.where("y = 1").orderBy(*order).limit(half).union(
        marks.where("y = 0").orderBy(*order).limit(half))
    sample = materialize(sample, "label-sample")  # at most max_training_rows ids: safe to broadcast
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = text.join(F.broadcast(sample), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.first("y").alias("y")).withColumn("one", F.lit(1))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        y = [int(v) for v in frame["y"]]
        if len(set(y)) < 2:
            return pd.DataFrame({"word": [None], "weight": [float(y[0]) if y else 0.0]})
        weights, bias = fit_noisy_or(list(frame["text"]), y, max_features, stands_for=stands_for)
        return pd.DataFrame({"word": [b"", *weights], "weight": [bias, *weights.values()]})

    fitted = rows.groupBy("one").applyInPandas(fit, "word binary, weight double").collect()
    if not fitted or fitted[0]["word"] is None:
        return ToxicityModel({}, 0.0, fitted[0]["weight"] if fitted else 0.0)
    weights = {bytes(r["word"]): r["weight"] for r in fitted}
    return ToxicityModel(weights, weights.pop(b""))


def toxicity_column(docs: DataFrame, model: ToxicityModel, text_col: str = "text"):
    """Column: a struct of ``RESULT`` per text. The model (bounded) is broadcast."""
    shared = broadcast_plain(docs.sparkSession, (model.weights, model.bias, model.base_rate))

    @pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = per_worker(shared, lambda m: ToxicityModel(*m))
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts in batches:
            frame = pd.DataFrame([own.judge(t) for t in texts], columns=names)
            whole = {c: "Int32" for c in names if not c.startswith(("score", "worst_p"))}
            yield frame.astype(whole | {"score": "float64", "worst_probability": "float64"})

    return judged(F.col(text_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, score, predicted (1 if score >= 0.5), and its worst sentence.

    Sentences end at ``. ! ?`` or a line break. ``worst_start``/``worst_end``
    (code points, end exclusive) and ``worst_probability`` give the sentence
    that scores highest (the first of ties), ``n_offending`` the sentences of
    probability 0.5 or more. Null, empty and word-less texts have no sentence:
    score 0 and null offsets. Repeated rows are scored each; other columns are
    ignored whatever their names; an empty table gives no rows.
    """
    judged = docs.select(F.col(id_col), toxicity_column(docs, model, text_col).alias("t"))
    return judged.select(id_col, "t.*", (F.col("t.score") >= 0.5).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = 0.5) -> DataFrame:
    """One row per sentence with probability >= threshold: id, start, end, probability."""
    shared = broadcast_plain(docs.sparkSession, (model.weights, model.bias, model.base_rate))

    @pandas_udf("array<struct<start:int,end:int,probability:double>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = per_worker(shared, lambda m: ToxicityModel(*m))
        for texts in batches:
            yield pd.Series([[{"start": s, "end": e, "probability": p} for s, e, z in own.sentences(t)
                              if (p := logistic(z)) >= threshold] for t in texts], dtype=object)

    return docs.select(F.col(id_col), F.explode(located(F.col(text_col))).alias("s")).select(id_col, "s.*")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model scores 0.5 or more."""
    return docs.where(toxicity_column(docs, model, text_col)["score"] < 0.5)
