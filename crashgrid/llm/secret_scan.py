"""Secret spans: three fixed patterns, plus tokens that pass a randomness battery.

Tokens that look like keys are judged by three tests in their inferred
encoding: chi-squared uniformity over the alphabet, runs above and below the
alphabet's middle, and lag-1 serial correlation. Each is turned round into an
equivalence test, whose null hypothesis is that the token is as uneven as
ordinary text; its p-value falls with the token's length, so short tokens
cannot pass by lack of evidence. Fisher's method combines the three, and the
Benjamini-Hochberg procedure, run per length class over the whole corpus,
bounds the share of false discoveries.
"""

from __future__ import annotations

import math
import re
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import free_name, materialize

KINDS = ("assign", "access", "hex", "random")  # in the order that spans of equal start take
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 and more
KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
#: "=" is padding at a token's end only: in name=value the value is a token of its own. 20 characters with the padding.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{18,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

#: (name, alphabet) from the narrowest encoding to the widest.
ENCODINGS = (("digits", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"),
             ("lower", "abcdefghijklmnopqrstuvwxyz"), ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
LENGTH_CLASSES = (20, 32, 48, 64, 128)  # lower bounds
REPEAT_RATE = 0.065  # chance that two symbols of ordinary text are equal
LEAST_UNEVENNESS = 0.8  # chi-squared noncentrality per symbol assumed for narrow alphabets
CORRELATION = 0.35  # runs and serial effect that ordinary text has at least
GATE = 0.001  # classical runs and serial tests below this reject randomness outright
P_BINS = 2048  # p-values are rounded up to the next 10**(-k/8), k < P_BINS: the least is far below rate / trials

SPAN = "struct<start:int,end:int,kind:int>"
TRIAL = "struct<start:int,end:int,class:int,bin:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns, by start, then kind."""
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if KEYWORD.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _uneven_p(chi2: float, df: int, noncentral: float) -> float:
    """P(noncentral chi-squared <= chi2): Patnaik's scaling, then Wilson-Hilferty."""
    scale = (df + 2 * noncentral) / (df + noncentral)
    f = (df + noncentral) ** 2 / (df + 2 * noncentral)
    return _normal((max(chi2, 0.0) / (scale * f)) ** (1 / 3) / math.sqrt(2 / (9 * f))
                   - (1 - 2 / (9 * f)) / math.sqrt(2 / (9 * f)))


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds every symbol of the token."""
    symbols = set(token)
    return next((alphabet for _, alphabet in ENCODINGS if symbols <= set(alphabet)), None)


def randomness_p(token: str) -> float:
    """p-value of "as uneven as ordinary text"; small for random tokens, 1 if a test rejects randomness."""
    token = token.rstrip("=")
    alphabet = infer_encoding(token)
    n = len(token)
    if alphabet is None or n < 8:
        return 1.0
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.fromiter(map(place.__getitem__, token), dtype=np.int64, count=n)
    k = len(alphabet)
    counts = np.bincount(x, minlength=k)
    chi2 = float((counts * counts).sum()) * k / n - n
    high = x >= k / 2
    n_high = int(high.sum())
    n_low = n - n_high
    if not n_high or not n_low:
        return 1.0
    mean = 1 + 2 * n_high * n_low / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    z_runs = (1 + int((high[1:] != high[:-1]).sum()) - mean) / spread
    centred = x - x.mean()
    total = float((centred * centred).sum())
    z_serial = float((centred[1:] * centred[:-1]).sum()) / total * math.sqrt(n) if total else math.inf
    if min(math.erfc(abs(z_runs) / math.sqrt(2)), math.erfc(abs(z_serial) / math.sqrt(2))) < GATE:
        return 1.0
    reach = CORRELATION * math.sqrt(n)
    parts = (_uneven_p(chi2, k - 1, max(LEAST_UNEVENNESS, REPEAT_RATE * k - 1) * n), _normal(abs(z_runs) - reach), _normal(abs(z_serial) - reach))
    half = -sum(math.log(max(p, 1e-300)) for p in parts)
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def length_class(n: int) -> int:
    return sum(n >= low for low in LENGTH_CLASSES) - 1


def p_bin(p: float) -> int:
    """k with p <= 10**(-k/8): p-values are only ever rounded up."""
    return max(0, min(P_BINS - 1, math.floor(-8 * math.log10(max(p, 1e-300)))))


def trials(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, p bin) of the tokens that no base span overlaps."""
    found, i, ordered = [], 0, sorted(taken)
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < LENGTH_CLASSES[0]:
            continue
        while i < len(ordered) and ordered[i][1] <= m.start():
            i += 1
        if not any(s < m.end() and e > m.start() for s, e, _ in ordered[i:i + 8]):
            found.append((m.start(), m.end(), length_class(m.end() - m.start()), p_bin(randomness_p(m[0]))))
    return found


def scan_column(text_col: str = "text"):
    """Column: ``base`` spans and randomness ``trials`` of a text."""

    @pandas_udf(f"base array<{SPAN}>, trials array<{TRIAL}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t or "") for t in texts]
            tried = [trials(t or "", b) for t, b in zip(texts, base, strict=True)]
            yield pd.DataFrame({
                "base": [[{"start": s, "end": e, "kind": k} for s, e, k in b] for b in base],
                "trials": [[{"start": s, "end": e, "class": c, "bin": p} for s, e, c, p in t] for t in tried]})

    return scan(F.col(text_col))


def discovery_bins(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Smallest p bin declared random, by length class: Benjamini-Hochberg at ``rate`` in each class.

    ``counts`` holds the number of trials by (class, bin). Rounded-up p-values
    keep the bound valid.
    """
    least = {}
    for c in {c for c, _ in counts}:
        total = sum(n for (x, _), n in counts.items() if x == c)
        passed = 0
        for k in range(P_BINS - 1, -1, -1):
            passed += counts.get((c, k), 0)
            if counts.get((c, k)) and 10 ** (-k / 8) <= rate * passed / total:
                least[c] = k
    return least


def with_spans(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> tuple[DataFrame, str]:
    """``docs`` plus an array of all spans (start, end, kind), by start, then kind; and that column's name.

    Texts are scanned once and stored with what was found. The p-values of all
    tokens of the corpus are counted by length class and rounded p (a bounded
    table reaches the driver) before any is declared.
    """
    work = free_name(docs, "scanned")
    stored = materialize(docs.withColumn(work, scan_column(text_col)), "scanned-texts")
    out, spans = _add_spans(stored, F.col(work), discovery_bins(_trial_counts(stored, f"{work}.trials"), rate))
    return out.select(*docs.columns, spans), spans


def _trial_counts(scanned: DataFrame, trials: str) -> dict[tuple[int, int], int]:
    """Trials by (length class, p bin): at most 5 x ``P_BINS`` counts."""
    hits = scanned.select(F.explode(trials).alias("t"))
    return {(r["class"], r["bin"]): r["n"] for r in hits.groupBy("t.class", "t.bin").agg(
        F.count(F.lit(1)).alias("n")).collect()}


def _add_spans(docs: DataFrame, scanned, least: dict[int, int]) -> tuple[DataFrame, str]:
    name, work = free_name(docs, "spans"), free_name(docs, "scanned")
    random = F.filter(F.col(work)["trials"], lambda t: _declared(t, least))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"),
                                                    F.lit(KINDS.index("random")).alias("kind")))
    key = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.array_sort(F.transform(F.concat(F.col(work)["base"], random), key))
    return docs.withColumn(work, scanned).select(*docs.columns, spans.alias(name)), name


def _declared(t, least: dict[int, int]):
    out = F.lit(False)
    for c, k in least.items():
        out = out | ((t["class"] == c) & (t["bin"] >= k))
    return out


def _joined(spans) -> "F.Column":
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rate: float = 0.01) -> DataFrame:
    """Per row of ``docs``: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) of all spans by
    start, then kind; ``base_sha256`` digests those of the three patterns.
    ``rate`` is the false-discovery rate of the added ``random`` spans. Null
    and empty texts have no spans. Repeated rows are scanned each and count
    each in the corpus-wide control; other columns are ignored; an empty
    table gives no rows.
    """
    work = docs.select(F.col(id_col).alias("id"), scan_column(text_col).alias("s"))
    work = materialize(work.select("id", "s.base", "s.trials"), "secret-trials")  # no texts in it
    out, spans = _add_spans(work, F.struct("base", "trials"), discovery_bins(_trial_counts(work, "trials"), rate))
    count = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter(F.col(spans), lambda s: s["kind"] < KINDS.index("random"))
    return out.select(F.col("id").alias(id_col), *(count(k).alias(f"n_{k}") for k in KINDS),
                      F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.01, mask: str = "[SECRET]",
                   length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; rows and columns stay.

    Overlapping spans give one mask. Texts without spans, and null texts, stay
    as they are. ``length_col``, if ``docs`` has it, gets the code points of
    the texts that were changed. Repeated rows stay; an empty table stays empty.
    """
    out, spans = with_spans(docs, text_col, rate)

    @pandas_udf("string")
    def redact(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([cover(t, [(s["start"], s["end"]) for s in f], mask)
                          for t, f in zip(texts, found, strict=True)], dtype=object)

    hit = F.size(spans) > 0
    work = free_name(out, "masked")
    out = out.withColumn(work, F.when(hit, redact(F.col(text_col), F.col(spans))))
    new = {text_col: F.when(hit, F.col(work)).otherwise(F.col(text_col))}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(hit, F.length(work).cast(kind)).otherwise(F.col(length_col))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def cover(text: str | None, spans: list[tuple[int, int]], mask: str) -> str | None:
    if not spans:
        return text
    parts, last = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        parts += [text[last:s], mask]
        last = e
    return "".join([*parts, text[last:]])

