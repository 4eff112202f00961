"""Benchmark decontamination by word windows.

The benchmark's windows (``window`` consecutive words; a shorter item is one
window) become a set of 64-bit hashes. Documents are scanned with a rolling
hash over their whole token sequence; hash hits are verified word by word.
The set is broadcast while its size is proven small; a larger one is joined
by hash instead, with the same result.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import broadcast_plain, free_name, materialize, per_worker

#: A-Z to a-z; every other ASCII byte that is no letter or digit becomes a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
_STEP = 1 << 18  # words hashed at a time
_MULTIPLIER = 0x9E3779B97F4A7C15
WINDOW_BYTES, ITEM_BYTES = 400, 70  # what a window and an item's id take in a worker besides the words

HITS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (polynomial over the words' hashes, modulo 2**64)."""
    n = len(word_hashes) - size + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(_MULTIPLIER) + word_hashes[k:k + n]
    return out


class WordHashes(dict):
    """XXH64 by word, filled on demand and emptied when it holds ``room`` words."""

    room = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = 10) -> DataFrame:
    """(size, h, words, items): every distinct window of the benchmark with its items' ids.

    ``h`` is the window's hash as a signed long, ``words`` its words joined by
    a space, ``items`` the ids (as strings) of the items that hold it.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                if size:
                    hashes = window_hashes(hash_words(words, known), size).view(np.int64).tolist()
                    rows += [(item, size, h, b" ".join(words[i:i + size])) for i, h in enumerate(hashes)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()),
                                                strict=True)], names=["item", "size", "h", "words"])

    source = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    found = source.mapInArrow(cut, "item string, size int, h long, words binary")
    return found.groupBy("size", "h", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """The benchmark's windows, by size: sorted hashes, and words and items by hash."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]):
        self.sizes: dict[int, tuple[np.ndarray, dict]] = {}
        for size in sorted({r[0] for r in rows}):
            by_hash: dict[int, list] = {}
            for _, h, words, items in (r for r in rows if r[0] == size):
                by_hash.setdefault(h & (2**64 - 1), []).append((words, items))
            self.sizes[size] = np.sort(np.fromiter(by_hash, dtype=np.uint64, count=len(by_hash))), by_hash

    def scan(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """A mask of the words inside any verified window, and the items found."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        for size, (ordered, by_hash) in self.sizes.items():
            for start in range(0, len(words) - size + 1, _STEP):
                runs = window_hashes(hashes[start:start + _STEP + size - 1], size)
                place = np.minimum(np.searchsorted(ordered, runs), len(ordered) - 1)
                for i in np.flatnonzero(ordered[place] == runs):
                    at = start + int(i)
                    text = b" ".join(words[at:at + size])
                    for window, found in by_hash[int(runs[i])]:
                        if window == text:
                            hit[at:at + size] = True
                            items.update(found)
        return hit, items


def spans_of(mask: np.ndarray) -> list[list[int]]:
    """[start, end) runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


def _hit_row(n_words: int, mask: np.ndarray, items: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, int(mask.sum()), len(items), digest, bool(mask.any()), spans_of(mask)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in HITS.split(", ")])


def hits_column(docs: DataFrame, windows: list, text_col: str = "text"):
    """Column: a struct of ``HITS`` per text, against a broadcast window set."""
    shared = broadcast_plain(docs.sparkSession, windows)

    @pandas_udf(HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, own = WordHashes(), per_worker(shared, WindowSet)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                rows.append(_hit_row(len(words), *own.scan(words, hash_words(words, known))))
            yield _frame(rows)

    return scan(F.col(text_col).cast("binary"))


def _joined_hits(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus a struct ``hits``, with the window set joined by hash instead of broadcast.

    Every document window becomes a row (row key, position, size, hash); the
    equality join with the window table verifies the words themselves.
    """
    key, text = free_name(docs, "row_key"), F.col(text_col).cast("binary")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most the window length
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                hashes = hash_words(words, known)
                for size in sizes:
                    runs = window_hashes(hashes, size).view(np.int64)
                    for lo in range(0, len(runs), 10_000):
                        part = runs[lo:lo + 10_000]
                        at = np.arange(lo, lo + len(part), dtype=np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), row, np.int64)), pa.array(at),
                             pa.array(np.full(len(part), size, np.int32)), pa.array(part),
                             pa.array([b" ".join(words[i:i + size]) for i in at], pa.binary())],
                            names=["row", "at", "size", "h", "words"])

    runs = keyed.select(key, text.alias("text")).mapInArrow(cut, "row long, at int, size int, h long, words binary")
    found = runs.join(windows, ["size", "h", "words"]).select("row", "at", "size", "items")
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("at"),
                                     F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    @pandas_udf(HITS)
    def count(texts: pd.Series, at: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for body, places, names in zip(texts, at, items, strict=True):
            mask = np.zeros(len(words_of(body)), dtype=bool)
            for p in places if places is not None else ():
                mask[p["at"]:p["at"] + p["size"]] = True
            rows.append(_hit_row(len(mask), mask, set(names) if names is not None else set()))
        return _frame(rows)

    met = keyed.join(found, keyed[key] == found["row"], "left")
    return met.select(*(keyed[c] for c in docs.columns), count(text, "at", "items").alias("hits"))


def with_hits(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
              text_col: str = "text", window: int = 10, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, str]:
    """``docs`` plus a struct column of ``HITS``; returns the frame and the column's name.

    The window set is broadcast only if its size in a worker is within
    ``broadcast_bytes``; beyond that it is joined by hash.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    # as built-in objects of a worker: bytes, tuple, list and table entry of a window, and its items' ids
    size = windows.agg(F.sum(F.length("words") + WINDOW_BYTES + ITEM_BYTES * F.size("items"))).first()[0] or 0
    name = free_name(docs, "hits")
    if size <= broadcast_bytes:
        rows = [(r["size"], r["h"], bytes(r["words"]), list(r["items"])) for r in windows.collect()]
        return docs.withColumn(name, hits_column(docs, rows, text_col)), name
    return _joined_hits(docs, windows, text_col).withColumnRenamed("hits", name), name


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
                       text_col: str = "text", item_text_col: str = "text", window: int = 10,
                       broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all
    non-ASCII characters. ``spans`` lists the hit word ranges [start, end).
    Null, empty and word-less texts have no words and no hits; such benchmark
    items have no windows, and items with a null id are ignored. Repeated
    rows are judged each; equal windows of several items count for each item.
    Other columns are ignored; an empty table gives no rows, an empty
    benchmark gives no hits.
    """
    out, hits = with_hits(docs, benchmark, item_col, item_text_col, text_col, window, broadcast_bytes)
    return out.select(F.col(id_col), f"{hits}.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                  item_text_col: str = "text", window: int = 10, remove: str = "documents",
                  broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without benchmark content; the columns stay.

    ``remove="documents"`` drops every document with a hit. ``"spans"`` cuts
    the hit words out of the text (with what stands between them) and keeps
    the rest as it was; documents of which no word is left are dropped.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    out, hits = with_hits(docs, benchmark, item_col, item_text_col, text_col, window, broadcast_bytes)
    if remove == "documents":
        return out.where(~F.col(hits)["contaminated"]).select(*docs.columns)

    @pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not len(s) else cut_words(t, s) for t, s in zip(texts, spans, strict=True)],
                         dtype=object)

    left = out.where((F.col(hits)["n_hit"] == 0) | (F.col(hits)["n_hit"] < F.col(hits)["n_words"]))
    cleaned = cut(F.col(text_col).cast("binary"), F.col(hits)["spans"])
    return left.select(*((F.when(F.col(hits)["contaminated"], cleaned).otherwise(F.col(c)).alias(c)
                          if c == text_col else F.col(c)) for c in docs.columns))


def cut_words(text: bytes, spans) -> str:
    """``text`` without the word ranges ``spans`` and the separators inside them."""
    folded, edges, at = text.translate(_FOLD), [], 0
    for word in folded.split():
        start = folded.index(word, at)
        at = start + len(word)
        edges.append((start, at))
    kept, last = [], 0
    for first, end in spans:
        kept.append(text[last:edges[first][0]])
        last = edges[end - 1][1]
    return b"".join([*kept, text[last:]]).decode("utf-8", "replace")
