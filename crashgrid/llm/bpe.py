"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are leaves; leaf i holds the merge rank of symbol i and its
right neighbour. The root is the lowest rank, leftmost first: the next merge.
A merge updates three leaves, each with a logarithmic walk to the root, until
no pair can merge. Nodes are wide, so a usual word's leaves are right below
the root. Texts are cut at ASCII white space, which no token spans,
and each chunk's ids are kept in a bounded table, so the tree runs once per
distinct chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from itertools import chain
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from tokenizers import Tokenizer

from .shared import broadcast_plain, per_worker

NO_MERGE = 1 << 62


FAN = 16


class PairTree:
    """Minimum tree over (rank, position) keys of adjacent symbol pairs; a node has up to ``FAN`` below it."""

    def __init__(self, keys: list[int]):
        self.levels = levels = [keys]
        while len(keys) > FAN:
            keys = [min(keys[i:i + FAN]) for i in range(0, len(keys), FAN)]
            levels.append(keys)
        self.top = keys  # the nodes right below the root

    def least(self) -> int:
        return min(self.top, default=NO_MERGE)

    def put(self, place: int, key: int) -> None:
        levels = self.levels
        levels[0][place] = key
        for below, nodes in zip(levels, levels[1:]):
            place //= FAN
            key = min(below[place * FAN:place * FAN + FAN])
            if nodes[place] == key:
                return
            nodes[place] = key


def merge_node(symbols: list[int], rank_of, merged: list[int]) -> list[int]:
    """``merge_word`` where the leaves are right below the root: they close up in place and need no positions."""
    keys = [rank_of(a << 32 | b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
    while keys and (least := min(keys)) != NO_MERGE:
        i = keys.index(least)  # the leftmost
        del keys[i], symbols[i + 1]
        symbols[i] = new = merged[least]
        if i < len(keys):
            keys[i] = rank_of(new << 32 | symbols[i + 1], NO_MERGE)
        if i:
            keys[i - 1] = rank_of(symbols[i - 1] << 32 | new, NO_MERGE)
    return symbols


def merge_word(symbols: list[int], merges: dict[int, int], merged: list[int]) -> list[int]:
    """Token ids after all merges; ``merges`` gives the rank by pair (first << 32 | second),
    ``merged`` the new id by rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = merges.get
    if n <= FAN:
        return merge_node(list(symbols), rank_of, merged)
    keys = []
    for i in range(n - 1):
        rank = rank_of(symbols[i] << 32 | symbols[i + 1])
        keys.append(NO_MERGE if rank is None else rank << 32 | i)
    tree = PairTree(keys)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    put, top = tree.put, tree.top
    while (least := min(top)) != NO_MERGE:
        i = least & 0xFFFFFFFF
        j = after[i]
        symbols[i] = new = merged[least >> 32]
        symbols[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, NO_MERGE)
        if k < n:
            before[k] = i
            rank = rank_of(new << 32 | symbols[k])
            put(i, NO_MERGE if rank is None else rank << 32 | i)
        else:
            put(i, NO_MERGE)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 32 | new)
            put(h, NO_MERGE if rank is None else rank << 32 | h)
    return [x for x in symbols if x >= 0]


#: The pattern and normaliser of the tokenizer family that the short cut below covers, and the same
#: pattern for lower-cased words of printable ASCII and Latin-1 letters (fixed values of the format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
BLANK = re.compile(rb"[\x09-\x0d\x20]+")
PLAIN = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")  # without "<", which may start a special token
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|"
                        r"[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Recent(dict):
    """A table of bytes by key that forgets what was not used lately: about ``room`` bytes now, as many before.

    When the entries have grown to ``room`` bytes, ``turn`` puts them behind;
    what is then looked up by ``recall`` comes back, the rest goes at the next
    turn.
    """

    ENTRY = 180  # bytes of an entry besides its key and value

    def __init__(self, room: int):
        super().__init__()
        self.room, self.held, self.before = room, 0, {}

    def turn(self) -> None:
        if self.held > self.room:
            self.before, self.held = dict(self), 0
            self.clear()

    def recall(self, key):
        value = self.before.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value: bytes) -> None:
        self[key] = value
        self.held += len(key) + len(value) + self.ENTRY


def text_pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut at ASCII white space."""
    start = 0
    while len(text) - start > size:
        cut = BLANK.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:] if start else text


class Codec:
    """Encoder and decoder of one tokenizer file of kind BPE with word ends.

    Normalisation and pre-tokenisation are the file's own, through the
    tokenizers library; merging and decoding are done here.
    """

    def __init__(self, definition: str, room: int = 48 << 20):
        spec = json.loads(definition)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["decoder"] is not None or any(
                t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("unsupported tokenizer file: BPE without decoder and with plain added tokens is needed")
        library = Tokenizer.from_str(definition)
        self.normalize = library.normalizer.normalize_str if library.normalizer else (lambda s: s)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if added else None
        self.names = {i: t.encode("utf-8", "replace") for t, i in chain(self.vocab.items(), self.added.items())}
        self.known, self.known_words = Recent(room), Recent(room)
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == NORMALIZERS and parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN
        self.inner = [self.vocab.get(c) for c in byte_symbols()]
        self.final = [self.vocab.get(c + self.suffix) for c in byte_symbols()]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-tokenised word; symbols outside the vocabulary are left out, as the library does."""
        parts = [*word[:-1], word[-1] + self.suffix]
        return merge_word([self.vocab[p] for p in parts if p in self.vocab], self.merges, self.merged)

    def plain_ids(self, text: str) -> bytes:
        """``chunk_ids`` of a chunk of ``PLAIN`` characters, whose normal form is its lower case."""
        known, out = self.known_words, []
        for word in PLAIN_WORD.findall(text.lower()):
            ids = known.get(word)
            if ids is None:
                ids = known.recall(word)
            if ids is None:
                data = word.encode()
                symbols = [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]
                if None in symbols:
                    symbols = [x for x in symbols if x is not None]
                ids = pack_ids(merge_word(symbols, self.merges, self.merged))
                known.keep(word, ids)
            out.append(ids)
        return b"".join(out)

    def chunk_ids(self, chunk: bytes) -> bytes:
        """Little-endian 32-bit ids of a text piece without ASCII white space."""
        text = chunk.decode("utf-8", "replace")
        if self.plain and PLAIN.fullmatch(text):
            return self.plain_ids(text)
        ids: list[int] = []
        for part in self.special.split(text) if self.special and "<" in text else (text,):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word, _ in self.split(self.normalize(part)):
                    if word:
                        ids += self.word_ids(word)
        return pack_ids(ids)

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids of a whole text (UTF-8)."""
        return b"".join(map(self._piece_ids, text_pieces(text))) if text else b""

    def _piece_ids(self, piece: bytes) -> bytes:
        known = self.known
        known.turn()
        self.known_words.turn()
        chunks = piece.split()
        found = list(map(known.get, chunks))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[at]
                    ids = known.get(chunk)  # it may stand twice in the piece
                    if ids is None:
                        ids = known.recall(chunk)
                    if ids is None:
                        ids = self.chunk_ids(chunk)
                        known.keep(chunk, ids)
                    found[at] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """Token texts joined by a space: what the library does without a decoder."""
        return self.decoded_bytes(ids).decode("utf-8")

    def decoded_bytes(self, ids: bytes) -> bytes:
        """``decode`` in UTF-8."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            return b" ".join(map(self.names.__getitem__, numbers))
        except KeyError:
            return b" ".join([self.names[i] for i in numbers if i in self.names])


def read_definition(path: str) -> str:
    """The tokenizer file, read once on the driver; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as source:
        return source.read()


def _codec_of(docs: DataFrame, path: str):
    return broadcast_plain(docs.sparkSession, read_definition(path))


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and ``ids``, the token ids of the whole text.

    Null, empty and blank texts have no ids. Repeated rows are encoded each;
    other columns are ignored; an empty table gives no rows.
    """
    shared = _codec_of(docs, tokenizer_path)

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = per_worker(shared, Codec)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.encode(t), dtype="<i4") for t in texts], dtype=object)

    return docs.select(F.col(id_col), encode(F.col(text_col).cast("binary")).alias("ids"))


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded``; null ids give null, ids outside the vocabulary are left out."""
    shared = _codec_of(encoded, tokenizer_path)

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = per_worker(shared, Codec)
        for rows in batches:
            yield pd.Series([None if r is None else codec.decode(np.asarray(r, dtype="<u4").tobytes())
                             for r in rows], dtype=object)

    return encoded.select(F.col(id_col), decode(F.col(ids_col)).alias("decoded"))


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256 (32-bit little-endian), decoded_sha256.

    Encodes and decodes each text in one pass, so neither ids nor decoded
    texts leave the task. Nulls, repeats and extra columns as in ``encode_texts``.
    """
    shared = _codec_of(docs, tokenizer_path)

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = per_worker(shared, Codec)
        names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
        for texts in batches:
            columns: list[list] = [[], [], []]
            for text in texts:  # one text at a time is a Python object
                ids = codec.encode(text.as_py())
                decoded = codec.decoded_bytes(ids)
                for column, value in zip(columns, (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                                   hashlib.sha256(decoded).hexdigest()), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col), digests(F.col(text_col).cast("binary")).alias("d")).select(id_col, "d.*")
