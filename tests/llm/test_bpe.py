import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from crashgrid.llm.bpe import Codec, PairTree, decode_ids, encode_texts, merge_word, read_definition, token_digests
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
draw = random.Random(11)
ODD = ["", " \t\n", "Hello WORLD, it's 12345 o'clock", "<|endoftext|>a<|startoftext|><|endoftext|>", "<|endoftext|",
       "a\x1cb\x85c\u2003d\u00a0e\u3000f", "e\u0301 E\u0301 \u212b ﬁ ΑΣ ΑΣ. İstanbul", "𝔘𝔫𝔦 👩‍👩‍👧 \u200d\ufeff", "\x00\x01\x7f",
       "x" * 3000, "日本語テキスト한국어", "we'll they'RE 'S's", "\u0301a \u0301", "a" * 50 + "\n" * 50, "\u2028\u2029x"]


@pytest.fixture(scope="module")
def codec():
    return Codec(read_definition(PATH))


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def reference(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_odd_and_random_texts(codec):
    latin = "".join(map(chr, range(0x20, 0x180)))
    for text in [draw.choice(latin) + "".join(draw.choice(latin) for _ in range(30)) for _ in range(600)] + list(latin):
        assert np.frombuffer(codec.encode(text.encode()), "<u4").tolist() == reference(text)[0], text
    alphabet = "abcAB zé'1\n\t<|>endoftext ߀Ω\u0301 👍-."
    for text in ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(300)]:
        ids, decoded = reference(text)
        got = codec.encode(text.encode())
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert codec.decode(got) == decoded


def test_tree_merges_equal_a_plain_scan():
    merges = {}
    for rank in range(60):
        merges.setdefault((draw.randrange(8 + rank), draw.randrange(8 + rank)), rank)
    packed = {a << 32 | b: rank for (a, b), rank in merges.items()}
    for _ in range(300):
        word = [draw.randrange(8) for _ in range(draw.randint(0, 40))]
        plain = list(word)
        while True:
            ranked = [(merges[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in merges]
            if not ranked:
                break
            rank, i = min(ranked)
            plain[i:i + 2] = [8 + rank]
        assert merge_word(word, packed, list(range(8, 68))) == plain


def test_tree_updates():
    keys = [5, 3, 9, 3, 7]
    tree = PairTree(list(keys))
    for _ in range(50):
        i, k = draw.randrange(5), draw.randrange(100)
        keys[i] = k
        tree.put(i, k)
        assert tree.least() == min(keys)


def test_wide_nodes_keep_their_minimum():
    for n in (16, 17, 300, 5_000):
        keys = [draw.randrange(1_000) for _ in range(n)]
        tree = PairTree(list(keys))
        for _ in range(100):
            i, k = draw.randrange(n), draw.randrange(1_000)
            keys[i] = k
            tree.put(i, k)
            assert tree.least() == min(keys)


def test_a_usual_word_needs_no_inner_nodes(codec, monkeypatch):
    def walk(*_):
        raise AssertionError("a walk through the tree for a word of one node")

    monkeypatch.setattr(PairTree, "__init__", walk)
    for word in ("oftishnd", "queciónqueta", "undkeitberge", "a", "ab", "reshatea" * 2):
        assert np.frombuffer(codec.encode(word.encode()), "<u4").tolist() == reference(word)[0]


def test_small_chunk_table_gives_the_same_ids():
    small = Codec(read_definition(PATH), room=2)
    text = b"one two three four one five two six seven one"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == reference(text.decode())[0]


def test_operators_and_digests(documents, sample):
    rows = [*sample, (9001, None), (9002, ""), (9003, "twice"), (9003, "twice"), (None, "no id"), (9004, "word " * 60_000)]
    docs = documents(rows)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in token_digests(docs, PATH).collect()}
    want = set()
    for i, t in rows:
        ids, decoded = reference(t)
        want.add((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    few = documents(rows[:5] + rows[-6:-1])
    decoded = decode_ids(encode_texts(few, PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in decoded) == sorted(
        (str(i), reference(t)[1]) for i, t in rows[:5] + rows[-6:-1])
    assert token_digests(docs.limit(0), PATH).count() == 0
