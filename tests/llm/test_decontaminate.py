import hashlib
import random
import re

import pytest
from crashgrid.llm.decontaminate import cut_words, decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
draw = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(40)] + ["É", "ß9"]


def text_of(n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


ITEMS = [(1, text_of(14)), (2, text_of(30)), (3, "Only Four, Words here"), (4, None), (5, ""), (6, "--"),
         (7, "w1 w2"), (8, text_of(14)), (9, "only four words HERE!"), (None, "lost item")]
ROWS = ([(i, text_of(draw.randint(0, 120))) for i in range(40)]
        + [(100, f"x. {ITEMS[0][1].upper()}; y"), (101, f"{ITEMS[1][1]}\n{ITEMS[0][1]} {ITEMS[0][1]}"),
           (102, "a only-four words_here b"), (103, None), (104, ""), (105, " .. "), (106, "lost item"),
           (107, text_of(30_000) + " " + ITEMS[7][1]), (None, ITEMS[0][1]), (101, ITEMS[0][1]), (101, ITEMS[0][1])])


def brute(rows, items, window=10):
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            grams.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def tables(spark, documents):
    return documents(ROWS), spark.createDataFrame([(i, t, "x") for i, t in ITEMS],
                                                  "item_id long, text string, n_hit string")


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_broadcast_and_joined_window_sets_match_brute_force(tables, budget):
    got = find_contamination(*tables, broadcast_bytes=budget).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, ITEMS)


def test_documents_or_spans_are_removed(tables):
    docs, items = tables
    hit = {str(r[:1]) for r in brute(ROWS, ITEMS) if r[5]}
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str((r["doc_id"],)) for r in kept.collect()) == sorted(str((i,)) for i, _ in ROWS
                                                                         if str((i,)) not in hit)
    cut = decontaminate(docs, items, remove="spans")
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[102] == "a  b"
    again = find_contamination(cut, items).where("n_words >= 10 and n_hit >= 10 and contaminated")
    # what is left holds no window, unless removing one joined the words around it
    assert again.count() <= 1


def test_cut_words_keeps_what_stands_around():
    assert cut_words("A b, c-d é f!".encode(), [(1, 3), (4, 5)]) == "A -d  f!"


def test_empty_tables(spark, tables):
    docs, items = tables
    assert find_contamination(docs.limit(0), items).count() == 0
    none = find_contamination(docs, items.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(ROWS)
