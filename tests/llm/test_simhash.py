import random
import re

import pytest
import xxhash
from crashgrid.llm.components import connected_components
from crashgrid.llm.simhash import keep_one_per_component, near_links, segment_bounds, simhash_components

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "a b c " * 20_000), (7, "É é c d"),
        (7, "É é c d"), (None, "One two"), (None, "only null ids here please"), (None, "only null ids here please"),
        (8, "x" * 50_000)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints, max_bits=3):
    label = list(range(len(prints)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None)
             for r in roots}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[roots[i]]) for i in range(len(rows))), key=str)


def test_matches_brute_force_on_sample_and_edge_cases(documents, sample):
    rows = sample + [((i or 0) + 10_000 if i else None, t) for i, t in EDGE]
    got = simhash_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


@pytest.mark.parametrize("max_bits", [1, 2, 3, 5])
def test_links_connect_exactly_the_close_fingerprints(spark, max_bits):
    draw = random.Random(max_bits)
    prints = {draw.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:  # dense neighbourhoods, larger than a block
        for _ in range(6):
            for _ in range(draw.randint(1, max_bits + 1)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), max_bits, block_rows=4)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    got = [roots.get(p, p) for p in signed]
    want = plain_components(prints, max_bits)
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert groups(got) == groups(want)


def test_segments_cover_64_bits_and_leave_one_with_a_single_difference():
    for bits in range(8):
        bounds = segment_bounds(bits)
        assert sum(w for _, w in bounds) == 64 and bounds[0][0] == 0
        assert bits < 2 * len(bounds)


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(100, 400)] + [(5, 5), (None, 4)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    out = connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()
    assert {r["root"] for r in out if r["node"] <= 400} == {100}
    assert {r["root"] for r in out if r["node"] >= 1000} == {1000}
    assert len(out) == 301 + 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_component_stays(documents):
    kept = keep_one_per_component(documents(EDGE))
    assert kept.columns == documents([]).columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [i for i, _ in rows] == [1, 4, 6, 7, 8, None]
    assert rows[-1][1] == "only null ids here please"


def test_empty_table(documents):
    assert simhash_components(documents([])).count() == 0
    assert keep_one_per_component(documents([])).count() == 0
