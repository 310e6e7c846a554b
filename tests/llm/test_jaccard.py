import os
import random

import numpy as np
import pytest

from givetide.llm import jaccard
from givetide.llm.graph import components
from cases import documents, edge_rows, prose, syllables, words


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, num, den):
    """(id, set size, component id) of every row, by comparing all pairs."""
    sets = [shingles(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components_equal_all_pairs(spark, width, num, den):
    rows = prose(width, 260) + prose(width + 1, 200, 3, 14)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = jaccard.jaccard_components(documents(spark, rows, False), width=width, num=num, den=den)
    want = brute(rows, width, num, den)
    assert ordered(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == ordered(want)
    assert len({c for _, _, c in want}) < len(rows) - 50


def test_stored_vectors_take_a_byte_for_each_count(spark):
    small, large = np.arange(128, dtype=np.int32) % 7, np.full(64, 300, np.int32)
    stored = [jaccard.packed(small), jaccard.packed(large)]
    assert [len(v) for v in stored] == [129, 257]
    assert (jaccard.folded(stored, 64) == np.stack([small[:64] + small[64:], large])).all()


def test_edge_cases(spark):
    got = jaccard.jaccard_components(documents(spark))
    want = brute(edge_rows(), 3, 90, 100)
    assert ordered(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == ordered(want)
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] if r[0] is not None else -99) for r in kept.select("doc_id").collect())
    # The copies of the first text, two of them without an id or repeated, leave one row; texts without words stay.
    assert ids == [-99, -5, 0, 3, 4, 5, 6, 7, 9, 10, 11, 11, 12]
    assert jaccard.keep_one(documents(spark, [])).count() == 0


def test_a_group_of_many_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = syllables(rng, 300).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    got = jaccard.jaccard_components(documents(spark, rows, False)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_large_trees_are_joined_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 3000)
    rows = prose(8, 150, 60, 120)
    got = jaccard.jaccard_components(documents(spark, rows, False))
    assert ordered(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == ordered(brute(rows, 3, 90, 100))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for n in [*range(1, 60), 100, 333, 1000, 5000]:
            for _ in range(6):
                pool = rng.choice(1 << 62, 2 * n + 50, replace=False).astype(np.uint64)
                a = pool[:n]
                differ = (den - num) * 2 * n // (den + num)
                out = int(rng.integers(0, differ + 1))
                b = np.concatenate([a[out:], pool[n : n + differ - out]])
                both = n - out
                if not len(b) or den * both < num * (n + len(b) - both):
                    continue
                sets = np.concatenate([np.sort(a), np.sort(b)])
                _, keys, of = jaccard.signatures(sets, np.array([0, len(a), len(a) + len(b)]), bands)
                assert set(keys[of == 0]) & set(keys[of == 1]), (n, len(b), both)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_with_keys_are_gone_before_the_shuffle_by_key(spark, monkeypatch):
    """The shuffle by key is the widest: only what it reads and the count vectors may be on disk beside it."""
    held, at_shuffle = {}, []

    def settle(df):
        if "many" in df.columns:
            at_shuffle.extend(columns for columns, folder in held.values() if os.path.isdir(folder))
        settled = jaccard_settle(df)
        files = settled.inputFiles()
        if files:
            folder = files[0].removeprefix("file://").rsplit("/", 1)[0]
            held[folder] = (set(df.columns), folder)
        return settled

    jaccard_settle = jaccard.settle
    monkeypatch.setattr(jaccard, "settle", settle)
    rows = [(i, *r[1:]) for i, r in enumerate(prose(3, 60))]
    jaccard.jaccard_components(documents(spark, rows, False)).collect()
    assert sorted(map(sorted, at_shuffle)) == [["doc_id", "n_shingles", "set_id", "text_id", "vector"], ["keys", "set_id"]]
