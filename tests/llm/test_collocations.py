import random
import re
from collections import Counter

import pytest
from cases import LOWER, documents, edge_rows

from givetide.llm import collocations


def plain(rows, reported=2000, least=10):
    """All phrases counted, scored in whole numbers, and ranked."""
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            totals[lang] += len(w)
            for k in (1, 2, 3):
                f.update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(len(t) == 3 and n >= least and g in (t[:2], t[1:]) and 100 * n >= 50 * a for t, n in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "and", "Straße", "中文", "a-b", "don't", "x", "ÄRGER"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            word = "new york city" if rng.random() < 0.1 else rng.choices(words, [3, 2, 2, 9, 8, 7, 1, 1, 1, 1, 1, 1])[0]
            text += word + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", " "])
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "a", 0))
    return rows


def found(df, **options):
    return sorted(map(tuple, collocations.collocations(df, **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_counting_everything(spark, seed):
    rows = made(seed) + edge_rows()
    assert found(documents(spark, rows)) == plain(rows)


def test_failed_borders_are_expanded_until_closed(spark, monkeypatch):
    rows = made(3)
    monkeypatch.setattr(collocations, "SAMPLE_LEAST", 1 << 40)
    df = documents(spark, rows, False)
    *_, passes = collocations.phrase_counts(df.selectExpr("doc_id as id", "text", "coalesce(lang, 'und') as lang"))
    assert passes == 2
    assert found(df) == plain(rows)


def test_ties_at_the_last_rank_go_by_spelling(spark):
    rows = [(i, " . ".join(f"w{j} v{j}" for j in range(30)), "en", "a", 0) for i in range(10)]
    got = found(documents(spark, rows, False), reported=7)
    assert got == plain(rows, 7)
    assert [r[2] for r in got] == sorted(f"w{j} v{j}" for j in range(30))[:7]


def test_rare_phrases_empty_tables_and_a_long_text(spark):
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, "seen once only", "en", "a", 0)])) == []
    rng = random.Random(4)
    rows = [(1, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(1_200_000)), "en", "a", 0)]
    assert found(documents(spark, rows, False)) == plain(rows)


def test_equal_hashes_are_noticed(spark, monkeypatch):
    rows = made(5, 30)
    salts = []
    full = collocations._full

    def colliding(docs, salt, *rest):
        salts.append(salt)
        counts = full(docs, salt, *rest)
        return counts if salt else counts.withColumn("a", counts["a"] % 2)

    monkeypatch.setattr(collocations, "_full", colliding)
    assert found(documents(spark, rows, False)) == plain(rows)
    assert {0, 1} == set(salts)
