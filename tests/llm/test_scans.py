import random
import re
from collections import Counter

import numpy as np
import pytest

from givetide.llm import decontaminate, licenses, quality
from cases import LOWER, documents, edge_rows, prose, syllables

LABELS = "doc_id long, quality int, toxic int"


def test_base_phrases_equal_a_plain_scan(spark):
    rng = random.Random(4)
    filler = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC", "By", "é"]
    rows = edge_rows() + [(100 + i, "".join(rng.choice(filler) + rng.choice([" ", "-", "\n", ". ", "_"]) for _ in range(rng.randint(1, 60))), "en", "a", 0) for i in range(300)]
    got = {}
    for r in licenses.scan_licenses(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    want = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.setdefault(i, []).append((len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


@pytest.mark.parametrize("label", list(licenses.TEMPLATES))
def test_each_notice_is_found_in_its_own_words(spark, label):
    text, keys = licenses.TEMPLATES[label]
    rng = random.Random(6)
    rows = [(1, syllables(rng, 30) + ". " + text.capitalize() + ". " + syllables(rng, 30), "en", "a", 0), (2, syllables(rng, 50), "en", "a", 0)]
    rows += [(3 + i, syllables(rng, 20), "en", "a", 0) for i in range(20)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, rows, False)).collect()}
    assert label in got[1]["labels"].split(",")
    assert got[1]["score"] == pytest.approx(1.0)
    assert got[2]["labels"] == ""


def test_mandatory_phrases_are_needed(spark):
    rows = [(1, "licensed under the x license version 2 0", "en", "a", 0), (2, "Licensed under the Apache License, Version 2.0 of", "en", "a", 0)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(documents(spark, rows, False)).collect()}
    assert got == {1: "", 2: "apache-2.0"}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(7)
    for _ in range(300):
        pattern = [rng.randrange(5) for _ in range(rng.randint(1, 90))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 60))]
        assert decontaminate.myers(pattern, text)[0] == distance(pattern, text)


def brute_matches(rows, items, rate):
    read = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = []
    for i, text, *_ in rows:
        w = read(text)
        for item, t in items:
            p = read(t)
            if p and (d := distance(p, w)) <= int(len(p) * rate):
                found.append((i, item, d))
    return sorted(found, key=str)


def test_benchmark_matches_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, syllables(rng, rng.randint(6, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "tiny item"), (None, syllables(rng, 12)), (3, syllables(rng, 9))]
    rows = []
    for i in range(120):
        text = syllables(rng, rng.randint(0, 80)).split()
        if i % 2:
            item = rng.choice(items)[1] or ""
            w = item.upper().split() if i % 4 == 1 else item.split()
            for _ in range(rng.randint(0, max(1, len(w) // 4))):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [w[k], "extra"], ["other"]])
            k = rng.randint(0, len(text))
            text[k:k] = w
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text), "en", "a", 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = decontaminate.benchmark_matches(docs, benchmark).collect()
    want = brute_matches(rows, [x for x in items if x[1]], decontaminate.RATE)
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}, key=str) == sorted({w[:2] for w in want}, key=str)
    kept = decontaminate.benchmark_matches(docs, benchmark, keep=True)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({r[0] for r in rows} - {w[0] for w in want})


def test_matching_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontaminate.benchmark_matches(documents(spark), none).count() == 0
    assert decontaminate.benchmark_matches(documents(spark, []), some).count() == 0
    assert decontaminate.benchmark_matches(documents(spark), some).count() == 0
    assert decontaminate.benchmark_matches(documents(spark), none, keep=True).count() == len(edge_rows())


def test_a_benchmark_larger_than_a_block_takes_several_passes(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, syllables(rng, 15)) for i in range(20)]
    rows = [(i, f"{syllables(rng, 10)} {t} {syllables(rng, 10)}", "en", "a", 0) for i, t in items]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    got = decontaminate.benchmark_matches(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(i, i) for i, _ in items}


def test_quality_rejects_junk_and_keeps_clean_text(spark):
    rng = random.Random(10)
    rows, labels, bad = [], [], set()
    for i in range(600):
        text = ". ".join(syllables(rng, 12).capitalize() for _ in range(rng.randint(1, 8)))
        if i % 10 == 0:
            text = "".join(rng.choice(["%%%", "###", "ZQ", "!!", "|", "$"]) for _ in range(200))
            bad.add(i)
        if i < 400:
            labels.append((i, 0 if i in bad else 1, 0))
        rows.append((i, text, "en" if i % 3 else "de", "a", 0))
    frame = spark.createDataFrame([*labels, (None, 1, 0), (77777, 1, 0), (0, None, None)], LABELS)
    got = {r["doc_id"]: r for r in quality.score_documents(documents(spark, rows), frame).collect()}
    assert {i for i, r in got.items() if r["rejected"]} >= bad
    assert sum(r["rejected"] for i, r in got.items() if i not in bad) <= 6
    docs = documents(spark, rows)
    kept = quality.keep_documents(docs, frame)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i, r in got.items() if not r["rejected"])


def test_quality_edge_cases(spark):
    rows = prose(5, 200) + [(r[0] + 5000 if r[0] is not None else None, *r[1:]) for r in edge_rows()]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], LABELS)
    got = quality.score_documents(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["perplexity"] is None) == (r["n_bytes"] == 0)
        assert r["n_bytes"] or not r["rejected"]
    assert not any(r["rejected"] for r in quality.score_documents(documents(spark), spark.createDataFrame([], LABELS)).collect())
    assert quality.keep_documents(documents(spark), spark.createDataFrame([], LABELS)).count() == len(edge_rows())
    assert quality.score_documents(documents(spark, []), labels).count() == 0


def test_quality_tells_junk_in_a_rare_script(spark):
    rng = random.Random(11)
    printable = "".join(map(chr, range(33, 127)))
    cyrillic = "абвгдежзиклмнопрстуфхцчшщыэюя"
    rows = [(i, " ".join("".join(rng.choice(printable) for _ in range(5)) for _ in range(400)), "en", "a", 0) for i in range(600)]
    parts = ("при", "ход", "ство", "ние", "вер", "ло", "на", "ка", "ся")
    rows += [(1000 + i, syllables(rng, 20, parts), "ru", "a", 0) for i in range(400)]
    junk = [(2000 + i, "".join(c if c == " " else rng.choice(cyrillic) for c in syllables(rng, 20, parts)), "ru", "a", 0) for i in range(40)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)
    got = {r["doc_id"]: r["rejected"] for r in quality.score_documents(documents(spark, rows + junk), labels).collect()}
    assert all(got[r[0]] for r in junk)
    assert sum(got[r[0]] for r in rows) <= len(rows) // 50


def test_probabilities_of_a_context_add_up(spark):
    import numpy as np

    texts = spark.createDataFrame([(r[1],) for r in prose(6, 50)], "text string")
    classes = quality.byte_classes(texts)
    model = quality.kneser_ney(quality.gram_counts(texts, classes)).toPandas()
    bits = quality.dense(*[model[c].to_numpy() for c in ("order", "gram", "share", "gamma")]).astype(np.float64)
    sums = np.exp2(-bits).reshape(-1, quality.CLASSES).sum(axis=1)
    assert np.allclose(sums, 1, atol=0.02)


def test_quality_trains_on_every_trusted_document(spark):
    labels = spark.range(30_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    train, held = quality.trusted_ids(labels)
    assert train.unionByName(held).distinct().count() == 30_000
    assert train.count() > 23_000


def test_only_wanted_texts_leave_their_task(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id % 50 = 7, null, id % 2000) as doc_id", "repeat(string(id), 9) as text")
    ids = spark.range(0, 6000, 40).selectExpr("id as doc_id")
    want = sorted(map(tuple, rows.join(ids, "doc_id", "left_semi").collect()))
    found = quality.only(rows, ids)
    assert sorted(map(tuple, found.collect())) == want and found.columns == rows.columns
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    sifted, semi = [], type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, *a, **k: sifted.append(self) or semi(self, *a, **k))
    quality.only(rows, ids)
    assert sifted[0].count() < len(want) * 1.1
    # A table that is too small only lets more rows through to the join.
    monkeypatch.setattr(quality, "ID_BITS", 6)
    assert sorted(map(tuple, quality.only(rows, ids).collect())) == want
    assert quality.only(rows, ids.limit(0)).count() == 0


def test_gram_counts_handed_on_in_parts_add_up(spark, monkeypatch):
    texts = [r[1] for r in prose(8, 60) if r[1]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    classes = np.arange(256, dtype=np.uint32)
    whole = {r["gram"]: r["n"] for r in quality.gram_counts(frame, classes).collect()}
    want = Counter()
    for t in texts:
        padded = b"\n" * 3 + t.encode()
        want.update(int.from_bytes(padded[i - 3 : i + 1], "big") for i in range(3, len(padded)))
    assert whole == want
    monkeypatch.setattr(quality, "MOST_HELD", 50)
    assert {r["gram"]: r["n"] for r in quality.gram_counts(frame, classes).collect()} == want
