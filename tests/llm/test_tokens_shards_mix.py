import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from givetide.llm import mixing, shards, tokens
from givetide.llm.common import running
from givetide.sources.warehouse import run_folder
from cases import documents, edge_rows, prose, words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_files_hold_what_the_tokenizer_says(spark, tokenizer):
    rows = edge_rows()
    got = tokens.token_files(documents(spark), PATH).orderBy("start").collect()
    ids = {i: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for i, r in enumerate(rows)}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    want = sorted((str(r[0]), len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_shards_are_mapped_and_bases_are_prefix_sums(spark, tokenizer):
    rows = prose(1, 300)
    folder = f"{run_folder(spark)}/tokens-test"
    manifest = tokens.write_tokens(documents(spark, rows, False), folder, PATH, shard_bytes=20_000).orderBy("shard").collect()
    assert len(manifest) > 3
    assert [m["base"] for m in manifest] == list(np.cumsum([0] + [m["ids"] for m in manifest])[:-1])
    texts = {r[0]: r[1] for r in rows}
    seen = []
    for m in manifest:
        s = tokens.Shard(folder, m["shard"], m["width"])
        assert s.ids.dtype == np.dtype("<u2")
        assert s.offsets.dtype == np.dtype("<i8")
        for i, doc in enumerate(s.docs.tolist()):
            assert tokenizer.decode(s[i][:-1].tolist()) == texts[doc]
            seen.append(doc)
    assert seen == sorted(texts)


def test_no_documents_no_tokens(spark):
    assert tokens.token_files(documents(spark, []), PATH).count() == 0


def test_pieces_are_encoded_as_whole_texts_are(tokenizer, monkeypatch):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\tab'.éß1!_ 中") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["", " ", "\n", " a", "\u3000a", "a\0b", "a<|endoftext|>b", "x " * 5000, "ab"]
    encoder = tokens.Encoder(PATH)
    for size in (tokens.CUT_BYTES, 100):
        monkeypatch.setattr(tokens, "CUT_BYTES", size)
        for got, text in zip(encoder.batch(pa.array(texts)), texts, strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.batch(pa.array([], pa.string())) == []


def test_shards(spark):
    rows = edge_rows() + [(1000 + i, "copy " * 50, "en", "a", 0) for i in range(120)]
    got = shards.shard_documents(documents(spark, rows), 6).collect()
    weigh = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r[0]), weigh(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    of_text = {}
    for r in got:
        of_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in of_text.items() if k[1] > 8)
    for n in range(6):
        slots = sorted(r["slot"] for r in got if r["shard"] == n)
        assert slots == list(range(len(slots)))
    assert shards.shard_documents(documents(spark, [])).count() == 0


def test_shards_are_nearly_equal(spark):
    got = shards.shard_documents(documents(spark, prose(2, 900), False), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8
    assert max(sizes) - min(sizes) < 0.01 * max(sizes)


def test_best_fit_takes_the_tightest_bin():
    assert shards.best_fit([4, 6, 3, 5], 10) == [0, 0, 1, 1]
    assert shards.best_fit([7, 6, 3, 4], 10) == [0, 1, 0, 1]
    assert shards.best_fit([20, 5], 10) == [0, 1]
    assert shards.packed([], 3) == []
    assert max(shards.packed([5, 5, 4, 4, 3, 3], 2)) == 1


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    from pyspark.sql import functions as F

    got = {r["o"]: r["before"] for r in running(df, "g", [F.col("o")], "v").collect()}
    total = {}
    for g, o, v in rows:
        assert got[o] == total.get(g, 0)
        total[g] = total.get(g, 0) + v


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and free and rest * weight[s] / free > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        capped |= over


@pytest.mark.parametrize("rows", [edge_rows(), prose(3, 400), [*prose(4, 60), (9999, "one two", "en", "tiny", 0)]])
def test_mix(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] <= 3 * r["size"]
        assert not r["size"] or r["taken"] % r["size"] == 0
    for s, target in targets.items():
        of = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in of) - target) <= max(r["size"] for r in of) / 2 + 1e-6
        times = {r["taken"] // r["size"] for r in of if r["size"]}
        assert not times or max(times) - min(times) <= 1
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(len(words(r["text"])) for r in got.collect()) == taken
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "w " * 10, "en", "a" if i < 400 else "b", 20) for i in range(800)]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(800)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(documents(spark, rows, False), mixing.quality_weights(labels)).filter("source = 'a' and taken > 0").collect()
    good = sum(r["doc_id"] % 2 for r in got)
    assert good > 0.6 * len(got)
