import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from givetide.llm import extract, lm, topk
from givetide.llm.dom import features, parse
from cases import documents, edge_rows, prose, words

PAGES = "page_id long, url string, html string, text string, n_chars long"


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return extract.train(spark, pages)


def test_held_out_layouts(model):
    made = extract.PageMaker(["Some words of a sentence, which ends here.", "Ab cd ef gh.", "The fox jumped over it."], 0)
    right = total = 0
    for seed in range(50_000, 50_150):
        made.random = random.Random(seed)
        nodes = parse(made.page())
        kept = extract.decode(nodes, model.margin(np.array(features(nodes))))
        for n, k in zip(nodes, kept, strict=True):
            if n.tag == "#text":
                total += 1
                right += k == (n.truth == "keep")
            assert n.parent < 0 or kept[n.parent] or not k
    assert right / total > 0.97


def test_main_text_of_the_given_pages(spark, model):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in extract.main_text(spark, pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_page_edge_cases(spark, model):
    long = "<article>" + "<p>Words of a long page, one after the other.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "Deep." + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>"), (3, "u", "<script>x"), (4, None, long), (4, None, long), (5, "u", deep), (6, "u", "</p></b><![CDATA[x]]><!-- y"), (7, "u", "<a href='x>y'>")]
    frame = spark.createDataFrame([(*r, "other", 0) for r in rows], PAGES)
    got = extract.main_text(spark, frame, model).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == texts[3] == texts[6] == ""
    assert texts[4].count("\n") == 19_999
    assert extract.main_text(spark, frame.limit(0)).count() == 0


def test_blocks_and_references():
    blocks = lambda page: [n.text for n in parse(page) if n.tag == "#text"]
    assert blocks("<p>a&amp;b <b>c</b>\n d<p>e<br>f</p>g") == ["a&b c d", "e f", "g"]
    assert blocks("<ul><li>a<li>b</ul><script>if (x < 1) '</p>'</script>c") == ["a", "b", "c"]
    assert blocks("<head><title>t</title></head><table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("x &lt;p&gt; &copy; &#65;&nbsp;&nbsp;y") == ["x <p> © A y"]


def brute_top(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append(tuple(math.floor(64 * x) for x in v))
    out = []
    for i, vs in good.items():
        if i % every == 0:
            q = min(vs)
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, w in good.items() if j != i for v in w if len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 60])
def test_top_k_equals_brute_force(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(200)]  # one very common vector
    rows += [(None, rows[1][1]), (800, None), (820, []), (840, [1.0, None]), (860, [float("nan")] * 8), (880, [float("inf")] * 8), (900, [0.5, 0.5]), (920, [0.25, -0.5]), (940, rows[2][1]), (940, rows[4][1])]
    frame = spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<double>, shard int, score double")
    got = topk.top_k(frame, k=20, every=20, shard=shard)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 20)


@pytest.mark.parametrize("shard", [4096, 60, 20])
def test_a_repeated_query_id_in_distant_shards(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(i + 1, [float(x) for x in rng.normal(0, 0.3, 4) + 5 * (i % 2 * 2 - 1) * np.array([1, 0, 0, 0])]) for i in range(400)]
    rows += [(1000, [5.0, 0.1, 0.2, 0.3]), (1000, [-5.0, 0.1, 0.2, 0.3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, k=20, every=20, shard=shard).collect())) == brute_top(rows, 20, 20)


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame).count() == 0


@pytest.mark.parametrize("rows", [edge_rows(), prose(7, 400)])
def test_language_model(spark, rows):
    got = lm.score_texts(documents(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*words(r[1]), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), held(r[0]), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for r, t in zip(rows, tokens, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert all((r["bits_per_byte"] is None) == (r["n_tokens"] == 1 and not r["base_score"] == 0) or r["bits_per_byte"] is not None for r in got)


def test_language_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score_texts(docs).filter("held_out").collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_how_documents_are_dealt(spark, monkeypatch):
    rows = [(i, r[1] + " " + r[1] if i % 3 else r[1], *r[2:]) for i, r in enumerate(prose(8, 200))]
    score = lambda: {r["doc_id"]: r["score"] for r in lm.score_texts(documents(spark, rows)).collect()}
    whole = score()
    monkeypatch.setattr(lm, "BLOCK_BYTES", 10_000)
    assert score() == pytest.approx(whole, rel=1e-6)


def test_language_model_of_nothing(spark):
    assert lm.score_texts(documents(spark, [])).count() == 0


def bit_counts(*tokens):
    batch = pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.binary())})
    return np.concatenate([np.frombuffer(b["counts"][0].as_py(), np.float32) for b in lm._bit_counts([batch])])


def test_all_of_a_long_word_is_learned():
    long = bytes(range(97, 123)) * 4
    assert (bit_counts(long) == bit_counts(long[:40], long[40:80], long[80:])).all()
    assert bit_counts(long).sum() == lm.ORDERS * 8 * (len(long) + 3)


def test_weights_and_map_are_learned_from_all_training_words(spark, monkeypatch):
    rows = [(i, f"{r[1]} {'long' * 12}{i} w{i}x", *r[2:]) for i, r in enumerate(prose(9, 60))]
    seen, learned = [], lm._learned
    monkeypatch.setattr(lm, "_learned", lambda known, path: seen.append((known, path, learned(known, path))) or seen[0][2])
    lm.score_texts(documents(spark, rows))
    known, path, (weights, refined) = seen[0]
    stretches = [w[a : a + 40] for w, in known.select("token").collect() if bytes(w) != lm.END for a in range(0, len(w), 40)]
    mixer = lm.Mixer(lm._load_counts(path))
    mixer.learn(list(map(bytes, stretches)))
    assert weights == pytest.approx(mixer.weights, abs=1e-4) and refined == pytest.approx(mixer.refined, abs=1e-2)
    # The map's sums hold every bit of every training word.
    total = mixer.sums(list(map(bytes, stretches)), True)
    assert total[: len(total) // 2].sum() == pytest.approx(8 * sum(len(w) + 1 for w in stretches))


def test_whole_word_contexts_have_a_table_that_grows_with_the_words():
    draw = random.Random(4)
    words = [*{bytes(draw.choices(range(97, 123), k=9)) for _ in range(20_000)}, b"ab", b"abc"]
    ended = [w + b" " for w in words]
    contexts = {(w[:j], 256 + w[j] >> 8 - bit) for w in ended for j in range(lm.HEAD, len(w)) for bit in range(8)}
    counts = lm.own_counts(words).reshape(-1, 2)
    # More than one of the common tables has slots, and most have a slot apart, though these words share little.
    assert len(contexts) > 4 << lm.BITS
    assert 0.6 * len(contexts) < (counts.sum(axis=1) > 0).sum() <= len(contexts)
    assert counts.sum() == 8 * sum(len(w) - lm.HEAD for w in ended)
    assert lm.own_counts([b"ab", b""]).sum() == 0


def test_each_part_counts_all_words_that_begin_alike(spark, monkeypatch):
    rows = [(i, f"{r[1]} {'long' * 12}{i} w{i}x", *r[2:]) for i, r in enumerate(prose(9, 60))]
    seen, learned = [], lm._learned
    monkeypatch.setattr(lm, "_learned", lambda known, path: seen.append((known, path)) or learned(known, path))
    score = lambda: {r["doc_id"]: r["score"] for r in lm.score_texts(documents(spark, rows)).collect()}
    whole = score()
    monkeypatch.setattr(lm, "PART_BYTES", 5_000)
    in_parts = score()
    known, path = seen[1]
    parts = {}
    for r in known.select("part", "token").collect():
        parts.setdefault(r["part"], []).append(bytes(r["token"]))
    assert len(parts) > 5 and len({(p, w[: lm.HEAD]) for p, words in parts.items() for w in words}) == len({w[: lm.HEAD] for words in parts.values() for w in words})
    for part, words in parts.items():
        stretches = [w[a : a + 40] for w in words if w != lm.END for a in range(0, len(w), 40)]
        assert lm._load_own(path, part).sum() == 8 * sum(max(len(w) + 1 - lm.HEAD, 0) for w in stretches)
    assert lm._load_own(path, 1_000_000).sum() == 0
    # What is left are the contexts that share a slot.
    assert sum(in_parts.values()) == pytest.approx(sum(whole.values()), rel=0.01)


def test_spelling_costs_are_those_of_a_distribution():
    counts = np.random.default_rng(2).integers(0, 9, lm.ORDERS << lm.BITS + 1).astype(np.float32)
    mixer = lm.Mixer(counts)
    mixer.learn([b"one", b"two", b"three", b"four"] * 5)
    first = [bytes([b]) for b in range(256) if b != 32]
    # All first bytes with any continuation, the end of the word included, share the probability of one.
    spelling = lm.Spelling(first, False)
    total = np.zeros(len(spelling.byte))
    for number, bit, slots in spelling.bits():
        x, trusted = mixer._inputs(slots) if mixer.stretched is not None else (mixer.prepare(), mixer._inputs(slots))[1]
        gate = number * (lm.ORDERS + 1) + trusted
        mixed = (mixer.weights[gate] * x).sum(axis=1)
        final = (mixed + mixer._map(gate, mixed)[2]) / 2
        total -= np.logaddexp(0, np.where(bit == 1, -final, final))
    p_first = np.exp(total[spelling.at == 0]).sum()
    p_end = 2.0 ** lm.spelled(mixer, [b""])[0]
    assert p_first + p_end == pytest.approx(1, abs=1e-6)
    words = [b"abc", b"abd", b"abd", b"b", b"one", b"x" * 95]
    alone = [lm.spelled(mixer, [w])[0] for w in words]
    assert np.allclose(lm.spelled(mixer, words), alone)


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_a_block_counts_its_words_slice_by_slice(monkeypatch, size):
    monkeypatch.setattr(lm, "SLICE_BYTES", size)
    texts = ["A b\x0ba  c ", None, "", " b\x1cb É\u0085 ", "a", "B c a"]
    held, kinds = [False, False, True, False, True, False], [0, 0, 1, 5, 0, 5]
    block = pa.table({"block": pa.array([7] * 6, pa.int32()), "text": pa.array(texts), "held_out": held, "class": pa.array(kinds, pa.int32())})
    want = {}
    for text, h, k in zip(texts, held, kinds, strict=True):
        for w in [*(text or "").encode().lower().split(), lm.END]:
            want.setdefault(w, Counter())[k] += not h
    got = lm._block_counts([0, 1, 5])(block)
    # Counts of classes that no document has aren't moved.
    assert got.column_names == ["block", "token", "n0", "n1", "n5"] and set(got["block"].to_pylist()) == {7}
    assert {r["token"]: (r["n0"], r["n1"], r["n5"]) for r in got.to_pylist()} == {w: (c[0], c[1], c[5]) for w, c in want.items()}
    assert got.num_rows == len(want)


def test_sums_by_column_equal_those_of_rows():
    draw = np.random.default_rng(5)
    mixer = lm.Mixer(np.zeros(0, np.float32))
    mixer.weights = draw.normal(size=mixer.weights.shape).astype(np.float32)
    gate, x = draw.integers(0, len(mixer.weights), 5000), draw.normal(size=(5000, lm.ORDERS)).astype(np.float32)
    assert (mixer._mixed(gate, x) == (mixer.weights[gate] * x).sum(axis=1)).all()
    rows = draw.normal(size=(5000, lm.LANGUAGES + 1))
    assert (lm._over_classes(rows) == rows.sum(axis=1)).all()
    assert (lm._over_classes(rows, np.maximum) == rows.max(axis=1)).all()
    at = np.array([-np.inf, -800, -40, -1e-9, 0, 1e-9, 3, 40, 800, np.inf])
    assert np.allclose(lm._softplus(at), np.logaddexp(0, at), rtol=1e-15, atol=0)
