"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly.

The words and word pairs that occur at least ``SAMPLE_LEAST`` times in about one of ``SHARE`` documents are proposed. The
first full pass counts them together with their negative border, which are the phrases that were not proposed but whose
parts were: all other words, all pairs of proposed words, all triples of two proposed pairs. Where a word or pair of the
border turns out to be frequent (the border failed), it is added to the proposals, and another pass counts the phrases
that this admits. Passes end when no border fails, so the result is that of counting everything; the sample decides
only how much is counted, and in how many passes.

Proposals reach the documents as a bit table of a fixed size. Its false positives admit phrases that needn't be counted,
never the reverse. Admission only grows, and a phrase is counted in the first pass that admits it, in all documents.

Each task counts the phrases of a few megabytes of text at a time, and sends each distinct one once. Phrases travel as
the 64-bit hashes of their words with the language; words travel with their spelling, and two words of one hash are
noticed, upon which all is done again with other hashes.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
occur; an empty table gives a result without rows; the ids serve the sample only, so null and repeated ones are fine;
other columns are never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from givetide.llm.common import LOWER, bytes_of, forget, hash_word, mixed, pieces, word_hashes
from givetide.llm.tokens import open_files
from givetide.sources.warehouse import settle

LEAST = 10
COVERED = 50
REPORTED = 2000
SHARE, SAMPLE_LEAST = 4, 2
UNKNOWN = "und"
WINDOW_BYTES = 2 << 20
#: A bit table has 32 bits for each word or pair proposed, but at most this many (8 MB).
MOST_BITS = 26

_LOWER = np.frombuffer(LOWER, np.uint8)
_STOP = np.array([bytes([b]) in (b".", b",", b";", b":", b"!", b"?") or 10 <= b <= 13 for b in range(256)])
_WORD = ~(_STOP | np.array([b in (9, 32) for b in range(256)]))
_PAIR = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "k int, a long, b long, c long, n long, word string, lang string"
KEYS = ["k", "a", "b", "c", "word", "lang"]


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _PAIR + b)


class Sieve:
    """A bit table of hashes, loaded from a settled table (slot, bits)."""

    def __init__(self, folder: str, bits: int):
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << (bits - 6), np.uint64)
        if not folder:
            return
        files, path = open_files(folder)
        found = pq.read_table(path, filesystem=files)
        self.table[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


_sieves: dict[str, Sieve] = {}


def load(*wanted: tuple[str, int]) -> list[Sieve]:
    """The bit tables of a task; a worker keeps no others."""
    for folder in _sieves.keys() - {folder for folder, _ in wanted}:
        del _sieves[folder]
    for folder, bits in wanted:
        if folder not in _sieves:
            _sieves[folder] = Sieve(folder, bits)
    return [_sieves[folder] if folder else Sieve(folder, bits) for folder, bits in wanted]


def sieve_of(members: DataFrame, bits: int, before: DataFrame | None = None) -> tuple[DataFrame, tuple[str, int]]:
    """The bit table of members (a) or (a, b), united with an earlier one of the same size."""
    pairs = len(members.columns) > 1

    def place(batches):
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            at = (pair_hashes(a, batch.column(1).to_numpy().view(np.uint64)) if pairs else a) >> np.uint64(64 - bits)
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "bits"])

    rows = members.mapInArrow(place, "slot int, bits long")
    if before is not None:
        rows = rows.unionByName(before)
    settled = settle(rows.groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")))
    files = settled.inputFiles()
    return settled, (files[0].rsplit("/", 1)[0] if files else "", bits)


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Hashes of all words, some thousand at a time, so that the running sums behind them stay short."""
    found = np.zeros(len(begins), np.uint64)
    for i in range(0, len(begins), step):
        b, e = begins[i : i + step], ends[i : i + step]
        found[i : i + step] = word_hashes(data[b[0] : e[-1]], b - b[0], e - b[0])
    return found


class Texts:
    """The words of a batch of texts: hashes with the language, spellings, and which of them follow directly."""

    def __init__(self, batch: pa.RecordBatch, salt: int):
        data, offsets = bytes_of(batch.column("text"))
        self.data = _LOWER[data]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = _WORD[self.data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        here = word[1:-1]
        self.begins = np.flatnonzero(here & (~word[:-2] | first[:-1]))
        self.ends = np.flatnonzero(here & (~word[2:] | first[1:])) + 1
        doc = np.searchsorted(offsets, self.begins, "right") - 1
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = lang.indices.to_numpy()[doc]
        salts = np.array([hash_word(f"{salt}\0{x}".encode()) for x in self.langs], np.uint64)
        self.hashes = mixed(_word_hashes(self.data, self.begins, self.ends) + salts[self.lang])
        stops = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(_STOP[self.data], out=stops[1:])
        #: Whether word i + 1 follows word i in the same piece.
        self.follows = (doc[1:] == doc[:-1]) & (stops[self.begins[1:]] == stops[self.ends[:-1]])

    def spelling(self, i: int) -> str:
        return self.data[self.begins[i] : self.ends[i]].tobytes().decode()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _rows(k: int, hashes: list[np.ndarray], n, word=None, lang=None) -> pa.RecordBatch:
    size = len(n)
    columns = [h.view(np.int64) for h in hashes] + [np.zeros(size, np.int64)] * (3 - len(hashes))
    none = pa.nulls(size, pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, k, np.int32)), *map(pa.array, columns), pa.array(np.asarray(n, np.int64)),
         none if word is None else pa.array(word, pa.string()), none if lang is None else pa.array(lang, pa.string())],
        ["k", "a", "b", "c", "n", "word", "lang"],
    )


def _pairs(texts: Texts, codes: np.ndarray, distinct: np.ndarray, admitted: np.ndarray) -> pa.RecordBatch:
    size = len(distinct)
    keys, n = _counted((codes[:-1] * size + codes[1:])[admitted])
    return _rows(2, [distinct[keys // size], distinct[keys % size]], n)


def _triples(texts: Texts, codes: np.ndarray, distinct: np.ndarray, admitted: np.ndarray) -> pa.RecordBatch:
    size = len(distinct)
    at = np.flatnonzero(admitted)
    front, back = codes[at] * size + codes[at + 1], codes[at + 2]
    if size < 1 << 21:
        keys, n = _counted(front * size + back)
        front, back = keys // size, keys % size
    else:
        fronts, place = np.unique(front, return_inverse=True)
        keys, n = _counted(place * size + back)
        front, back = fronts[keys // size], keys % size
    return _rows(3, [distinct[front // size], distinct[front % size], distinct[back]], n)


def _sampled(docs: DataFrame, salt: int) -> DataFrame:
    """Words and pairs of a sample of the documents that occur often enough to be proposed."""

    def count(batches):
        for batch in pieces(batches, "text", WINDOW_BYTES):
            t = Texts(batch, salt)
            if not len(t.hashes):
                continue
            distinct, codes, n = np.unique(t.hashes, return_inverse=True, return_counts=True)
            yield _rows(1, [distinct], n)
            yield _pairs(t, codes, distinct, t.follows)

    sample = docs.filter(F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(SHARE)) == 0).select("text", "lang")
    return settle(sample.mapInArrow(count, COUNTED).groupBy("k", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= SAMPLE_LEAST))


def _full(docs: DataFrame, salt: int, words, pairs, earlier=None) -> DataFrame:
    """One pass: counts of the phrases admitted by (words, pairs) and not by the earlier proposals.

    The first pass also counts all words, and the words of each language (k = 0).
    """

    def count(batches):
        by_word, by_pair, *before = load(words, pairs, *(earlier or ()))
        for batch in pieces(batches, "text", WINDOW_BYTES):
            t = Texts(batch, salt)
            if not len(t.hashes):
                continue
            if earlier is None:
                distinct, index, codes, n = np.unique(t.hashes, return_index=True, return_inverse=True, return_counts=True)
                yield _rows(1, [distinct], n, [t.spelling(i) for i in index], [t.langs[i] for i in t.lang[index]])
                of_lang = np.bincount(t.lang, minlength=len(t.langs))
                yield _rows(0, [], of_lang, None, t.langs)
            else:
                distinct, codes = np.unique(t.hashes, return_inverse=True)
            known = by_word.has(distinct)[codes]
            two = t.follows & known[1:] & known[:-1]
            paired = pair_hashes(t.hashes[:-1], t.hashes[1:])
            proposed = t.follows & by_pair.has(paired)
            three = proposed[1:] & proposed[:-1]
            if earlier is not None:
                known = before[0].has(distinct)[codes]
                two &= ~(known[1:] & known[:-1])
                proposed = before[1].has(paired)
                three &= ~(proposed[1:] & proposed[:-1])
            if two.any():
                yield _pairs(t, codes, distinct, two)
            if three.any():
                yield _triples(t, codes, distinct, three)

    counts = docs.select("text", "lang").mapInArrow(count, COUNTED).groupBy(*KEYS).agg(F.sum("n").alias("n"))
    return settle(counts.filter((F.col("k") < 2) | (F.col("n") >= LEAST)))


def _missed(members: DataFrame, sieve: tuple[str, int]) -> DataFrame:
    """Those of the frequent words (a) or pairs (a, b) that weren't proposed: the failures of the border."""

    def check(batches):
        (table,) = load(sieve)
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            keys = pair_hashes(a, batch.column(1).to_numpy().view(np.uint64)) if batch.num_columns > 1 else a
            yield batch.filter(pa.array(~table.has(keys)))

    return settle(members.mapInArrow(check, members.schema))


def _bits(n: int) -> int:
    return int(min(MOST_BITS, max(16, (32 * n).bit_length())))


def phrase_counts(docs: DataFrame, salt: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Counts of rows (id, text, lang): totals (lang, n), frequent words (a, word, lang, n), pairs (a, b, n) and triples
    (a, b, c, n), and the number of passes after the first that border failures took."""
    sample = _sampled(docs, salt)
    n = {r["k"]: r["n"] for r in sample.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    word_bits, pair_bits = _bits(n.get(1, 0)), _bits(n.get(2, 0))
    words_, words = sieve_of(sample.filter("k = 1").select("a"), word_bits)
    pairs_, pairs = sieve_of(sample.filter("k = 2").select("a", "b"), pair_bits)
    passes = [_full(docs, salt, words, pairs)]
    found = passes[0].filter("k = 1")
    if not found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return phrase_counts(docs, salt + 1)
    frequent = found.filter(F.col("n") >= LEAST)
    new_words = _missed(frequent.select("a"), words)
    new_pairs = _missed(passes[0].filter("k = 2").select("a", "b"), pairs)
    while not (new_words.isEmpty() and new_pairs.isEmpty()):
        earlier = (words, pairs)
        words_, words = sieve_of(new_words, word_bits, words_)
        pairs_, pairs = sieve_of(new_pairs, pair_bits, pairs_)
        passes.append(_full(docs, salt, words, pairs, earlier))
        new_words = new_words.limit(0)
        new_pairs = _missed(passes[-1].filter("k = 2").select("a", "b"), pairs)
    forget(sample)
    counts = passes[0]
    for more in passes[1:]:
        counts = counts.unionByName(more)
    return (
        counts.filter("k = 0").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"),
        frequent.select("a", "word", "lang", "n"),
        counts.filter("k = 2").select("a", "b", "n"),
        counts.filter("k = 3").select("a", "b", "c", "n"),
        len(passes) - 1,
    )


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: the products are decimals of up to 38 digits."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({big('f')} * {big('f')} * 1000000) div ({big(left)} * {big(right)})")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reported: int = REPORTED) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Scores are floored before they are compared; of equal cuts the one with the shorter first part counts. Phrases of
    equal score and count are in the byte order of their spelling, so ranks never tie.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    totals, words, pairs, triples, _ = phrase_counts(rows)
    word = lambda key, n: words.select(F.col("a").alias(key), F.col("n").alias(n))
    longer = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    longer = longer.groupBy("a", "b").agg(F.max("n").alias("longer"))
    two = (
        pairs.withColumnRenamed("n", "f")
        .join(longer, ["a", "b"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("f")))
        .join(word("a", "l"), "a")
        .join(word("b", "r"), "b")
        .select("a", "b", F.lit(None).cast("long").alias("c"), "f", "l", "r", _score("l", "r").alias("score"))
    )
    three = (
        triples.withColumnRenamed("n", "f")
        .join(pairs.select("a", "b", F.col("n").alias("ab")), ["a", "b"])
        .join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc")), ["b", "c"])
        .join(word("a", "first"), "a")
        .join(word("c", "last"), "c")
        .withColumns({"one": _score("first", "bc"), "two": _score("ab", "last")})
        .select(
            "a", "b", "c", "f",
            F.when(F.col("one") <= F.col("two"), F.col("first")).otherwise(F.col("ab")).alias("l"),
            F.when(F.col("one") <= F.col("two"), F.col("bc")).otherwise(F.col("last")).alias("r"),
            F.least("one", "two").alias("score"),
        )
    )
    spelled = words.select(F.col("a"), F.col("word").alias("word_a"), "lang")
    scored = two.unionByName(three).join(spelled, "a")
    # Ranked by numbers first, ties kept, so that only few phrases are spelled out.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    few = scored.withColumn("_place", F.rank().over(by_score)).filter(F.col("_place") <= reported).drop("_place")
    other = lambda key: words.select(F.col("a").alias(key), F.col("word").alias(f"word_{key}"))
    phrases = few.join(other("b"), "b").join(other("c"), "c", "left").withColumn("phrase", F.concat_ws(" ", "word_a", "word_b", "word_c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.col("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
