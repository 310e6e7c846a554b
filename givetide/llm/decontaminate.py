"""Benchmark decontamination: pigeonhole pieces of test items, verified by bit-parallel edit distance over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import STEP, WORD_BYTES, Finder, Words, mixed, pieces

#: Errors allowed per word of an item; bytes of item text that a task holds at a time.
RATE = 0.3
BLOCK_BYTES = 16 << 20


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where the first such stretch ends.

    Myers' bit-vector algorithm over words in place of letters: one column of the table in a few integer operations.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out += hashes[i : i + len(out)] * np.uint64(pow(STEP, i + 1, 1 << 64))
    return mixed(out)


class Pieces:
    """Every item cut into one piece more than it may have errors: some piece stays whole in any match."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        words = Words(pa.array([t for _, t in items], pa.string()), WORD_BYTES)
        self.items = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for k, (item, _) in enumerate(items):
            w = words.of(k)
            if not len(w):
                continue
            budget = int(len(w) * rate)
            number = len(self.items)
            self.items.append((item, w.tolist(), budget))
            cuts = np.linspace(0, len(w), budget + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                by_length.setdefault(b - a, []).append((int(grams(w[a:b], b - a)[0]), number, a))
        self.finders = {}
        for n, found in by_length.items():
            groups: dict[int, list[tuple[int, int]]] = {}
            for h, number, at in found:
                groups.setdefault(h, []).append((number, at))
            self.finders[n] = (Finder(np.array(list(groups), np.uint64)), list(groups.values()))

    def hits(self, words: Words) -> set[tuple[int, int, int]]:
        """(document, item, place where the item would begin) for each whole piece found in a batch."""
        found = set()
        for n, (finder, groups) in self.finders.items():
            at, which = finder.find(grams(words.hashes, n))
            doc = np.searchsorted(words.bounds, at, "right") - 1
            inside = at + n <= words.bounds[doc + 1]
            for p, g, d in zip(at[inside].tolist(), which[inside].tolist(), doc[inside].tolist(), strict=True):
                found.update((d, number, p - offset) for number, offset in groups[g])
        return found

    def matches(self, words: Words) -> dict[tuple[int, int], tuple[int, int]]:
        """Best (errors, end word) of each (document, item) within the item's budget."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for d, number, start in sorted(self.hits(words)):
            item, pattern, budget = self.items[number]
            low, high = int(words.bounds[d]), int(words.bounds[d + 1])
            if start + len(pattern) + budget <= done.get((d, number), -1):
                continue
            a, b = max(low, start - budget), min(high, start + len(pattern) + 2 * budget)
            done[d, number] = b
            errors, end = myers(pattern, words.hashes[a:b].tolist())
            if errors <= budget:
                best[d, number] = min(best.get((d, number), (errors, a + end - low)), (errors, a + end - low))
        return best


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, keep: bool = False) -> DataFrame:
    """(doc_id, item_id, errors, end_word, item_words) of each test item that stands in a document, nearly word for word.

    Words are runs of letters, digits and characters beyond ASCII, lower-cased; signs and line breaks do not count. An
    item of n words matches a stretch of at most floor(n x rate) word errors (insertions, deletions, replacements).
    It is cut into one piece more than that, so every match holds one piece unchanged; places of whole pieces are
    verified by Myers' algorithm. Items of few words thus need an exact match. One row for each document row and
    item, with the fewest errors and the place where that match ends.

    Null and empty texts and items match nothing. Equal documents each get their rows, equal items too; null ids
    are kept. Items are held by tasks in blocks of ``BLOCK_BYTES`` of text; a larger benchmark takes several passes.
    An empty table on either side gives no rows. Other columns are ignored.

    With ``keep``, all columns of the documents without any match are returned instead.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.lower(F.col(item_text_col).cast("string")).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("text", "item"), F.lit(max(blocks, 1)))
    lowered = F.lower(F.col(text_col).cast("string"))
    kept, found = docs, []
    for b in range(blocks):
        held = [tuple(r) for r in items.filter(block == b).collect()]  # one block, about BLOCK_BYTES
        if keep:
            kept = _without(kept, lowered, held, rate)
        else:
            found.append(_pairs(docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered.alias("text")), held, rate))
    if keep:
        return kept
    out = docs.sparkSession.createDataFrame([], _SCHEMA)
    for i, f in enumerate(found):
        out = f if i == 0 else out.unionByName(f)
    return out


_SCHEMA = "doc_id long, item_id long, errors int, end_word long, item_words int"


def _pairs(rows: DataFrame, held: list[tuple[int, str]], rate: float) -> DataFrame:
    def match(batches):
        index = Pieces(held, rate)
        for batch in pieces(batches, "text"):
            best = index.matches(Words(batch.column("text"), WORD_BYTES))
            if best:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[d], index.items[n][0], e, end, len(index.items[n][1])) for (d, n), (e, end) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                                                 names=["doc_id", "item_id", "errors", "end_word", "item_words"])

    return rows.mapInArrow(match, _SCHEMA)


def _without(docs: DataFrame, lowered, held: list[tuple[int, str]], rate: float) -> DataFrame:
    """The documents in which no item of the block stands."""
    name = "lowered_"
    while name in docs.columns:
        name += "_"

    def drop(batches):
        index = Pieces(held, rate)
        for batch in pieces(batches, name):
            best = index.matches(Words(batch.column(name), WORD_BYTES))
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, _ in best]] = False
            yield batch.drop_columns([name]).filter(pa.array(clean))

    return docs.withColumn(name, lowered).mapInArrow(drop, docs.schema)
