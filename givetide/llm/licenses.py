"""License scans by a positional index over rare licence words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import WORD_BYTES, Finder, Words, hash_word, pieces

#: Fixed phrases and their labels; every place counts.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (wording of the notice, phrases that must stand in their places).
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license",)),
    "artistic-2.0": ("under the terms of the artistic license 2 0", ("artistic license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-nc-nd-4.0": ("licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    "cc-by-nc-sa-4.0": ("licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", ("cc by nd",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc0": ("dedicated to the public domain under cc0 1 0", ("public domain", "cc0")),
    "creative-commons-by": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "epl-2.0": ("under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("general public license", "version 2")),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("general public license", "version 3")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}
#: Rarest words of a template that are looked up, and the share of its inverse document frequency that must match.
ANCHORS = 3
SHARE = 0.7


class Index:
    """Postings of licence words: the wordings they stand in, and where."""

    def __init__(self, base: dict[str, str], templates: dict[str, tuple[str, tuple[str, ...]]]):
        texts = [*base, *(text for text, _ in templates.values())]
        self.words = sorted({w for t in texts for w in t.split()})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.hashes = np.array([hash_word(w.encode()) for w in self.words], np.uint64)
        self.base = [(self.coded(p), label) for p, label in base.items()]
        self.templates = []
        for label, (text, keys) in templates.items():
            words = text.split()
            places = set()
            for key in keys:
                k = key.split()
                at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
                places.update(range(at, at + len(k)))
            self.templates.append((label, self.coded(text), np.array(sorted(places))))

    def coded(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in text.split()], np.int32)


def _codes(words: Words, finder: Finder) -> np.ndarray:
    """The licence word at each place of the batch, -1 for any other, with a margin of -1 behind."""
    codes = np.full(len(words.hashes) + 64, -1, np.int32)
    at, which = finder.find(words.hashes)
    codes[at] = which
    return codes


def _places(codes: np.ndarray, wording: np.ndarray, ends: np.ndarray, anchor: int) -> np.ndarray:
    """Where all words of the wording stand in a row within one document, looked up by its rarest word."""
    at = np.flatnonzero(codes == wording[anchor]) - anchor
    at = at[at >= 0]
    for i, word in enumerate(wording):
        at = at[codes[at + i] == word]
    return at[(at + len(wording) <= ends[np.searchsorted(ends, at, "right")])] if len(at) else at


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of all documents, and in how many of them each licence word stands. One row per licence word."""

    def count(batches):
        finder, total = Finder(index.hashes), np.zeros(len(index.words) + 1, np.int64)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WORD_BYTES)
            at, which = finder.find(words.hashes)
            doc = np.searchsorted(words.bounds, at, "right") - 1
            seen = np.unique(doc * len(index.words) + which) % len(index.words)
            total[:-1] += np.bincount(seen, minlength=len(index.words))
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": np.arange(len(total), dtype=np.int32), "n": total})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word int, n long")
    found = dict(rows.groupBy("word").agg(F.sum("n").alias("n")).collect())  # one row per licence word
    return found.get(len(index.words), 0), np.array([found.get(i, 0) for i in range(len(index.words))])


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, *,
                  id_col: str = "doc_id", text_col: str = "text", anchors: int = ANCHORS, share: float = SHARE) -> DataFrame:
    """Licence phrases and notices in every whole text.

    Words are runs of ASCII letters, digits and characters beyond ASCII, ASCII letters lower-cased. Base phrases are
    found wherever their words stand in a row: the places of the rarest word are intersected with those of the
    others by relative position. A notice is found by its ``anchors`` words of highest inverse document frequency
    over all documents: places where at least two of them (one, if it has only one) agree on where the notice begins
    are compared word by word, and count if all mandatory phrases stand in their places and the matching words carry
    at least ``share`` of the notice's inverse document frequency. ``score`` is the best share found in a document,
    1 where a base phrase stands, 0 where nothing does.

    Null and empty texts have no words, null places, empty labels and score 0. Equal rows are separate documents.
    An empty table gives no rows. Only the two named columns are read.
    """
    index = Index(base, templates)
    n, df = document_frequencies(docs, index, text_col)
    idf = np.array([math.log((n + 1) / (d + 1)) + 1e-6 for d in df])
    phrases = [(wording, label, int(np.argmax(idf[wording]))) for wording, label in index.base]
    notices = [(label, wording, must, np.argsort(-idf[wording], kind="stable")[:anchors], idf[wording] / idf[wording].sum()) for label, wording, must in index.templates]
    hashes = index.hashes
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scan(batches):
        finder = Finder(hashes)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WORD_BYTES)
            rows, ends, begins = batch.num_rows, words.bounds[1:], words.bounds[:-1]
            codes = _codes(words, finder)
            doc_of = lambda at: np.searchsorted(words.bounds, at, "right") - 1  # noqa: E731, B023
            n_base = np.zeros(rows, np.int64)
            first, last, score = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1), np.zeros(rows)
            base_labels: dict[int, set[str]] = {}
            labels: dict[int, set[str]] = {}
            for wording, label, anchor in phrases:
                at = _places(codes, wording, ends, anchor)
                doc = doc_of(at)
                np.add.at(n_base, doc, 1)
                np.minimum.at(first, doc, at - begins[doc])
                np.maximum.at(last, doc, at - begins[doc])
                score[doc] = 1.0
                for d in np.unique(doc).tolist():
                    base_labels.setdefault(d, set()).add(label)
                    labels.setdefault(d, set()).add(label)
            for label, wording, must, looked_up, weight in notices:
                starts = np.concatenate([np.flatnonzero(codes == wording[i]) - i for i in looked_up])
                starts, votes = np.unique(starts[starts >= 0], return_counts=True)
                starts = starts[votes >= min(2, len(looked_up))]
                starts = starts[starts + must[-1] < len(words.hashes)]
                doc = doc_of(starts + must[0])
                inside = (starts >= begins[doc]) & (starts + must[-1] < ends[doc])
                starts, doc = starts[inside], doc[inside]
                if not len(starts):
                    continue
                places = starts[:, None] + np.arange(len(wording))
                hit = (codes[places] == wording) & (places < ends[doc][:, None])
                got = hit @ weight
                good = hit[:, must].all(axis=1) & (got >= share)
                np.maximum.at(score, doc[good], np.minimum(got[good], 1.0))
                for d in np.unique(doc[good]).tolist():
                    labels.setdefault(d, set()).add(label)
            joined = lambda found: [",".join(sorted(found.get(i, ()))) for i in range(rows)]  # noqa: E731, B023
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array(joined(base_labels), pa.string()),
                    pa.array(joined(labels), pa.string()),
                    pa.array(score),
                ],
                schema=schema,
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
