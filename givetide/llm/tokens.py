"""Token-id output: flat unsigned integer files with 64-bit document offsets, for memory-mapped reading.

A folder holds, for each shard, three flat little-endian files and no headers:

* ``ids-N.bin``: the token ids of all documents of the shard, each document followed by the end id; 16-bit unsigned
  where the vocabulary allows, else 32-bit (``width`` in the manifest),
* ``offsets-N.bin``: signed 64-bit, one more than there are documents: where each begins, counted in ids within the shard,
* ``docs-N.bin``: signed 64-bit document ids; the least 64-bit value stands for a null id.

``manifest`` (Parquet) has one row per shard with its number of documents and ids and its base: the ids in all
earlier shards, a prefix sum. A document's place in the whole corpus is base + offset.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.sources.warehouse import run_folder, settle

NO_ID = -(1 << 63)
#: Pieces kept by a worker between batches; beyond that it starts afresh, which changes no result.
KEPT_PIECES = 900_000
SHARD_BYTES = 32 << 20
#: Text cut at a time, for memory; a longer text is cut alone.
CUT_BYTES = 8 << 20

_tail = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: Letters below this are letters in any version of Unicode that a tokenizer may follow.
OLD_LETTERS = "\u0530"


class _Index(dict):
    """Numbers of pieces; a new one is encoded when it is first asked for."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, key: str) -> int:
        self[key] = number = self.add(key)
        return number


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, and remembers what pieces became.

    A byte-level BPE never merges across a space before a word, so a text is cut there and at line ends, and each
    distinct piece is encoded once. Texts in which white space meets white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        """Forget all pieces. A piece's ids are pool[ends[number]:ends[number + 1]]."""
        self.index, self.signs, self.pool, self.ends = _Index(self.add), {}, array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """A run of letters, or a space and one: what the tokenizer's own cutting leaves as it is."""
        mapped = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def alone(self, signs: str) -> list[int]:
        ids = self.signs.get(signs)
        if ids is None:
            ids = self.signs[signs] = self.whole(signs)
        return ids

    def piece(self, key: str) -> list[int] | None:
        """A piece that is more than letters after a space; none if white space at its ends met other white space."""
        lead, body = (key[0], key[1:]) if key[:1] in ("\n", "\0") else (" ", key)
        if not body:
            return [] if lead == "\0" else None
        if body[0].isspace() or body[-1].isspace():
            return None
        if (m := _tail.match(body)) and m[1].isalpha() and max(m[1]) < OLD_LETTERS:
            stem = self.index[m[1] if lead == " " else lead + m[1]]
            return self.pool[self.ends[stem] : self.ends[stem + 1]].tolist() + self.alone(m[2])
        if lead == " ":
            return self.whole(lead + body)
        first = self.word(body) if body.isalpha() and max(body) < OLD_LETTERS else self.whole(body)
        return self.alone("\n") + first if lead == "\n" else first

    def add(self, key: str) -> int:
        """Encode a new piece: a word after a space, a line end with what follows, or the first word after NUL."""
        ids = self.word(" " + key) if key.isalpha() and max(key) < OLD_LETTERS else self.piece(key)
        if ids is None:
            return -1
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        return len(self.ends) - 2

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow cuts the texts and finds the distinct pieces; only these are looked up."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
        out, start = [], 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + CUT_BYTES, "right")))
            out += self._cut(texts.slice(start, stop - start).cast(pa.large_string()))
            start = stop
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.index) > KEPT_PIECES:
            self.clear()
        entire = pc.match_substring_regex(texts, r"^(\s|\z)")
        for s in ["\0", *self.special]:
            entire = pc.or_(entire, pc.match_substring(texts, s))
        entire = entire.to_numpy(zero_copy_only=False)
        nul, nothing = pa.scalar("\0", texts.type), pa.scalar("", texts.type)
        parts = pc.split_pattern(pc.binary_join_element_wise(nul, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        first = parts.offsets.to_numpy()
        pieces = parts.values.dictionary_encode()
        known = np.fromiter(map(self.index.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(pieces.dictionary))
        got = known[pieces.indices.to_numpy()]
        entire |= np.minimum.reduceat(got, first[:-1]) < 0
        got[got < 0] = 0
        pool, ends = np.array(self.pool, np.uint32), np.array(self.ends, np.int64)
        begin = ends[got]
        n = ends[got + 1] - begin
        past = np.cumsum(n)
        ids = pool[np.repeat(begin - (past - n), n) + np.arange(past[-1])]
        cuts = np.concatenate([[0], past])[first]
        found = [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(entire):
            found[i] = np.array(self.whole(texts[i].as_py()), np.uint32)
        return found


def open_files(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI; local files are memory-mapped when read."""
    if re.match(r"(file:)?/", folder):
        return fs.LocalFileSystem(use_mmap=True), re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def _write(files: fs.FileSystem, path: str, blocks: list[bytes], attempt: int) -> None:
    """Written aside and moved, so that a second attempt of a task never leaves half a file."""
    aside = f"{path}.{attempt}"
    with files.open_output_stream(aside) as out:
        for b in blocks:
            out.write(b)
    files.move(aside, path)


_encoders: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode whole texts into shards under ``folder`` in ascending order of id, and return the manifest.

    Null and empty texts become the end id alone. Null ids come first. Equal ids lie side by side, in the order of
    their texts' hashes. Every row is written, repeated rows as often as they occur. An empty table gives a manifest
    without rows. Other columns are ignored, whatever their names. A shard is bounded by ``shard_bytes`` of text on
    average; one very long document makes its shard longer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (shard_bytes >> 3))))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def encode(batches):
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids, lengths, names = [], [], []
        task = TaskContext.get()
        for batch in batches:
            for a in encoder.batch(batch.column("text")):
                ids.append(np.append(a, end_id).astype(f"<u{width}").tobytes())
                lengths.append(len(a) + 1)
            names.append(batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if lengths:
            n, attempt = task.partitionId(), task.taskAttemptId()
            files, path = open_files(folder)
            files.create_dir(path)
            _write(files, f"{path}/ids-{n}.bin", ids, attempt)
            _write(files, f"{path}/offsets-{n}.bin", [np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()], attempt)
            _write(files, f"{path}/docs-{n}.bin", [np.concatenate(names).astype("<i8").tobytes()], attempt)
            yield pa.RecordBatch.from_pydict({"shard": [n], "docs": [len(lengths)], "ids": [int(sum(lengths))], "width": [width]},
                                             schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    written = settle(placed.select("id", "text").mapInArrow(encode, "shard int, docs long, ids long, width int"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Shard:
    """One shard, memory-mapped where the folder is a mounted one."""

    def __init__(self, folder: str, n: int, width: int):
        files, path = open_files(folder)
        load = lambda name, kind: np.frombuffer(files.open_input_file(f"{path}/{name}-{n}.bin").read_buffer(), kind)
        self.ids, self.offsets, self.docs = load("ids", f"<u{width}"), load("offsets", "<i8"), load("docs", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_tokens(spark, folder: str) -> DataFrame:
    """What the files hold, per document: id, place in the corpus, number of ids, and crc32 of the ids as 32-bit."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(frames):
        for frame in frames:
            for shard, width, base in zip(frame["shard"], frame["width"], frame["base"], strict=True):
                s = Shard(folder, shard, width)
                crc = [zlib.crc32(s[i].astype("<u4").tobytes()) for i in range(len(s))]
                yield pd.DataFrame({"doc_id": pd.array(s.docs, dtype="Int64"), "start": base + s.offsets[:-1], "n_tokens": np.diff(s.offsets), "ids_crc32": crc, "shard": shard})

    spread = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    found = spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into a new folder of this run and read them back."""
    import uuid

    folder = f"{run_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder)
