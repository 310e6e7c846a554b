"""Cheapest repair of conversations by Four-Russians block tables.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``. Rows may be kept (0), get the role user or
assistant (3) or be deleted (4, the only choice for blank and duplicate rows); empty rows of user or assistant may be
inserted anywhere (3); a truncated row that stays adds 3. Of the cheapest edits those whose initials (Keep, Rerole,
Delete, Insert) are least in ASCII order are made.

What remains to be paid behind a row depends only on where the roles stand: nothing yet, after system, after user,
after assistant. Normalised to a least cost of 0, these four costs form one of a few vectors, so the way from the
vector behind a block of rows to the one before it is a table lookup for every block of ``BLOCK`` row symbols.
Conversations are run backwards through that table block by block. Tracing runs forwards: each block is expanded
backwards from the vector behind it, and every row's edit is then looked up for the vector and the place reached.

Rows are numbered over range partitions, and a conversation is worked on in chunks of ``CHUNK`` rows, which exchange
one vector and one place with their neighbours; so a conversation of any length spreads over tasks. Its audit is one
value of the result, and SHA-256 can only be computed in order: these two are the whole that one row has to hold and
one task has to stream (row by row, nothing is collected).

Defined cases: a null id is a conversation of its own; null turns come first; a null role or text is one space; rows of
equal turn stand in the order of role and the text's SHA-256 (equal rows are interchangeable); a table without rows
gives a result without rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import pieces, running
from givetide.sources.warehouse import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
CHUNK = 1 << 14
BLANKS = " \t\n\x0b\f\r"

#: Places of the role sequence, and what each role leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that may be inserted or assigned at each place, and where it leads.
NEXT_ROLE = ["user", "user", "assistant", "user"]
NEXT = [USER, USER, ASSISTANT, USER]
ROLES = "suax"
FINE, CUT, BLANK, DUPLICATE = range(4)
#: Row symbols: letters from A on, four roles for each of the four states of the text.
SYMBOLS = [(kind, role) for kind in range(4) for role in ROLES]


def symbol(kind: Column, initial: Column) -> Column:
    """The letter of a row, from its text's state and the initial of its role."""
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(ord("A")) + kind * 4 + role)


def _edits(kind: int, role: str, place: int) -> list[tuple[str, int, int]]:
    """Edits of one row at a place: letter, cost and the place after it."""
    edits = [("D", DELETE, place)]
    if kind in (FINE, CUT):
        more = TRUNCATED if kind == CUT else 0
        if (place, role) in MOVES:
            edits.append(("K", KEEP + more, MOVES[place, role]))
        edits.append(("R", REROLE + more, NEXT[place]))
    return edits


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(4):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


class Tables:
    """Vectors, block transitions and traced edits, all built from the edit costs."""

    def __init__(self):
        never = 1 << 20
        last = _with_inserts([0, never, never, 0])
        vectors, known, steps = [tuple(last)], {tuple(last): 0}, []
        #: What is inserted at the end, by place.
        self.ending = ["", "II", "I", ""]
        self.trace: list[list[list[tuple[str, int]]]] = []
        for behind in vectors:
            row, traced = [], []
            for kind, role in SYMBOLS:
                best = [min(cost + behind[to] for _, cost, to in _edits(kind, role, q)) for q in range(4)]
                exact = _with_inserts(best)
                least = min(exact)
                vector = tuple(c - least for c in exact)
                if vector not in known:
                    known[vector] = len(vectors)
                    vectors.append(vector)
                row.append(known[vector])
                traced.append([self._first(exact, behind, kind, role, q) for q in range(4)])
            steps.append(row)
            self.trace.append(traced)
        self.steps = np.array(steps, np.int16)
        self.vectors = vectors
        blocks = np.arange(len(vectors), dtype=np.int16)[:, None]
        for _ in range(BLOCK):
            # The symbols nearer to the front are met later: new ones go to the front of the block's number.
            blocks = self.steps[blocks].transpose(0, 2, 1).reshape(len(vectors), -1)
        #: blocks[vector behind, number of the block in base 16] is the vector before the block.
        self.blocks = blocks

    @staticmethod
    def _first(exact: list[int], behind: tuple, kind: int, role: str, place: int) -> tuple[str, int]:
        """Letters of the inserts before a row and of its own edit, least in ASCII order, and the place reached."""
        letters = ""
        while True:
            edits = {letter: to for letter, cost, to in _edits(kind, role, place) if cost + behind[to] == exact[place]}
            if "D" in edits:
                return letters + "D", edits["D"]
            if INSERT + exact[NEXT[place]] == exact[place]:
                letters, place = letters + "I", NEXT[place]
                continue
            letter = min(edits)
            return letters + letter, edits[letter]

    def numbers(self, symbols: str) -> np.ndarray:
        return np.frombuffer(symbols.encode("ascii"), np.uint8) - ord("A")

    def cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A first stretch shorter than a block, and the numbers of the whole blocks behind it."""
        short = len(codes) % BLOCK
        whole = codes[short:].astype(np.int64).reshape(-1, BLOCK)
        return codes[:short], whole @ (16 ** np.arange(BLOCK - 1, -1, -1))

    def before(self, symbols: str) -> np.ndarray:
        """The vector before a chunk for every vector behind it."""
        short, whole = self.cut(self.numbers(symbols))
        at = np.arange(len(self.vectors), dtype=np.int16)
        for block in whole[::-1]:
            at = self.blocks[at, block]
        for s in short[::-1]:
            at = self.steps[at, s]
        return at

    def behind_each(self, symbols: str, vector: int) -> list[int]:
        """The vector behind every row of a chunk: block by block, then row by row within each block."""
        codes = self.numbers(symbols)
        short, whole = self.cut(codes)
        ends = [vector]
        for block in whole[::-1].tolist():
            ends.append(int(self.blocks[ends[-1], block]))
        found = [0] * len(codes)
        ends.reverse()
        rows, steps = codes.tolist(), self.steps
        for b in range(len(whole) + (1 if len(short) else 0)):
            stop = len(codes) - BLOCK * b
            start = max(0, stop - BLOCK)
            at = ends[len(whole) - b]
            for i in range(stop - 1, start - 1, -1):
                found[i] = at
                at = int(steps[at, rows[i]])
        return found

    def passed(self, symbols: str, vector: int) -> list[int]:
        """The place after a chunk for every place before it."""
        places = list(range(4))
        for s, behind in zip(self.numbers(symbols).tolist(), self.behind_each(symbols, vector), strict=True):
            row = self.trace[behind][s]
            places = [row[q][1] for q in places]
        return places

    def edits(self, symbols: str, vector: int, place: int) -> tuple[list[str], int]:
        """For every row the letters of the inserts before it and of its edit, and the place after the chunk."""
        found = []
        for s, behind in zip(self.numbers(symbols).tolist(), self.behind_each(symbols, vector), strict=True):
            letters, place = self.trace[behind][s][place]
            found.append(letters)
        return found, place


@functools.cache
def tables() -> Tables:
    return Tables()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) as a lossy source would deliver them, decided by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out full stops, question and exclamation marks, 3 repeats it, 4 makes
    it the user's. Nulls are one space, but a null id and turn stay null.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col))) % 20
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.filter("fate <> 0").select(
        "conv",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _same(*columns: str, left: str, right: str) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def numbered(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv, pos (from 0 in each conversation), turn, role, hash of the text, and the row's symbol."""
    body = F.rtrim("text", F.lit(BLANKS))
    light = rows.select(
        "conv", "turn", "role",
        F.unhex(F.sha2("text", 256)).alias("hash"),
        F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("kind"),
        F.lit(1).alias("one"),
    ).withColumn("tie", F.monotonically_increasing_id())
    placed = running(light, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash"), F.col("tie")], "one")
    placed = settle(placed.select("conv", F.col("before").alias("pos"), "turn", "role", "hash", "kind"))
    firsts = placed.groupBy("conv", "role", "hash").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    kind = F.when(F.col("kind") == BLANK, BLANK).when(F.col("first"), F.col("kind")).otherwise(DUPLICATE)
    return settle(
        placed.alias("p")
        .join(firsts.alias("f"), _same("conv", "pos", left="p", right="f"), "left")
        .select("p.conv", "p.pos", "p.turn", "p.role", "p.hash", symbol(kind, F.left("role", F.lit(1))).alias("symbol"))
    )


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """The symbols of each chunk of a conversation, in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    return settle(
        rows.groupBy("conv", F.floor(F.col("pos") / chunk).alias("chunk"))
        .agg(F.array_join(F.transform(listed, lambda s: s["symbol"]), "").alias("symbols"))
    )


def _per_chunk(df: DataFrame, fn, name: str) -> DataFrame:
    """Adds an array of numbers computed from each chunk."""
    keep = df.schema

    def run(batches):
        t = tables()
        for batch in batches:
            rows = batch.to_pylist()
            found = pa.array([fn(t, r) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return df.mapInArrow(run, keep.simpleString()[len("struct<") : -1].replace(":", " ") + f", {name} array<int>")


def _chain(df: DataFrame, steps: str, name: str, forwards: bool) -> DataFrame:
    """Hands a number from chunk to chunk of each conversation, from 0 on: ``steps`` maps what enters to what leaves.

    A group holds one short row for every ``CHUNK`` rows of its conversation, and no text.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ascending=forwards)
        now, seen = 0, []
        for step in frame[steps]:
            seen.append(now)
            now = int(step[now])
        return pd.DataFrame({"conv": frame["conv"], "chunk": frame["chunk"], name: seen})

    kind = df.schema["conv"].dataType.simpleString()
    return df.select("conv", "chunk", steps).groupBy("conv").applyInPandas(run, f"conv {kind}, chunk long, {name} int")


def _joined(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return df.alias("l").join(found.alias("r"), _same("conv", "chunk", left="l", right="r")).select("l.*", f"r.{name}")


def _bounded(chunks: DataFrame) -> DataFrame:
    """Chunks with the vector behind them and the place before them; a single chunk needs no neighbour."""
    longer = chunks.filter("chunk = 1").select("conv")
    is_long = F.col("c.conv").eqNullSafe(F.col("m.conv"))
    alone = chunks.alias("c").join(longer.alias("m"), is_long, "left_anti").select("*", F.lit(0).alias("vector"), F.lit(0).alias("place"))
    parts = settle(_per_chunk(chunks.alias("c").join(longer.alias("m"), is_long, "left_semi"), lambda t, r: t.before(r["symbols"]).tolist(), "steps"))
    parts = _joined(parts.drop("steps"), _chain(parts, "steps", "vector", forwards=False), "vector")
    parts = settle(_per_chunk(parts, lambda t, r: t.passed(r["symbols"], r["vector"]), "steps"))
    return alone.unionByName(_joined(parts.drop("steps"), _chain(parts, "steps", "place", forwards=True), "place"))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _audited(bounded: DataFrame, last: DataFrame, chunk: int) -> DataFrame:
    """Counts, audit and kept or inserted rows (pos, sub, role; the role is null where it stays) of each chunk."""
    kind = bounded.schema["conv"].dataType.simpleString()
    ends = bounded.alias("l").join(last.alias("r"), _same("conv", left="l", right="r")).select("l.*", (F.col("l.chunk") == F.col("r.chunk")).alias("final"))
    roles = str.maketrans({chr(65 + i): role for i, (_, role) in enumerate(SYMBOLS)})
    kinds = str.maketrans({chr(65 + i): str(k) for i, (k, _) in enumerate(SYMBOLS)})

    def one(t: Tables, r: dict) -> dict:
        symbols = r["symbols"]
        initials, states = symbols.translate(roles), symbols.translate(kinds)
        edits, place = t.edits(symbols, r["vector"], r["place"])
        rows, q, cost = [], r["place"], 0
        for i, letters in enumerate(edits):
            pos = r["chunk"] * chunk + i
            for sub, letter in enumerate(letters):
                if letter == "D":
                    cost += DELETE
                    continue
                cost += (INSERT if letter == "I" else REROLE if letter == "R" else KEEP) + (TRUNCATED if letter != "I" and states[i] == "1" else 0)
                rows.append({"pos": pos, "sub": sub, "role": None if letter == "K" else NEXT_ROLE[q], "added": letter == "I"})
                q = MOVES[q, initials[i]] if letter == "K" else NEXT[q]
        audit = "".join(edits)
        if r["final"]:
            audit += t.ending[place]
            for sub in range(len(t.ending[place])):
                rows.append({"pos": r["chunk"] * chunk + len(edits), "sub": sub, "role": NEXT_ROLE[q], "added": True})
                q, cost = NEXT[q], cost + INSERT
        legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
        return {
            "conv": r["conv"], "chunk": r["chunk"], "blank": states.count("2"), "duplicate": states.count("3"), "truncated": states.count("1"),
            "illegal": len(symbols) - 1 - legal, "cost": cost, "first": initials[0], "last": initials[-1], "audit": audit, "rows": rows,
        }

    def run(batches):
        t = tables()
        shape = pa.schema([
            ("conv", batch_type), ("chunk", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()), ("audit", pa.string()),
            ("rows", pa.list_(pa.struct([("pos", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("added", pa.bool_())]))),
        ])
        for batch in pieces(batches, "symbols", CHUNK):
            yield pa.RecordBatch.from_pylist([one(t, r) for r in batch.to_pylist()], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(bounded.schema["conv"].dataType)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return settle(ends.mapInArrow(run, f"conv {kind}, chunk long, {counts}, first string, last string, audit string, rows array<struct<pos:long,sub:int,role:string,added:boolean>>"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations given as (conv, turn, role, text).

    Returns the report (conv, blank, duplicate, truncated, illegal, cost, audit) and the repaired rows (conv, pos, sub,
    role, text) in the order of pos and sub. A conversation whose rows were all deleted is in the report only.
    """
    light = numbered(rows)
    chunks = _chunks(light, chunk)
    audited = _audited(_bounded(chunks), chunks.groupBy("conv").agg(F.max("chunk").alias("chunk")), chunk)

    parts = F.array_sort(F.collect_list(F.struct("chunk", "first", "last", "audit")))
    seams = F.expr("aggregate(sequence(1, size(p)), 0L, (n, i) -> n + if(i = size(p) or concat(get(p, i - 1).last, get(p, i).first) in ('su', 'ua', 'au'), 0L, 1L))")
    report = audited.groupBy("conv").agg(*[F.sum(c).alias(c) for c in COUNTS], parts.alias("p"))
    report = report.withColumn("illegal", F.col("illegal") + seams).withColumn("audit", F.array_join(F.transform("p", lambda x: x["audit"]), "")).drop("p")

    kept = audited.select("conv", F.explode("rows").alias("r")).select("conv", "r.pos", "r.sub", F.col("r.role").alias("now"), "r.added")
    # A row that stays is the only one of its conversation with its role and text, so these joins have unique keys.
    texts = rows.groupBy("conv", "role", F.unhex(F.sha2("text", 256)).alias("hash")).agg(F.first("text").alias("text"))
    own = kept.filter("not added").alias("k").join(light.alias("l"), _same("conv", "pos", left="k", right="l")).select("k.conv", "k.pos", "k.sub", "k.now", "l.role", "l.hash")
    own = own.alias("o").join(texts.alias("t"), _same("conv", "role", "hash", left="o", right="t"))
    own = own.select("o.conv", "o.pos", "o.sub", F.coalesce("o.now", "o.role").alias("role"), "t.text")
    return report, own.unionByName(kept.filter("added").select("conv", "pos", "sub", F.col("now").alias("role"), F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, streamed through the tasks in order."""
    kind = repaired.schema["conv"].dataType.simpleString()
    lines = repaired.select("conv", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        now, digest, shape, names, found = None, None, None, [], []
        for batch in batches:
            shape = batch.schema.field("conv").type
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        names.append(now)
                        found.append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
            if len(names) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(names, shape), pa.array(found, pa.string())], ["conv", "sha256"])
                names, found = [], []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*names, now], shape), pa.array([*found, digest.hexdigest()], pa.string())], ["conv", "sha256"])

    placed = lines.repartition("conv").sortWithinPartitions("conv", "pos", "sub").select("conv", "line")
    return placed.mapInArrow(run, f"conv {kind}, sha256 string")


def repair_report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damages conversations, repairs them, and reports every original one: gaps, faults, cost, audit and digest.

    Gaps are the turns missing between the least and the greatest, nulls left out. A conversation without rows after
    the damage has zeros, an empty audit and the digest of the empty string.
    """
    rows = damage(conversations)
    report, repaired = repair(rows, chunk)
    turns = rows.filter("turn is not null").select("conv", "turn").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    all_ids = conversations.select(F.col("conv_id").alias("conv")).distinct()
    out = all_ids.alias("c")
    for name, part in (("g", gaps), ("r", report), ("d", digests(repaired))):
        out = out.join(part.alias(name), F.col("c.conv").eqNullSafe(F.col(f"{name}.conv")), "left")
    return out.select(
        F.col("c.conv").alias("conv_id"),
        F.coalesce("g.gaps", F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("d.sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
