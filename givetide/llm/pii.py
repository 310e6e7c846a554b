"""Personal data in whole texts, disguised or not, by offset-preserving transducers.

A tape is a text whose characters know the stretch of the source they stand for. Transducers rewrite tapes: homoglyphs
and invisible characters become what they look like, spelled digits become digits, and spelled or bracketed at, dot,
plus and dash become signs. One set of detectors reads the tapes: the source itself (the base spans), and the rewritten
tape, whose finds are mapped back to source characters. A rewritten find is reported if a transducer touched it, and if
it doesn't lie within a base span of its kind; so plain data are reported once, and base spans always stay.

Offsets are kept as the places where the tape and the source get out of step, so a tape costs memory for what was
rewritten only. Detectors take time in proportion to the text: no pattern is tried twice within one run of characters.

A disguised address must end in a domain of letters, and what may be plain prose counts only in a whole disguise: a bare
`` at `` is a sign only if at least one dot after it is spelled too, digits are spelled in runs of three or more, and
an unsigned run of spelled digits is no phone.

Defined cases: a null or empty text has no spans; equal rows get equal results, each its own row; an empty table gives
a result without rows; ids may be null or repeat; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import pieces

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int]

#: Letters of other scripts that look like ASCII ones, and signs that look like ASCII signs.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "е": "e", "Е": "E", "З": "3", "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "ѕ": "s", "Ѕ": "S", "Т": "T", "у": "y", "х": "x", "Х": "X", "ԁ": "d", "ԛ": "q",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "ο": "o", "Ρ": "P", "ρ": "p", "Τ": "T",
    "υ": "u", "ν": "v", "Χ": "X", "Υ": "Y", "ı": "i", "ɡ": "g", "ո": "n", "ս": "u",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".", "\uff61": ".",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits as they are spelled in English, German, French and Spanish.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
#: How signs are spelled; each at goes with the dots of its languages.
AT_AND_DOT = {"at": "dot|punkt", "arobase": "point", "arroba": "punto"}
DOT = "dot|punkt|point|punto"
#: Words that don't name a domain, and ends of domains that aren't words of the four languages.
NO_DOMAIN = "the|this|that|a|an|one|every|each|any|some|which"
ENDINGS = frozenset("com org net edu gov info biz io dev app co uk de fr ch nl eu ca au jp cn ru br pt pl dk nz mx cl se".split())

#: Full-width forms of all ASCII signs, digits and letters, and the digits of other scripts.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
LOOKALIKES |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
DIGITS = {word: digit for digit, words in SPELLED.items() for word in words.split()}
DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
LEAST_SPELLED = 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Tape:
    """A text and how its characters map to the source's.

    ``marks`` holds, for every rewritten stretch, its start and end on the tape and its start and end in the source;
    between them tape and source run in step. Deleted stretches are empty on the tape.
    """

    def __init__(self, text: str, marks: list[tuple[int, int, int, int]]):
        self.text, self.marks = text, marks
        self.starts = [m[0] for m in marks]
        self.stops = [m[1] for m in marks]

    def source(self, start: int, end: int) -> Span:
        """The source stretch of a stretch of the tape; a rewritten stretch counts whole."""
        i = bisect_right(self.starts, start) - 1
        if i >= 0 and start < self.marks[i][1]:
            first = self.marks[i][2]
        else:
            first = start + (self.marks[i][3] - self.marks[i][1] if i >= 0 else 0)
        i = bisect_left(self.starts, end) - 1
        if i >= 0 and end <= self.marks[i][1]:
            last = self.marks[i][3]
        else:
            last = end + (self.marks[i][3] - self.marks[i][1] if i >= 0 else 0)
        return first, last

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewritten stretch lies within a stretch of the tape."""
        i = bisect_left(self.stops, start)
        while i < len(self.marks) and self.starts[i] < end:
            if self.stops[i] > start:
                return True
            i += 1
        return False

    def rewritten(self, edits: Iterator[tuple[int, int, str]]) -> Tape:
        """A tape on which the given stretches (in order, apart from each other) read as given."""
        out, marks, at, size, old = [], [], 0, 0, 0
        for start, end, new in edits:
            # Earlier marks before the stretch move along; those inside it are part of the new one.
            while old < len(self.marks) and self.marks[old][1] <= start and self.marks[old][0] < start:
                m = self.marks[old]
                marks.append((m[0] - at + size, m[1] - at + size, m[2], m[3]))
                old += 1
            source = self.source(start, end)
            while old < len(self.marks) and self.marks[old][0] < end:
                source = (min(source[0], self.marks[old][2]), max(source[1], self.marks[old][3]))
                old += 1
            out.append(self.text[at:start])
            size += start - at
            marks.append((size, size + len(new), *source))
            out.append(new)
            size += len(new)
            at = end
        if not out:
            return self
        for m in self.marks[old:]:
            marks.append((m[0] - at + size, m[1] - at + size, m[2], m[3]))
        out.append(self.text[at:])
        return Tape("".join(out), marks)


Transducer = Callable[[Tape], Tape]

_odd = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]")


def look_alikes(tape: Tape) -> Tape:
    """What looks like ASCII becomes ASCII, what shows nothing goes."""
    if tape.text.isascii():
        return tape
    return tape.rewritten((m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _odd.finditer(tape.text))


_entity = re.compile(r"&#0*(4[03-68]|64|5[0-7]|49);|&#x0*(2[BDEbde0]|3[0-9]|40);|&(commat|period|plus|nbsp);")
_named = {"commat": "@", "period": ".", "plus": "+", "nbsp": " "}


def references(tape: Tape) -> Tape:
    """Character references of signs and digits."""
    if "&" not in tape.text:
        return tape
    sign = lambda m: _named[m[3]] if m[3] else chr(int(m[1])) if m[1] else chr(int(m[2], 16))
    return tape.rewritten((m.start(), m.end(), sign(m)) for m in _entity.finditer(tape.text))


#: Blanks are bounded, so that a long run of them costs no more than its length.
_B = r"[ \t]{1,3}"
_number = re.compile(
    rf"(?<!\w)(?:plus{_B})?(?:{DIGIT_WORD})(?:[ \t,-]{{1,3}}(?:{DIGIT_WORD}|(?:{DOT}|dash|minus)(?={_B}(?:{DIGIT_WORD})(?!\w))))+(?!\w)", re.I
)
_number_part = re.compile(rf"({DIGIT_WORD})|(plus)|({DOT})|(dash|minus)", re.I)


def spelled_numbers(tape: Tape) -> Tape:
    """Runs of at least three spelled digits, with the signs between them, become numbers without blanks."""

    def edits():
        for m in _number.finditer(tape.text):
            parts = [(p, DIGITS.get(p[0].lower(), "+" if p[2] else "." if p[3] else "-")) for p in _number_part.finditer(m[0])]
            if sum(s.isdigit() for _, s in parts) >= LEAST_SPELLED:
                yield m.start(), m.end(), "".join(s for _, s in parts)

    return tape.rewritten(edits())


_open, _close = r"[(\[{<]", r"[)\]}>]"
_bracketed = {
    sign: re.compile(rf"[ \t]{{0,3}}{_open}[ \t]{{0,3}}(?:{words})[ \t]{{0,3}}{_close}[ \t]{{0,3}}", re.I)
    for sign, words in (("@", "@|" + "|".join(AT_AND_DOT)), (".", r"\.|" + DOT))
}
_LABEL = "[A-Za-z0-9-]{1,63}"
_ahead = lambda dots: rf"(?=(?!(?:{NO_DOMAIN}){_B}){_LABEL}(?:\.{_LABEL}){{0,3}}{_B}(?:{dots}){_B}[A-Za-z0-9])"
_anchor = re.compile(
    "|".join([rf"(?<=[A-Za-z0-9_%+-])@{_ahead(DOT)}", *[rf"(?<=[A-Za-z0-9_%+-]){_B}{at}{_B}{_ahead(dots)}" for at, dots in AT_AND_DOT.items()]]), re.I
)
_bare_dot = re.compile(rf"{_B}(?:{DOT}){_B}", re.I)
_before = re.compile(rf"(?<![\w.%+-])[\w%+-]{{1,64}}(?:(?:\.|{_B}(?:{DOT}){_B})[\w%+-]{{1,64}}){{0,3}}\Z", re.I | re.A)
_behind = re.compile(rf"{_LABEL}(?:(?:\.|{_B}(?:{DOT}){_B}){_LABEL}){{1,5}}(?![\w-])", re.I | re.A)
LONGEST = 260


def bracketed_signs(tape: Tape) -> Tape:
    """(at), [dot] and their like, with the blanks around them."""
    found = sorted((m.start(), m.end(), sign) for sign, rule in _bracketed.items() for m in rule.finditer(tape.text))
    apart = [f for i, f in enumerate(found) if not i or f[0] >= found[i - 1][1]]
    return tape.rewritten(iter(apart))


def spelled_addresses(tape: Tape) -> Tape:
    """Bare at and dot between words, only in a whole address in which a dot behind the at is spelled."""

    def edits():
        text, done = tape.text, 0
        for anchor in _anchor.finditer(text):
            low = max(done, anchor.start() - LONGEST)
            before, behind = _before.search(text[low : anchor.start()]), _behind.match(text, anchor.end())
            if not before or not behind or (anchor[0] != "@" and behind[0].lower().split(".")[-1].split()[-1] not in ENDINGS):
                continue
            start = low + before.start()
            signs = [(m.start(), m.end(), ".") for m in _bare_dot.finditer(text, start, anchor.start())]
            if anchor[0] != "@":
                signs.append((anchor.start(), anchor.end(), "@"))
            yield from signs + [(m.start(), m.end(), ".") for m in _bare_dot.finditer(text, anchor.end(), behind.end())]
            done = behind.end()

    return tape.rewritten(edits())


#: In this order: each reads what the ones before it wrote.
TRANSDUCERS: list[Transducer] = [look_alikes, references, bracketed_signs, spelled_numbers, spelled_addresses]


def normalised(text: str) -> Tape:
    tape = Tape(text, [])
    for transducer in TRANSDUCERS:
        tape = transducer(tape)
    return tape


_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_dotted = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?+")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = _domain.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return found


def addresses(text: str) -> list[Span]:
    return [m.span() for m in _dotted.finditer(text) if "." in m[0] and all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _digits.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}
_letters_last = re.compile(r"\.[A-Za-z]{2,24}\Z")


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans by kind, and the spans that the transducers add, both in source characters."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = {kind: detect(text) for kind, detect in DETECTORS.items()}
    tape = normalised(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if tape.marks:
        for kind, detect in DETECTORS.items():
            ends = [e for _, e in base[kind]]
            for start, end in detect(tape.text):
                if not tape.touched(start, end) or (kind == "email" and not _letters_last.search(tape.text[max(start, end - 30) : end])):
                    continue
                span = tape.source(start, end)
                i = bisect_left(ends, span[1])
                if i == len(ends) or base[kind][i][0] > span[0]:
                    added[kind].append(span)
    return base, added


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's spans: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    ``spans`` lists base and added spans as kind:start:end, by kind and then start; offsets count code points.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in pieces(batches, "text"):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, extra = [], [], []
            for text in batch.column("text").to_pylist():
                base, added = find(text)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(base[k]))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed({k: sorted(base[k] + added[k]) for k in KINDS}))
                extra.append(sum(map(len, added.values())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(scan, f"doc_id {kind}, {columns}, base_sha256 string, spans string, n_added long")
