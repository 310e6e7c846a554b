import hashlib
import random
import re
import time

import duckdb
import pytest
from cases import documents, edge_rows, syllables

from givetide.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(EMAIL, text)],
        "ip": [m.span() for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(CARD, text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))],
        "phone": [m.span() for m in re.finditer(PHONE, text) if 9 <= len(only(m[0])) <= 15],
    }


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@", ".", ".", "-", "+", "%", "_", " ", "1", "22", "255", "256", "0", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "(", ")", "é", "\n", "x@y.de", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find(text)[0] == plain(text), text


DISGUISED = {
    "write to jane.doe (at) example (dot) com today": ("email", "jane.doe (at) example (dot) com"),
    "write to jane.doe[at]example.com today": ("email", "jane.doe[at]example.com"),
    "write to jane dot doe at mail dot example dot com today": ("email", "jane dot doe at mail dot example dot com"),
    "jane@example dot org is hers": ("email", "jane@example dot org"),
    "Schreib an jens at beispiel punkt de bitte": ("email", "jens at beispiel punkt de"),
    "écrivez à jean arobase exemple point fr ici": ("email", "jean arobase exemple point fr"),
    "escribe a juan arroba ejemplo punto com ya": ("email", "juan arroba ejemplo punto com"),
    "to jаne@exаmple.com now": ("email", "jаne@exаmple.com"),
    "to jane@exam​ple.com now": ("email", "jane@exam​ple.com"),
    "to jane&#64;example&#46;com now": ("email", "jane&#64;example&#46;com"),
    "host 10[.]20[.]30[.]40 is down": ("ip", "10[.]20[.]30[.]40"),
    "host one nine two dot one six eight dot zero dot one is down": ("ip", "one nine two dot one six eight dot zero dot one"),
    "card ４111 1111 1111 1111 lapsed": ("card", "４111 1111 1111 1111"),
    "card four one one one, one one one one, one one one one, one one one one lapsed": ("card", "four one one one, one one one one, one one one one, one one one one"),
    "call plus four nine eins fünf eins zwo drei vier fünf sechs sieben now": ("phone", "plus four nine eins fünf eins zwo drei vier fünf sechs sieben"),
    "call +44 two zero seven nine four six zero nine five eight now": ("phone", "+44 two zero seven nine four six zero nine five eight"),
    "call +44 20 7946 0958 now": ("phone", "+44 20 7946 0958"),
}


@pytest.mark.parametrize("text", list(DISGUISED))
def test_disguises_are_found_and_mapped_to_the_source(text):
    kind, wanted = DISGUISED[text]
    for prefix in ("", "а​ß 中 [at] & ", "ﬀ " * 50):
        _, added = pii.find(prefix + text)
        assert [(prefix + text)[a:b] for a, b in added[kind]] == [wanted]
        assert sum(map(len, added.values())) == 1


PROSE = [
    "We met at noon and left at this point in time.", "Look at the dot in the middle.", "He lives at Oak Street. Come by at 5.30 pm.",
    "One two three four five six seven eight nine ten, said the child.", "Привет, как дела? Это просто текст.", "Call me at home, or at work (at any time).",
    "Version 1.2.3 of 2024-01-31 costs 1 000 000.", "Un deux trois, nous irons au bois.", "a point b point c", "Ηλίας και Ρόδος.", "sum of seven plus three minus two",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_left_alone(text):
    base, added = pii.find(text)
    assert not any(base.values()) and not any(added.values())


@pytest.mark.parametrize("unit", ["a", "1", " ", "@", ".", "(", "+", "a@", "1.", "1 ", " at", "one ", "dot ", "[at]", "а", "​", "&#64;", "a at b dot ", "- "])
def test_time_grows_with_the_text_only(unit):
    started = time.perf_counter()
    pii.find(unit * (500_000 // len(unit)))
    assert time.perf_counter() - started < 15


def test_tapes_map_back_after_several_rewritings():
    text = "x​y а(at)b [dot] cоm z"
    tape = pii.normalised(text)
    assert tape.text == "xy a@b.com z"
    at = tape.text.index("a@b.com")
    start, end = tape.source(at, at + 7)
    assert text[start:end] == "а(at)b [dot] cоm"
    assert tape.source(0, 2) == (0, 3)
    assert tape.touched(0, 2) and not tape.touched(10, len(tape.text))


def test_rows_and_digests(spark):
    rows = edge_rows() + [(20, "a@b.cd a@b.cd 1.2.3.4 é", "en", "a", 0), (21, "jane (at) example.com", "en", "a", 0)]
    got = sorted((tuple(r) for r in pii.find_personal_data(documents(spark, rows)).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        base, added = plain(text), pii.find(text)[1]
        joined = lambda s: ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in sorted(s[k]))
        spans = {k: base[k] + added[k] for k in pii.KINDS}
        want.append((i, *[len(base[k]) for k in pii.KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(map(len, added.values()))))
    assert got == sorted(want, key=str)
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_given_documents_have_the_patterns_and_little_else(spark):
    texts = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    extra = 0
    for (text,) in texts:
        base, added = pii.find(text)
        assert base == plain(text)
        extra += sum(map(len, added.values()))
    assert extra <= len(texts) // 100


def test_long_texts(spark):
    rng = random.Random(2)
    text = syllables(rng, 1_100_000) + " jane (at) example (dot) com"
    (row,) = pii.find_personal_data(documents(spark, [(1, text, "en", "a", 0)])).collect()
    assert row["spans"] == f"email:{len(text) - 27}:{len(text)}"
