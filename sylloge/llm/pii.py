"""Personal data found behind disguises, with spans in the source text.

Transducers rewrite a text and keep, for every rewritten stretch, the source characters it came from:
characters that look like ASCII ones, invisible characters, letters in place of digits, digits that are spelled out and
"at" and "dot" written as words. Identifiers are then detected in the rewritten text, and their spans are
mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .tokens import chunks

KINDS = ("email", "ip", "card", "iban", "ssn", "phone")
#: Spelled digits that a run has at least to be read as digits.
SPELLED = 4

# -- characters ---------------------------------------------------------------------------------------

_LOOKS = {
    "АВСЕНІЈКМОРЅТХҮԚԜаеорсухіјѕһԁԛԝѵ": "ABCEHIJKMOPSTXYQWaeopcyxijshdqwv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι": "ABEZHIKMNOPTYXoavpi",
    "ıɑɡ": "iag",
    "․‧。．∙": ".....",
    "＠﹫": "@@",
    "‐‑‒–−﹣－": "-------",
}
_INVISIBLE = "­​‌‍⁠﻿᠎‎‏"


def _homoglyphs() -> dict[int, str]:
    """One character for one: look-alike letters, full-width and mathematical forms, digits of all scripts."""
    out: dict[int, str] = {}
    for block in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EB), (0x1F130, 0x1F18A), (0x00B2, 0x00BA), (0x2070, 0x20A0)):
        for c in range(*block):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                out[c] = plain
    for c in range(0x660, 0x1D7FF + 1):
        d = unicodedata.decimal(chr(c), None)
        if d is not None:
            out[c] = str(d)
    for c in range(26):
        out[0x24B6 + c], out[0x24D0 + c] = chr(65 + c), chr(97 + c)
        out[0x1F130 + c] = out[0x1F150 + c] = out[0x1F170 + c] = chr(65 + c)
    for odd, plain in _LOOKS.items():
        out.update({ord(a): b for a, b in zip(odd, plain, strict=True)})
    return out


HOMOGLYPHS = _homoglyphs()
_ODD = frozenset(map(chr, HOMOGLYPHS))
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")

# -- words --------------------------------------------------------------------------------------------

_DIGITS = {
    "en": "zero oh|one|two|three|four|five|six|seven|eight|nine",
    "fr": "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "de": "null|eins|zwei zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "es": "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
}
DIGIT_WORDS = {w: str(i) for words in _DIGITS.values() for i, ws in enumerate(words.split("|")) for w in ws.split()}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[ \t]*[-,. \t\n]?[ \t]*"
#: Two spelled digits in a row; every run of SPELLED has them, and few other texts do.
_TWO = re.compile(rf"[{''.join(sorted({w[-1] for w in DIGIT_WORDS}))}0-9][-,. \t\n()]{{1,3}}{_WORD}(?!\w)")
_RUN = re.compile(rf"(?<!\w)(?:(?:\bplus\b|\+){_GAP})?(?:{_WORD}(?!\w)|\d)(?:[-,. \t\n()]{{0,3}}(?:\b{_WORD}\b|\bpoint\b|\bdot\b|\d))+(?!\w)", re.I)
_PART = re.compile(rf"\b(?P<word>{_WORD})\b|\b(?P<plus>plus)\b|\b(?P<dot>dot|point)\b|(?P<digit>\d)|(?P<gap>[^\w]+)", re.I)
_DOTS = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\s*_dot_\s*|\.)"
_MARKED_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba|arobase|ät)\s*[\])}>]\s*|\s*_at_\s*)"
_BARE_AT = r"\s+(?:at|arroba|arobase|ät)\s+"
_DOMAIN = rf"[A-Za-z0-9-]{{1,63}}(?:{_DOTS}[A-Za-z0-9-]{{1,63}})+"
_LOCAL_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\s*_dot_\s*)"
#: Of these in lower case, any text with a disguised address has one.
_SIGN_WORDS = ("dot", "punkt", "punto", "arroba", "arobase", "_at_", " @", "@ ")
_SIGNS = re.compile(r"[\[({<]\s*(?:at|@|ät|\.|point)\s*[\])}>]|t\s+[\w-]+\.\w")
_AT = re.compile(rf"(?P<marked>{_MARKED_AT})|(?P<bare>{_BARE_AT})|(?P<plain>\s?@\s?)", re.I)
_DOMAIN_AT = re.compile(_DOMAIN, re.I)
_DOT = re.compile(_DOTS, re.I)
_LOCAL_END = re.compile(rf"(?:[A-Za-z0-9._%+-]{{1,64}}{_LOCAL_DOT}){{0,4}}[A-Za-z0-9._%+-]{{1,64}}\Z", re.I)
_WORDY_DOT = re.compile(r"dot|punkt|punto|point|[\[({<]", re.I)
_WORDY_IP = re.compile(rf"(?<![\w.])\d{{1,3}}(?:{_DOTS}\d{{1,3}}){{3}}(?!\w)", re.I)
_MIXED = re.compile(r"\d[OolI]|[OolI]\d")
_LEET = re.compile(r"(?<![\w.+@-])(?=[OolI]*\d)[\dOolI]+(?:[-. ][\dOolI]+)*(?![\w@])")
#: Letters that stand for digits among digits.
LEET = {"O": "0", "o": "0", "l": "1", "I": "1"}

Edits = list[tuple[int, int, str]]


def _rewritten(text: str, edits: Edits, back: tuple[list[int], list[tuple[int, int, bool]]] | None = None):
    """The text with the edits, in order and apart, done, and the map back to it."""
    starts, sources, parts, at, n = [], [], [], 0, 0
    for a, b, new in edits:
        if a > at:
            starts.append(n)
            sources.append((at, a, True))
            parts.append(text[at:a])
            n += a - at
        starts.append(n)
        sources.append((a, b, False))
        parts.append(new)
        n += len(new)
        at = b
    starts.append(n)
    sources.append((at, len(text), True))
    parts.append(text[at:])
    return "".join(parts), (starts, sources)


def mapped(back, a: int, b: int) -> tuple[int, int]:
    """The source span of the rewritten characters a to b."""
    starts, sources = back
    i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
    first = sources[i][0] + (a - starts[i] if sources[i][2] else 0)
    last = sources[j][0] + (b - starts[j]) if sources[j][2] else sources[j][1]
    return first, last


def hidden(text: str) -> Edits:
    """Invisible characters go."""
    return [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)]


def leet(text: str) -> Edits:
    """Letters among digits, where at least half of seven or more characters, or six, are digits."""
    out: Edits = []
    for m in _LEET.finditer(text) if _MIXED.search(text) else ():
        s = m.group()
        if sum(c.isdigit() for c in s) * 2 >= sum(c.isalnum() for c in s) >= 7 or (sum(map(str.isdigit, s)) >= 6 and any(c in LEET for c in s)):
            out += [(m.start() + i, m.start() + i + 1, LEET[c]) for i, c in enumerate(s) if c in LEET]
    return out


def spelled(text: str) -> Edits:
    """Runs of digits of which SPELLED or more are words; gaps beside a word go, but a hyphen, dot or bracket stays between digits."""
    if not _TWO.search(text.lower()):
        return []
    out: Edits = []
    for m in _RUN.finditer(text):
        parts = list(_PART.finditer(m.group()))
        if sum(p["word"] is not None for p in parts) < SPELLED:
            continue
        for i, p in enumerate(parts):
            a, b = m.start() + p.start(), m.start() + p.end()
            if p["word"]:
                out.append((a, b, DIGIT_WORDS[p["word"].lower()]))
            elif p["plus"]:
                out.append((a, b, "+"))
            elif p["dot"]:
                out.append((a, b, "."))
            elif p["gap"]:
                near = [parts[k] for k in (i - 1, i + 1) if 0 <= k < len(parts)]
                alone = all(not parts[k]["digit"] for k in (i - 2, i + 2) if 0 <= k < len(parts))
                if (alone or any(not q["digit"] for q in near)) and "(" not in p["gap"] and ")" not in p["gap"] and p["gap"].strip(" \t\n,") in ("", "-"):
                    out.append((a, b, ""))
    return out


def numeric_dots(text: str) -> Edits:
    """Four numbers with the word dot between them."""
    return [(m.start() + d.start(), m.start() + d.end(), ".") for m in _WORDY_IP.finditer(text) for d in re.finditer(_DOTS, m.group(), re.I) if d.group() != "."]


def at_and_dot(text: str) -> Edits:
    """An address whose signs are words or in brackets.

    A bare "at" is a disguise where a dot of the domain is one too, or where the name holds a digit, dot
    or underscore, as in "j.doe at example.org".
    """
    low = text.lower()
    if not any(w in low for w in _SIGN_WORDS) and not _SIGNS.search(low):
        return []
    out: Edits = []
    done = 0
    for m in _AT.finditer(text):
        domain = _DOMAIN_AT.match(text, m.end())
        if not domain or m.start() < done:
            continue
        further = _AT.match(text, domain.end())
        host = m["bare"] and further and _DOMAIN_AT.match(text, further.end())
        if host and re.fullmatch(r"[A-Za-z]{2,24}", _DOT.split(host.group())[-1]) and (not further["bare"] or any(d.group() != "." for d in _DOT.finditer(host.group()))):
            continue  # what looks like the domain is the name before the next sign, which is the plainer one
        local = _LOCAL_END.search(text, max(done, m.start() - 120), m.start())
        if not local:
            continue
        begin = local.start()
        dots = [d for d in _DOT.finditer(domain.group())]
        wordy = [d for d in dots if d.group() != "."]
        if m["bare"]:
            name = re.split(r"\s", local.group())[-1]
            if not wordy and not re.search(r"[\d._]", name.strip(".")):
                continue
            if wordy and not all(re.fullmatch(r"[A-Za-z0-9-]+", x) for x in _DOT.split(domain.group())):
                continue
        if m["plain"] and not wordy and not _WORDY_DOT.search(local.group()) and m.group() == "@":
            continue
        for d in re.finditer(_LOCAL_DOT, local.group(), re.I):
            out.append((begin + d.start(), begin + d.end(), "."))
        if m.group() != "@":
            out.append((m.start(), m.end(), "@"))
        out += [(domain.start() + d.start(), domain.start() + d.end(), ".") for d in wordy]
        done = domain.end()
    taken = [(a, b) for a, b, _ in out]
    out += [e for e in numeric_dots(text) if not any(a < e[1] and e[0] < b for a, b in taken)]
    return sorted(out)


# -- identifiers --------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+'-]*\Z")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NUMBERS = re.compile(r"\d[\d .()/\t-]{5,}\d")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_CARD = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}([- ])(?!00)\d\d\1(?!0000)\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}"
    r"|(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,3}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3})(?![\d-])"
)
_TEN = re.compile(r"(?<![\d.-])\d{10,11}(?![\d.-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(code: str) -> bool:
    s = code.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def card(digits: str) -> bool:
    """13 to 19 digits with a valid check digit, not all the same."""
    return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1


def identifiers(text: str, rewritten: list[tuple[int, int]] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and apart. rewritten: spans in which ten bare digits are a telephone number."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        name, host = _LOCAL.search(text, max(0, at - 65), at), _HOST.match(text, at + 1)
        if name and host and 0 < len(local := name.group().lstrip(".'-+%")) <= 64 and not local.endswith("."):
            found.append((at - len(local), host.end(), "email"))
        at = text.find("@", at + 1)
    for m in _IBAN.finditer(text):
        if iban(m.group()):
            found.append((m.start(), m.end(), "iban"))
    for run in _NUMBERS.finditer(text):
        a, b = run.span()
        while a and a > run.start() - 3 and text[a - 1] in "+( ":
            a -= 1
        # context on either side decides what borders a number
        own: list[tuple[int, int, str]] = []
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE), ("phone", _TEN)):
            for m in pattern.finditer(text, a, b):
                if any(m.start() < y and x < m.end() for x, y, _ in own):
                    continue
                digits = re.sub(r"\D", "", m.group())
                if kind == "card" and not card(digits) or kind == "phone" and not 7 <= len(digits) <= 15:
                    continue
                if pattern is _TEN and not any(x <= m.start() < y for x, y in rewritten):
                    continue
                if m.start() and text[m.start() - 1].isalnum() or text[m.end() : m.end() + 1].isalnum():
                    continue
                own.append((m.start(), m.end(), kind))
        found += own
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of the identifiers of a text; the span is of source characters."""
    steps = []
    now = text
    if not now.isascii():
        used = set(now)
        if not _ODD.isdisjoint(used):
            now = now.translate(HOMOGLYPHS)
        if not used.isdisjoint(_INVISIBLE):
            now, back = _rewritten(now, hidden(now))
            steps.append(back)
    changed: list[tuple[int, int]] = []
    for step in (at_and_dot, spelled, leet):
        if edits := step(now):
            now, back = _rewritten(now, edits)
            steps.append(back)
            if step is not at_and_dot:
                changed = [(starts_i, starts_i + 1) for starts_i, (_, _, same) in zip(*back) if not same] + changed
    out = []
    for a, b, kind in identifiers(now, changed):
        x, y = a, b
        for back in reversed(steps):
            x, y = mapped(back, x, y)
        value = now[a:b]
        out.append((kind, x, y, value.lower() if kind == "email" else re.sub(r"[^\w.+]", "", value)))
    return out


SPANS = "doc_id long, kind string, start int, end int, value string"


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, end, value): every identifier in every text.

    start and end count characters of the source text, from 0, end excluded; value is the identifier without
    disguise. Spans of a text don't overlap. Null and empty texts have none; rows with a null id are
    scanned and keep it, repeated rows repeat; an empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(i, *x) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if t for x in scan(t)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "kind", "start", "end", "value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, SPANS)


def redact(text: str) -> str:
    out, at = [], 0
    for kind, a, b, _ in scan(text):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each identifier of the text replaced by its kind in angle brackets.

    Null texts stay null and empty ones empty; whole texts are rewritten, however long; of identifiers that overlap the first
    one counts. Rows stay as they are, repeated ones and null ids too; an empty table gives an empty one; columns and their names
    are those of docs, whatever they are.
    """

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if t is None else redact(t) for t in part.to_pylist()], pa.string())

    clean = fresh(docs, "clean_text")
    return docs.withColumn(clean, run(F.col(text).cast("string"))).withColumn(text, F.col(clean)).drop(clean)
