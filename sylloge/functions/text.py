"""Words as the search operators see them, edit distance, and texts that hold secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with a stem of their own.
IRREGULAR = {"are": "be", "been": "be", "is": "be", "was": "be", "were": "be", "children": "child", "grandchildren": "grandkin", "had": "have", "has": "have"}
#: Words that searches leave out.
STOP = tuple(
    "i me my we our ours you your he him his she her hers it its they them their "
    "be is are was were been do does did have has had who what which why how when where "
    "the this that there a an to of on in at by for with from into or and but if so as".split()
)
FUZZY = (4, 64)


def stem(w: Column) -> Column:
    n = F.length(w)
    out = F
    for of in dict.fromkeys(IRREGULAR.values()):
        out = out.when(w.isin(*[k for k, v in IRREGULAR.items() if v == of]), of)
    out = out.when((n > 5) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
    out = out.when((n > 5) & w.endswith("ing"), F.regexp_replace(w, "ing$", "")).when((n > 4) & w.endswith("ed"), F.regexp_replace(w, "ed$", ""))
    out = out.when((n > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.when(out.isin("grandchild", "grandparent"), "grandkin").otherwise(out)


def words(text: Column) -> Column:
    """An array of words: camelCase split, lower case, letters and digits only, stemmed."""
    flat = F.lower(F.regexp_replace(text, "(?<=[0-9a-z])(?=[A-Z])", " "))
    return F.transform(F.filter(F.split(flat, "[^a-z0-9]+"), lambda w: w != ""), stem)


def search_words(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: ~w.isin(*STOP)))


def nearly(a: Column, b: Column) -> Column:
    """Whether two words of 4 to 64 characters differ by one edit at most."""
    sized = lambda c: F.length(c).between(*FUZZY)
    return sized(a) & sized(b) & (F.levenshtein(a, b, 1) >= 0)


_SPELLED = {"password": "passwd", "secret": "", "api key": "", "access token": "", "refresh token": "", "credit card": "", "account number": ""}
_ALL = [w.replace(" ", "[_ -]?") for pair in _SPELLED.items() for w in pair if w]
#: Names of what is private, and of what is handed out.
PRIVATE = "(?:" + "|".join(_ALL) + ")"
HANDED = "(?:" + "|".join(w for w in _ALL if "number" not in w and "card" not in w) + ")"
SENSITIVE = (
    rf"(?i)\b{PRIVATE}\b[\"']?\s*(?:=|:|is)\s*[\"']?\S+",
    rf"(?i)\b{PRIVATE}\s*\(",
    rf"(?i)\b(?:the|my|your)\s+{HANDED}\s+(?=\S*[-0-9._~+/=])\S{{6,}}",
    r"(?i)\bbearer\s+[-a-z0-9._~+/=]{8,}",
    r"(?i)\b(?:gh[porsu]|sk)[_-][-a-z0-9_]{8,}",
    r"\b(?:\d[ -]*){13,19}\b",
)
_ADVICE = ("advice", "suggest(?:ion)?s?", "recommend(?:ation)?s?", "ideas?", "tips", "choose", "decide", "looking for", "what should", "should i", "could there be (?:a )?reason")
ADVICE = rf"(?i)\b(?:{'|'.join(_ADVICE)})\b"
REDACTED = "[sensitive text redacted]"


def is_sensitive(text: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE:
        out = out | text.rlike(p)
    return out


def redact(text: Column) -> Column:
    """The text, or REDACTED in its place if it holds anything sensitive."""
    return F.when(is_sensitive(text), REDACTED).otherwise(text)


def asks_for_advice(text: Column) -> Column:
    """Whether a question wants a recommendation, for which vectors serve better than words."""
    return text.rlike(ADVICE)
