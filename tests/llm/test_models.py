"""Language models, secrets and personal data over a table, against versions by dictionaries and single characters."""

import collections
import math
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from sylloge.llm import pii, queries, secrets, toxicity
from sylloge.llm.common import table
from tests.conftest import SF

SF1 = "/root/testdata/sf0.01"


# -- toxicity -----------------------------------------------------------------------------------------


def grams_of(word):
    points = [ord(c) for c in word]
    s = [1] * 4 + [p + 3 if p < 592 else 595 + p % 429 for p in points] + [2]
    return [tuple(s[i : i + 5]) for i in range(len(word) + 1)]


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())


class KneserNey:
    """By dictionaries, gram by gram."""

    D = 0.75

    def __init__(self, rows):
        self.n = [collections.Counter(), collections.Counter()]
        for text, toxic in rows:
            for w in words_of(text):
                self.n[toxic].update(grams_of(w))
        self.seen = {5: set(self.n[0]) | set(self.n[1])}
        self.shared = {}
        for k in (4, 3, 2, 1):
            self.seen[k] = {g[1:] for g in self.seen[k + 1]}
        for k in (1, 2, 3, 4):
            n = collections.Counter(g[1:] for g in self.seen[k + 1])
            total, kinds = collections.Counter(), collections.Counter()
            for g, x in n.items():
                total[g[:-1]] += x
                kinds[g[:-1]] += 1
            for g, x in n.items():
                below = self.shared[g[1:]] if k > 1 else 1 / 1024
                self.shared[g] = (max(x - self.D, 0) + self.D * kinds[g[:-1]] * below) / total[g[:-1]]
        self.total = [collections.Counter(), collections.Counter()]
        self.kinds = [collections.Counter(), collections.Counter()]
        for c in (0, 1):
            for g, x in self.n[c].items():
                self.total[c][g[:-1]] += x
                self.kinds[c][g[:-1]] += 1
        self.contexts = {g[:-1] for g in self.seen[5]}

    def ratio(self, g):
        if g[:-1] not in self.contexts:
            return 0.0
        logs = []
        for c in (0, 1):
            total = self.total[c][g[:-1]]
            weight = self.D * self.kinds[c][g[:-1]] / total if total else 1.0
            logs.append(math.log(max(self.n[c][g] - self.D, 0) / max(total, 1) + weight * self.shared[g[1:]] if g in self.seen[5] else weight))
        return logs[1] - logs[0]

    def ratios(self, text):
        words = words_of(text)
        if not words:
            return 0.0, 0.0
        each = {w: sum(map(self.ratio, grams_of(w))) for w in set(words)}
        return max(each[w] / (len(w) + 1) for w in words), sum(max(each[w] - 3, 0) for w in words) / (len(words) + 50)


def test_kneser_ney_over_a_table(spark):
    docs, marks = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    held = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(5)) == 0
    toxic = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    rows = [(r["doc_id"], r["text"], r["held"]) for r in docs.select("doc_id", "text", held.alias("held")).collect()]
    part = KneserNey([(t, toxic[i]) for i, t, h in rows if i in toxic and not h])
    model = toxicity.fit(docs, marks)
    judged = [(*part.ratios(t), toxic[i]) for i, t, h in rows if i in toxic and h]
    step = lambda x, s: math.floor(x / s + 1e-9) * s

    def errors(a, b):
        return sum((step(x, toxicity.STEPS[0]) >= a or step(y, toxicity.STEPS[1]) >= b) != bool(t) for x, y, t in judged)

    tries = [*(step(x, toxicity.STEPS[0]) for x, _, _ in judged), 99.0], [*(step(y, toxicity.STEPS[1]) for _, y, _ in judged), 99.0]
    assert errors(*model.thresholds) <= min(errors(a, b) for a in set(tries[0]) if a > 0 for b in set(tries[1]) if b > 0) + 1
    whole = KneserNey([(t, toxic[i]) for i, t, _ in rows if i in toxic])
    want = {i: max(r / t for r, t in zip(whole.ratios(t), model.thresholds)) for i, t, _ in rows}
    got = {r["doc_id"]: r["score"] for r in queries.op4_toxicity(spark, SF1).collect()}
    close = {i for i, s in want.items() if abs(s - 1) < 1e-4}
    assert set(got) - close == {i for i, s in want.items() if s >= 1} - close and len(got) > 20
    assert all(abs(got[i] - want[i]) < 1e-4 for i in got)


def test_words_with_digits_count(spark):
    rows = [(i, "kind words for all of us here " + str(i), 0) for i in range(60)] + [(100 + i, "you are a w0rthl3ss 1d10t here", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows] + [(999, "such a w0rthl3ss 1d10t, that", "en", "s", 1), (998, "a kind thing", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, marks).collect()}
    assert found == {100 + i for i in range(60)} | {999}


# -- secrets ------------------------------------------------------------------------------------------


class Chain:
    """log P(character | two before it), from counts in dictionaries."""

    def __init__(self, texts):
        self.two, self.one, self.none = (collections.Counter() for _ in range(3))
        for t in texts:
            s = ["", "", *(c if c in secrets.CHARS else "?" for c in t)]
            for a, b, c in zip(s, s[1:], s[2:]):
                self.two[a, b, c] += 1
                self.two[a, b] += 1
                self.one[b, c] += 1
                self.one[b] += 1
                self.none[c] += 1
        self.n = sum(self.none.values())

    def log(self, token):
        s, out = ["", "", *(c if c in secrets.CHARS else "?" for c in token)], 0.0
        for a, b, c in zip(s, s[1:], s[2:]):
            p = (self.none[c] + 0.5) / (self.n + 0.5 * (len(secrets.CHARS) + 2))
            p = (self.one[b, c] + 4 * p) / (self.one[b] + 4)
            out += math.log((self.two[a, b, c] + 4 * p) / (self.two[a, b] + 4))
        return out


RUN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")


def runs(text, inside, least=16):
    """(start, end) of the longest runs of some characters, less the signs before them, with up to two signs of equality after them."""
    out, i = [], 0
    while i < len(text):
        if text[i] not in inside:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in inside:
            j += 1
        a = i
        while a < j and text[a] in "+/_-":
            a += 1
        if j - a >= least:
            b = j
            while b < len(text) and b < j + 2 and text[b] == "=":
                b += 1
            out.append((a, b))
        i = j
    return out


def named(text):
    """(start, end) of what stands after a name such as password and a sign of equality."""
    low, out, at = text.lower(), [], 0
    names = [f"{a}{s}key" for a in ("api", "access", "private") for s in ("", "_", "-")] + [f"client{s}secret" for s in ("", "_", "-")]
    names += ["password", "passwd", "pwd", "passphrase", "secret", "token", "auth", "credential"]
    while at < len(text):
        best = None
        for n in names:
            if not low.startswith(n, at):
                continue
            for plural in ("s", ""):
                k = at + len(n)
                if not low.startswith(plural, k):
                    continue
                k += len(plural)
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                while k < len(text) and text[k].isspace():
                    k += 1
                sign = next((s for s in ("=>", ":=", "=", ":") if text.startswith(s, k)), None)
                if sign is None:
                    continue
                k += len(sign)
                while k < len(text) and text[k].isspace():
                    k += 1
                k += text[k : k + 1] in ("'", '"', "`") and text[k : k + 1] != ""
                e = k
                while e < len(text) and not text[e].isspace() and text[e] not in "\"'`,;<>(){}[]":
                    e += 1
                if e - k >= 8:
                    best = (k, e)
                    break
            if best:
                break
        if best:
            out.append(best)
            at = best[1]
        else:
            at += 1
    return out


def secrets_of(text, score):
    """(start, end, named) by single characters."""
    first = named(text)
    todo = [(a, b, True) for a, b in first] + [(a, b, False) for a, b in runs(text, RUN) if not any(a < y and x < b for x, y in first)]
    out = []
    for a, b, is_named in todo:
        if score(text[a:b]) >= (0.0 if is_named else 12.0):
            out.append((a, b, is_named))
            continue
        inner = [(a + x, a + y) for x, y in runs(text[a:b], RUN)] if is_named else [(a, b)]
        for x, y in inner:
            if is_named and score(text[x:y]) >= 12.0:
                out.append((x, y, False))
            elif "/" in text[x:y]:
                k = x
                for piece in text[x:y].split("/"):
                    for u, v in runs(piece, RUN):
                        if score(piece[u:v]) >= 12.0:
                            out.append((k + u, k + v, False))
                    k += len(piece) + 1
    return sorted(out)


def test_secrets_over_a_table(spark):
    docs, marks = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    labelled = {r["doc_id"] for r in marks.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(labelled) <= secrets.SAMPLE_DOCS
    count = collections.Counter(w for i, t in rows if i in labelled for w in regex.findall(r"\p{L}+", t) if len(w) > 1)
    ordinary = secrets.ordinary_samples([w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))], secrets.SAMPLES)
    bad, good = Chain(secrets.random_samples(secrets.SAMPLES)), Chain(ordinary)
    score = lambda t: bad.log(t) - good.log(t)
    got = {(r["doc_id"], r["start"], r["end"], r["named"]): r["score"] for r in queries.op8_secrets(spark, SF1).collect()}
    want = {(i, *x) for i, t in rows for x in secrets_of(t, score)}
    text = dict(rows)
    close = {x for x in want ^ set(got) if abs(score(text[x[0]][x[1] : x[2]]) - (0 if x[3] else 12)) < 1e-2}
    assert want - close == set(got) - close and len(want) > 10
    assert all(abs(s - score(text[x[0]][x[1] : x[2]])) < 1e-2 for x, s in got.items())


# -- personal data ------------------------------------------------------------------------------------


def numbers(text):
    """(start, end, kind) of numbers that identify, tried at every place, in the order of kinds."""
    kinds = [
        ("ip", r"(?:\d{1,3}\.){3}\d{1,3}", r"[\d.]", r"\.?\d"), ("card", r"\d(?:[ -]?\d){12,18}", r"[\d-]", r"[\d-]"),
        ("ssn", r"\d{3}([- ])\d\d\1\d{4}", r"[\d-]", r"[\d-]"),
        ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}|(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,3}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3}", r"[\d.]", r"[\d-]"),
    ]
    taken, out = [False] * (len(text) + 1), []
    for kind, body, before, after in kinds:
        pattern = re.compile(rf"(?:{body})(?!{after})")
        i = 0
        while i < len(text):
            m = pattern.match(text, i) if i == 0 or not re.match(before, text[i - 1]) else None
            if not m:
                i += 1
                continue
            a, b = m.span()
            digits = [int(c) for c in m.group() if c.isdigit()]
            fine = not any(taken[a:b]) and not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum()
            if kind == "ip":
                parts = m.group().split(".")
                fine &= all(int(p) < 256 and (len(p) < 3 or p[0] != "0") for p in parts)
            if kind == "card":
                double = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
                fine &= double % 10 == 0 and len(set(digits)) > 1
            if kind == "ssn":
                area, group, serial = (int("".join(map(str, digits[x:y]))) for x, y in ((0, 3), (3, 5), (5, 9)))
                fine &= area not in (0, 666) and area < 900 and group > 0 and serial > 0
            if kind == "phone":
                fine &= 7 <= len(digits) <= 15
            if fine:
                out.append((a, b, kind))
                taken[a:b] = [True] * (b - a)
            i = b
    return out


def addresses(text):
    out = []
    for at in (m.start() for m in re.finditer("@", text)):
        a = at
        while a and (text[a - 1].isascii() and text[a - 1].isalnum() or text[a - 1] in "._%+'-"):
            a -= 1
        while a < at and text[a] in ".'-+%":
            a += 1
        host = re.match(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", text[at + 1 :])
        if 0 < at - a <= 64 and host and text[at - 1] != ".":
            out.append((a, at + 1 + host.end(), "email"))
    return out


def test_pii_over_a_table(spark):
    """Texts of a table hold no disguises: there what single characters give is all."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF1, "documents").collect()]
    want = set()
    for i, t in rows:
        found, end = sorted(addresses(t) + numbers(t), key=lambda x: (x[0], -x[1])), 0
        for a, b, kind in found:
            if a >= end:
                want.add((i, kind, a, b))
                end = b
    got = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in queries.op7_pii(spark, SF1).collect()}
    assert got == want and {k for _, k, _, _ in got} >= {"email", "phone", "card", "ip"}


WORDS = "zero one two three four five six seven eight nine".split()
WIDE = {c: chr(ord(c) + 0xFEE0) for c in map(chr, range(33, 127))}


def disguised(rnd, kind):
    """(value, disguise) of a random identifier."""
    name = "".join(rnd.choices("bcdfgjkmnpqrvwxz", k=6))
    digits = lambda n: "".join(rnd.choices("123456789", k=n))
    if kind == "email":
        value = f"{name}.{digits(2)}@{name[::-1]}.example.org"
        at, dot = rnd.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), ("@", "."), ("​@", ".​")])
        return value, value.replace("@", at).replace(".", dot)
    if kind == "ip":
        value = ".".join(str(rnd.randint(10, 255)) for _ in range(4))
        return value, value.replace(".", rnd.choice([".", " dot ", "[.]"]))
    if kind == "phone":
        value = f"+1{digits(10)}"
        form = rnd.choice(["plain", "words", "wide"])
        body = f"+1 ({value[2:5]}) {value[5:8]}-{value[8:]}"
        return value, body if form == "plain" else "plus " + " ".join(WORDS[int(c)] for c in value[1:]) if form == "words" else "".join(WIDE.get(c, c) for c in body)
    stem = "4" + digits(14)
    value = next(stem + str(d) for d in range(10) if pii.luhn(stem + str(d)))
    form = rnd.choice(["plain", "groups", "words", "leet"])
    if form == "leet":
        return value, value.replace("1", "l", 2)
    return value, {"plain": value, "groups": " ".join(value[k : k + 4] for k in range(0, 16, 4)), "words": " ".join(WORDS[int(c)] for c in value)}[form]


def test_pii_planted_in_a_table(spark):
    rnd = random.Random(21)
    rows = [r["text"] for r in table(spark, SF, "documents").collect()]
    for t in rows:
        cut = rnd.choice([m.end() for m in re.finditer(r"[a-z]{3}[.,]? (?=[a-z]{3})", t)] or [0])
        kind = rnd.choice(["email", "ip", "phone", "card"])
        value, form = disguised(rnd, kind)
        new = t[:cut] + "; " + form + "; " + t[cut:]
        a = cut + 2
        found = pii.scan(new)
        assert (kind, a, a + len(form), value) in found, (kind, value, form, new[max(0, cut - 30) : cut + 90])
        rest = [(k, v, x if x < a else x - len(form) - 4) for k, x, _, v in found if x != a]
        assert rest == [(k, v, x) for k, x, _, v in pii.scan(t)]


@pytest.mark.parametrize("digits", ["2345678901234567", "4111111111111112", "0000000000000000"])
def test_numbers_without_check_digit_are_no_cards(digits):
    assert pii.scan(f"order {digits} came") == []


def test_letters_among_digits():
    assert pii.leet("1O2O3l4l") == [(1, 2, "0"), (3, 4, "0"), (5, 6, "1"), (7, 8, "1")] and pii.leet("Oh lO") == []
