"""Personal data: patterns propose, validators confirm, context adjusts.

1. Regular expressions propose spans by kind.
2. Validators confirm them: ranges of address parts, Luhn for cards, mod 97
   for bank accounts (IBAN), digit counts.  A confirmed span has its kind's
   base score.
3. Words near a span (``CONTEXT_WIDTH`` characters either side) raise its
   score.  Spans of at least ``THRESHOLD`` are reported.

The base kinds (email, ip, card, phone) are reported whenever they are
confirmed.  ``iban`` is confirmed by its check digits; ``national_id`` has no
check digit, so only a context word lifts it over the threshold.

Scans are linear in the text: every pattern starts at a character that its
match must have (the ``@`` of an address, the start of a run of digits, a
``+``), and no start repeats another's work (an account's run is of bounded
size).

Defined results: null and empty texts have no spans; positions count code
points, ends exclusive; repeated rows and null ids are reported each; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import append, lists

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
BASE_SCORE = {"email": 1.0, "ip": 1.0, "card": 1.0, "phone": 1.0, "iban": 1.0, "national_id": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "national_id": ("ssn", "social security", "national id", "tax id", "passport"),
}
CONTEXT_BONUS, CONTEXT_WIDTH, THRESHOLD = 0.4, 40, 0.6
RESULT = "kind array<string>, start array<long>, end array<long>, score array<double>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits either starts a match or holds none, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
# A chain of digits is taken whole; shorter ones are no cards.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
#: Characters of an account by country.
_IBAN_SIZE = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 "
    "TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.I) for k, v in CONTEXT.items()}
_HAS_16 = re.compile(r"[0-9](?:[ -]?[0-9]){15}")
_LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += _LUHN[d] if i % 2 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """IBAN check: country and check digits moved to the end, letters as 10..35."""
    s = account.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            a = at
            while a > done and _LOCAL_END.match(text[a - 1]) is None:
                a -= 1
            if a < at:
                yield a, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def accounts(text: str):
    """Bank accounts.  Words of capitals or digits after an account belong to
    its run: the account ends at the word end that its country's size gives,
    or at the run's; without a known size at the last word end that confirms."""
    m = _IBAN.search(text)
    while m:
        run, at = m[0], m.start() + 1
        ends = [len(run), *(i for i in range(len(run) - 1, 0, -1) if run[i] == " ")]
        size = _IBAN_SIZE.get(run[:2])
        if size:
            ends = [e for e in ends if e - run.count(" ", 0, e) == size] + ends[:1]
        for e in ends:
            if mod97(run[:e]):
                yield m.start(), m.start() + e
                at = m.start() + e
                break
        m = _IBAN.search(text, at)


def proposals(text: str):
    """Confirmed spans (kind, start, end), by kind as listed, then start."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in accounts(text):
        yield "iban", a, b
    for m in _NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def scored(text: str | None) -> list[tuple[str, int, int, float]]:
    """Reported spans with their scores."""
    out = []
    for kind, a, b in proposals(text or ""):
        near = text[max(0, a - CONTEXT_WIDTH):a] + " " + text[b:b + CONTEXT_WIDTH]
        score = min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * (_CONTEXT[kind].search(near) is not None))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return out


def spans(docs: DataFrame, *, text_col: str = "text", name: str = "pii", drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct column ``name`` of parallel lists of spans."""

    def scan(batch: pa.RecordBatch) -> pa.Array:
        found = [scored(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
        n = np.array([len(x) for x in found], np.int64)
        flat = [s for x in found for s in x]
        return pa.StructArray.from_arrays(
            [lists(n, pa.array([s[i] for s in flat], t)) for i, t in
             enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["kind", "start", "end", "score"])

    kind = docs.sparkSession.createDataFrame([], RESULT).schema
    return append(docs, text_col, scan, kind, name, drop_text)


def masked(text: str | None) -> str | None:
    """The text with every reported span replaced by its kind."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in sorted(scored(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def _joined(keep):
    rows = F.arrays_zip("r.kind", "r.start", "r.end")
    rows = F.filter(rows, lambda s: s["kind"].isin(*BASE)) if keep else rows
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a hash of their spans, all spans."""
    r = spans(docs.select(id_col, "text"), name="r", drop_text=True)
    count = lambda k: F.size(F.filter("r.kind", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return r.select(F.col(id_col).alias("doc_id"), *[count(k) for k in BASE],
                    F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"))


def reference(doc, text: str | None) -> tuple:
    """Plain-pattern form of ``digest``'s base columns, for tests."""
    text = text or ""
    found = {k: [] for k in BASE}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(_digits(m[0])) <= 15:
            found["phone"].append(m.span())
    joined = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
    return (doc, *[len(found[k]) for k in BASE], hashlib.sha256(joined.encode()).hexdigest())
