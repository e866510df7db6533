"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, scheme
separators and account cues. Deterministic parsers expand each anchor to its
full extent and validate it:

* at-sign: local part to the left, dotted domain to the right (email);
* digit: the run of digits, spaces and ``+().-`` around it is parsed for dotted
  quads (ip), card numbers (Luhn) and international phone numbers;
* ``://``: a ``user:password@`` part (login);
* cue words (account, IBAN and the like): the number that follows (account,
  iban with its check digits). An IBAN has its country's length, or
  fills its run of groups; for other countries it ends with the last group with
  which the check holds.

No match crosses the run it is parsed from, so parsing runs gives exactly the
leftmost non-overlapping matches of the whole text. A match that fails its
check is dropped and its characters are not tried again.

Edge cases: null and empty texts have no spans; repeated rows repeat; a null
doc_id stays null; other columns are ignored; work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
BASE = KINDS[:4]
NUMBER = {k: i for i, k in enumerate(KINDS)}

# Cue words in front of account numbers, in lower case.
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9 ().+-]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[A-Za-z0-9._~%!$&'*+,;=:-]+@")
_IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Lengths by country.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
_ACCOUNT = re.compile(r"(?:[ ](?:number|no\.?|nr\.?|num\.?|id))?[ ]?[:#=]{1,2}[ ]?([0-9](?:[ -]?[0-9]){5,17})", re.I)
#: Fewer characters hold neither a dotted quad, a card nor a phone number.
_LEAST_NUMERIC = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end_of(text: str, start: int, end: int) -> int | None:
    """Where the IBAN ends whose capitals, digits and spaces fill [start, end),
    with what follows it."""
    ends = [i + 1 for i in range(start, end) if text[i] != " "]
    size = IBAN_LENGTHS.get(text[start: start + 2])
    if size is not None and len(ends) >= size and not text[ends[size - 1]: ends[size - 1] + 1].isalnum() \
            and iban_valid(text[start: ends[size - 1]]):
        return ends[size - 1]
    if iban_valid(text[start: end]):
        return end
    if size is None:
        for stop in reversed(ends[14:]):
            if not text[stop: stop + 1].isalnum() and iban_valid(text[start: stop]):
                return stop
    return None


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, "digit")
    found.add_word("@", "at")
    found.add_word("://", "scheme")
    for cues, kind in ((IBAN_CUES, "iban"), (ACCOUNT_CUES, "account")):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def numeric_spans(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text, start, end):
        if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text, start, end):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text, start, end):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", *m.span()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text, in order."""
    spans = []
    numeric_end = email_end = login_end = 0
    iban_end = account_end = 0
    for last, kind in anchors().iter(text):
        if kind == "digit":
            if last < numeric_end:
                continue
            start = last - 1 if last and text[last - 1] == "+" else last
            numeric_end = _NUMERIC.match(text, start).end()
            if numeric_end - start >= _LEAST_NUMERIC:
                spans += [(a, NUMBER[k], b) for k, a, b in numeric_spans(text, start, numeric_end)]
        elif kind == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append((start, NUMBER["email"], email_end))
        elif kind == "scheme":
            if last + 1 >= login_end and (m := _USERINFO.match(text, last + 1)):
                login_end = m.end()
                spans.append((m.start(), NUMBER["login"], login_end - 1))
        elif kind == "iban":
            if last >= iban_end and (m := _IBAN.match(text, last + 1)) and (end := iban_end_of(text, *m.span(1))):
                iban_end = end
                spans.append((m.start(1), NUMBER["iban"], iban_end))
        elif last >= account_end and (m := _ACCOUNT.match(text, last + 1)):
            account_end = m.end()
            spans.append((m.start(1), NUMBER["account"], account_end))
    spans.sort()
    return spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def personal_spans(text: Column) -> Column:
    """Array of (start, kind, end) in code points, by start."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in find_spans(t or "")] for t in texts],
                         dtype=object)

    return find(text)


REPORT = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
                       T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def personal_report(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base findings, and all spans."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = find_spans(text or "")
            base = [s for s in spans if s[1] < len(BASE)]
            counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        return pd.DataFrame(rows, columns=REPORT.names)

    return docs.select("doc_id", report("text").alias("r")).select("doc_id", "r.*")
