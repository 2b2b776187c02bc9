"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, plus signs, digits,
scheme marks (://), identifier cues (iban, ssn, account), cues of secrets (token,
password and the like) and the fixed beginnings of known keys. A deterministic
parser then expands each anchor in place and validates what it finds: e-mail
addresses to the left and right of an at-sign, dotted addresses, card numbers
(Luhn), phone numbers, URLs that carry a login, IBANs (length of the country,
mod 97; with or without a cue), social security and account numbers behind their
cue, and secrets: the value assigned to a cue, or a key by its beginning. Parsers
look at the text around an anchor only, so the work is linear in the text.

Kinds email, ip, card and phone give exactly the leftmost non-overlapping
matches of their patterns; a match that fails its test is dropped and not
retried. Kinds url, iban, ssn, account and secret are additions, each span once.

Defined results: a null text counts as empty (no spans); repeated rows give
repeated rows; an empty table gives none; other columns are ignored. Spans are
in code points, end exclusive, sorted by start, then kind as in KINDS.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account", "secret")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]*@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
BEFORE_IBAN = re.compile(r"[^\w\n]{1,5}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", re.I)
SSN = re.compile(r"[^A-Za-z0-9\n]{1,5}([0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id))?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I)
CUES = {"ssn": SSN, "account": ACCOUNT}
#: Characters of an IBAN by country (ISO 13616).
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key")
VALUE = re.compile(r"[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}(?:\"([^\"\s]{6,512})\"|'([^'\s]{6,512})'|([A-Za-z0-9_+/=.~-]{8,512}))")
#: Beginnings of keys that are known by them, and what follows.
KEYS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ASIA": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "AIza": re.compile(r"AIza[0-9A-Za-z_-]{35}"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}"),
    "gho_": re.compile(r"gho_[0-9A-Za-z]{36}"),
    "github_pat_": re.compile(r"github_pat_[0-9A-Za-z_]{22,}"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{10,}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{10,}"),
    "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,}"),
    "-----BEGIN ": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    "eyJ": re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) <= 3 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def iban_end(text: str, start: int) -> int | None:
    """Where the valid IBAN that starts there ends: single spaces within, no letter or digit behind."""
    m = IBAN.match(text, start)
    if not m:
        return None
    s = m[0]
    size, at, flat = IBAN_SIZES.get(s[:2].upper()), 0, ""
    while at < len(s) and (size is None or len(flat) < size):
        flat += "" if s[at] == " " else s[at]
        at += 1
    if size is not None and len(flat) < size or not flat.isascii() or start + at < len(text) and text[start + at].isalnum():
        return None
    return start + at if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else None


def secret_value(m: re.Match) -> tuple[int, int] | None:
    """The span of a value assigned to a cue. Without quotes it needs a digit and a letter, so prose is none."""
    k = next(g for g in (1, 2, 3) if m[g] is not None)
    if k == 3 and not (re.search("[0-9]", m[3]) and re.search("[A-Za-z]", m[3])):
        return None
    return m.span(k)


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "digit")
    a.add_word("@", "at")
    a.add_word("+", "plus")
    a.add_word("://", "scheme")
    for cue in ("iban", *CUES, *SECRET_CUES):
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, cue)
    for begin in KEYS:
        a.add_word(begin, begin)
    a.make_automaton()
    return a


def spans(text: str | None, auto) -> list[tuple[str, int, int]]:
    """All spans of a text in order."""
    if not text:
        return []
    out, more = [], set()
    after = dict.fromkeys(("email", "ip", "card", "phone"), 0)

    def take(kind: str, start: int, end: int) -> None:
        after[kind] = end
        if _valid(kind, text[start:end]):
            out.append((kind, start, end))

    for at, cue in auto.iter(text):
        if cue == "digit":
            if at >= after["ip"] and (at == 0 or at == after["ip"] or not "0" <= text[at - 1] <= "9") and (m := IP.match(text, at)):
                take("ip", at, m.end())
            if at >= after["card"] and (m := CARD.match(text, at)):
                take("card", at, m.end())
            if at >= 2 and text[at - 2 : at] in IBAN_SIZES and not (at > 2 and text[at - 3].isalnum()) and (end := iban_end(text, at - 2)):
                more.add(("iban", at - 2, end))
        elif cue == "at":
            start = at
            while start > after["email"] and LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                take("email", start, m.end())
        elif cue == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end())
        elif cue == "scheme":
            start = at - 2
            while start > 0 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at - 2 and (m := LOGIN.match(text, at - 2)):
                more.add(("url", start, m.end()))
        elif at < len(cue) or not text[at - len(cue)].isalnum():
            if cue in KEYS:
                if m := KEYS[cue].match(text, at - len(cue) + 1):
                    more.add(("secret", *m.span()))
            elif cue == "iban":
                if (m := BEFORE_IBAN.match(text, at + 1)) and (end := iban_end(text, m.end())):
                    more.add(("iban", m.end(), end))
            elif cue in CUES:
                if m := CUES[cue].match(text, at + 1):
                    more.add((cue, *m.span(1)))
            elif (m := VALUE.match(text, at + 1)) and (span := secret_value(m)):
                more.add(("secret", *span))
    out += more
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): one row per input row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        auto = automaton()
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py(), auto)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, item)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span replaced by [KIND]; overlapping spans become one."""
    place = docs.columns.index(text_col)

    def run(batches):
        auto = automaton()
        for b in batches:
            texts = []
            for t in b.column(place).to_pylist():
                parts, last = [], 0
                for kind, start, end in spans(t, auto):
                    if start >= last:
                        parts += [t[last:start], f"[{kind.upper()}]"]
                    last = max(last, end)
                texts.append(t if t is None else "".join(parts) + t[last:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
