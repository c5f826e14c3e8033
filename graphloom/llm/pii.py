"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

The base kinds are email, ip, card and phone; each is matched leftmost and without overlap, and a match that its check
refuses is dropped. The method adds iban (mod-97), ssn (numbers that are never given out are refused) and secret spans (keys
and tokens: long runs of letters and digits mixed). Scores start from the kind's prior, rise for a passed check and for
context words close by, and fall for words that speak against the kind. Base spans stay whatever their score; an added span
needs ADDED_SCORE, so an iban stays unless the words around it speak against it alone, and an ssn or a secret is one only
where the words around it say so.

Defined cases: a null text is empty and has no spans; spans are code point offsets, end exclusive; repeated rows give
repeated results; an empty table gives no rows; other columns pass through redact() and are ignored by the query.
Each scan takes time linear in the text, also on long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,512}+(?![A-Za-z0-9_-])")
ADDED = ("iban", "ssn", "secret")
#: Context words for and against a kind, looked for within WINDOW code points before and after a span.
CONTEXT = {
    "email": (("mail", "contact", "write", "kontakt", "correo", "courriel"), ()),
    "ip": (("ip", "host", "server", "address", "adresse"), ("version", "release", "section")),
    "card": (("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"), ("isbn", "order", "serial")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"), ("isbn", "version")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta"), ("serial", "version", "sample", "part", "model")),
    "ssn": (("ssn", "social", "security", "taxpayer", "tin"), ("part", "model", "isbn", "serial", "order")),
    "secret": (("token", "secret", "password", "passwd", "key", "apikey", "api_key", "access_token", "bearer", "credential", "credentials", "passwort", "contraseña"), ("sha1", "sha256", "md5", "checksum", "digest", "commit", "hash")),
}
WINDOW = 48
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "secret": 0.3}
#: What a passed check adds, and context for and against a kind.
CHECKED = {"ip": 0.4, "card": 0.4, "iban": 0.4, "ssn": 0.2, "secret": 0.2}
NEAR, AGAINST = 0.2, 0.25
ADDED_SCORE = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN without its blanks has the remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain: of each @ the local part is the whole run before it, back to the last match."""
    at, free, last = text.find("@"), 0, 0
    while at >= 0:
        start = at - 0
        run = text[max(free, last) : at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        last = at + 1
        at = text.find("@", max(last, free))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind in the order of KINDS."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def mixed(run: str) -> bool:
    """Whether a run is like a key: letters and digits, and not the same few over and over."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and len(set(run)) >= 8


def score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    """checked: whether the kind's check, where it has one, was passed."""
    around = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    words = set(re.findall(r"\w+", around))
    good, bad = CONTEXT[kind]
    value = PRIOR[kind] + checked * CHECKED.get(kind, 0.0) + NEAR * (not words.isdisjoint(good)) - AGAINST * (not words.isdisjoint(bad))
    return min(1.0, max(0.0, value))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places of IBANs with a right checksum. Blanks let the pattern run on into the next words: the longest prefix that passes is taken, and the search goes on behind it, or one character on."""
    m = IBAN.search(text)
    while m:
        on = m.start() + 1
        for e in (e for e in range(m.end(), m.start() + 14, -1) if e == m.end() or not text[e].isalnum()):
            code = re.sub(r"[\x20-]", "", text[m.start() : e])
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), e
                on = e
                break
        m = IBAN.search(text, on)


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """All spans with scores: the base ones, and the added ones that their context does not rule out."""
    out = [(a, b, k, score(text, a, b, k, True)) for a, b, k in base_spans(text)]
    found = [(a, b, "iban") for a, b in ibans(text)] + [(*m.span(), "ssn") for m in SSN.finditer(text)] + [(*m.span(), "secret") for m in SECRET.finditer(text) if mixed(m[0])]
    out += [(a, b, k, s) for a, b, k in found if (s := score(text, a, b, k, True)) >= ADDED_SCORE - 1e-9]
    order = {k: n for n, k in enumerate((*KINDS, *ADDED))}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def redacted(text: str) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap become one, under the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind, _ in spans(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def listed(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in found)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score."""
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = spans(text)
                base = [s for s in found if s[2] in KINDS]
                rows.append((*[sum(s[2] == k for s in base) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), max((s[3] for s in found), default=0.0)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double")


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; a null text stays null; all other columns stay. n_chars, where there is one, follows the text."""
    common.arrow_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else redacted(t) for v in batch.column("text")]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if (old := n.as_py()) is None else old if t is None else len(t) for t, n in zip(texts, batch.column("n_chars"), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
