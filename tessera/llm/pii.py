"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, sha256, spans_digest, text_or_empty

#: Kinds in their order of rank; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE, "iban", "ssn"))}
#: Score of a span before its context, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
#: Lower-case words that raise a kind's score when they stand whole within CONTEXT characters before or after a span.
WORDS = {
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
}
#: Lower-case words that lower it.
AGAINST = ("version", "example", "test", "isbn", "order", "build")
CONTEXT, STEP = 40, 0.15

_NEAR = {kind: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})(?![^\W\d_])") for kind, words in {**WORDS, "against": AGAINST}.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins at the start of a run of digits, as what follows the run decides; so no position inside a run is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(_DOUBLED[int(d)] for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, by their @ signs: each run before one is read once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


_DIGIT = re.compile("[0-9]")


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans past the base: account numbers that pass mod-97, and numbers of the form of social security numbers."""
    if not _DIGIT.search(text):
        return []
    spans = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            spans.append(("ssn", *m.span()))
    return spans


def scored(text: str, span: tuple[str, int, int]) -> float:
    """The kind's prior, raised or lowered once by the words near the span, from 0 to 1."""
    kind, start, end = span
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
    step = STEP * (bool(_NEAR[kind].search(near)) - bool(_NEAR["against"].search(near)))
    return round(min(1.0, max(0.0, PRIOR[kind] + step)), 2)


#: Least score of an added span; base spans stay whatever their score.
LEAST = 0.5


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with their scores) in order, in code points, end exclusive."""
    base = base_spans(text)
    rows = [(*s, scored(text, s)) for s in base] + [(*s, score) for s in added_spans(text) if (score := scored(text, s)) >= LEAST]
    return base, sorted(rows, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, the number of base spans of each kind, base_sha256, and found, all spans with kind, start, end, score.

    Base: e-mail and IP addresses, card numbers that pass Luhn, phone numbers. Added: IBANs that pass mod-97, social
    security numbers that words nearby support. A null text is empty and has no spans; base_sha256 is then that of no text.
    Repeated rows and null keys stay; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, found = [[] for _ in BASE], [], []
            for i in range(0, batch.num_rows, 256):
                for body in batch.column(1).slice(i, 256).to_pylist():
                    base, rows = find(body)
                    for kind, out in zip(BASE, numbers, strict=True):
                        out.append(sum(s[0] == kind for s in base))
                    digests.append(sha256(spans_digest(base, KINDS)))
                    found.append([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in rows])
            arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(digests, pa.string()), pa.array(found, _FOUND)]
            yield pa.RecordBatch.from_arrays(arrays, ["k", *(f"n_{k}" for k in BASE), "base_sha256", "found"])

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, {counts}, base_sha256 string, found array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("k", key)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the spans of their texts replaced by their kinds in angle brackets; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(body):
            if body is None:
                return None
            out, at = [], 0
            for kind, a, b, _ in find(body)[1]:
                if a >= at:
                    out += [body[at:a], f"<{kind}>"]
                    at = b
            return "".join([*out, body[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))


def joined_spans(found: str = "found"):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    return found.withColumn("spans", joined_spans()).withColumn("max_score", F.array_max(F.transform("found", lambda s: s["score"]))).drop("found")
