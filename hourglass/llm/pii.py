"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card, phone (the base kinds) and iban. Within a kind the
spans are leftmost and do not overlap; a match that fails its validator (ip
parts over 255, Luhn, digit counts, mod-97) is dropped without a retry.
Offsets are code points, end exclusive. Every pattern runs in time linear in
the text: runs are entered at their first character only.

Defined cases: null and empty texts have no spans; rows are independent, so
repeated rows give repeated results; a null id stays null; other columns are
ignored by ``find_pii`` and kept by ``redact_pii``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from hourglass.llm.common import map_batches, texts_of

# The order of kinds, and the patterns by kind.
KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")

# Score of a confirmed span, and what nearby words add to it or take from it.
BASE_SCORE = {"email": 0.85, "ip": 0.55, "card": 0.75, "phone": 0.6, "iban": 0.9}
CONTEXT_CHARS = 40
FOR_WORDS = {"email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server", "login"),
             "card": ("card", "visa", "credit", "payment", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax"),
             "iban": ("iban", "bank", "account", "transfer")}
AGAINST_WORDS = {"email": ("example", "noreply"), "ip": ("version", "section", "release"),
                 "card": ("isbn", "order", "serial", "tracking"), "phone": ("version", "total"), "iban": ("serial",)}
CONTEXT_STEP = 0.15
_WORD = re.compile(r"[a-z]+")

SPANS_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    moved = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    done = seen = 0
    for m in EMAIL_TAIL.finditer(text):
        at = m.start()
        # The local part is the run of its characters before this "@", back to
        # the last "@" or the last span.
        low = max(done, text.rfind("@", seen, at) + 1)
        seen = at
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL_CHARS))
        if start < at:
            done = m.end()
            yield start, done


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Confirmed spans of one text as (start, kind index, end), in that order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out += [(m.start(), 4, m.end()) for m in IBAN.finditer(text) if mod97(m[0])]
    out.sort()
    return out


def score_span(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    words = set(_WORD.findall(near.lower()))
    score = BASE_SCORE[kind] + CONTEXT_STEP * (any(w in words for w in FOR_WORDS[kind])
                                               - 2 * any(w in words for w in AGAINST_WORDS[kind]))
    return round(min(1.0, max(0.0, score)), 4)


def redact(text: str, threshold: float = 0.0) -> str:
    """The text with every span that scores at least the threshold replaced by its kind.

    Overlapping spans are replaced together, under the first one's kind.
    """
    out, done, open_end = [], 0, 0
    for start, k, end in find_spans(text):
        if score_span(text, start, end, KINDS[k]) < threshold:
            continue
        if start >= open_end:
            out += [text[done:start], f"[{KINDS[k].upper()}]"]
        done = open_end = max(open_end, end)
    return "".join(out) + text[done:] if out else text


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, spans), spans by start, then kind."""
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, spans {SPANS_TYPE}"

    def run(batch):
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": score_span(t, s, e, KINDS[k])}
                  for s, k, e in find_spans(t)] for t in texts_of(batch, text_col)]
        return {id_col: batch.column(id_col), "spans": spans}

    return map_batches(docs.select(id_col, text_col), run, ddl)


def redact_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.0, chars_col: str | None = None) -> DataFrame:
    """The same rows and columns, texts redacted; null texts stay null.

    ``threshold``: spans that score less stay in the text; by default every
    confirmed span is replaced, whatever stands near it.
    ``chars_col``, if given, is set to the new length where a text changes.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch):
        cols = {n: batch.column(n) for n in batch.schema.names}
        old = cols[text_col].to_pylist()
        new = cols[text_col] = [t if t is None else redact(t, threshold) for t in old]
        if chars_col:
            cols[chars_col] = [c if a is b or a == b else len(b) for a, b, c in zip(old, new, cols[chars_col].to_pylist())]
        return cols

    return map_batches(docs, run, ddl)


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as a string."""
    base = KINDS[:4]
    ddl = (f"{id_col} {dict(found.dtypes)[id_col]}, " + ", ".join(f"n_{k} long" for k in base)
           + ", base_sha256 string, spans string, n_iban long, min_score double")

    def run(batch):
        rows = batch.column("spans").to_pylist()
        name = lambda x: f"{x['kind']}:{x['start']}:{x['end']}"
        out = {f"n_{k}": [sum(x["kind"] == k for x in r) for r in rows] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(",".join(name(x) for x in r if x["kind"] in base).encode()).hexdigest()
                              for r in rows]
        out["spans"] = [",".join(map(name, r)) for r in rows]
        out["min_score"] = [min((x["score"] for x in r), default=None) for r in rows]
        return {**out, id_col: batch.column(id_col)}

    return map_batches(found, run, ddl)
