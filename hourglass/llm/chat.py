"""Chat formatting with typed content parts, escapes, loss spans and read-back.

A conversation's rows are ordered by turn and each turn's content is a list
of typed parts (text, image, audio, document). A visitor flattens the parts
into one string: text is escaped, every other part becomes an ordered
placeholder, and its reference and expanded token count are recorded.

Template, for each turn: ``<|role|>``, a line feed, the content, ``<|end|>``,
a line feed. Control strings inside texts are broken by a backslash, and
backslashes are doubled, so that reading back is exact.

Defined cases: null text is empty text; null role is the empty role; rows of
one conversation order by (turn, role, text) with nulls first, so ties and
repeated rows have a fixed order and all stay; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are
ignored whatever their names. One conversation is one output row and one
training example, and is formatted by one task.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import map_batches

END = "<|end|>\n"
# Control strings, of this template and of common others, that
# must not appear in formatted text.
CONTROL_STRINGS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL_STRINGS))
_ROLE_ESCAPE = re.compile(r"[\\|<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_HEADER = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|file):[0-9]+\|>")

# Expanded tokens of one unit of each attachment kind: an image tile, a
# second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512, "file": 0}

PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:double>>"
FORMATTED = ("conv_id {conv}, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, "
             "attachments array<struct<position:long,kind:string,ref:string,tokens:long>>, expanded_tokens long")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _escape_role(role: str) -> str:
    return _ROLE_ESCAPE.sub(r"\\\g<0>", role)


class PartVisitor:
    """Flattens the parts of one conversation; one method per kind of part."""

    def __init__(self, tokens_per_unit: dict[str, int]):
        self.tokens_per_unit = tokens_per_unit
        self.attachments: list[dict] = []

    def visit(self, part: dict, at: int) -> str:
        kind = part.get("kind") or "text"
        return getattr(self, f"visit_{kind}", self.visit_file)(part, at)

    def visit_text(self, part: dict, at: int) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict, at: int) -> str:
        return self._attach("image", part, at)

    def visit_audio(self, part: dict, at: int) -> str:
        return self._attach("audio", part, at)

    def visit_document(self, part: dict, at: int) -> str:
        return self._attach("document", part, at)

    def visit_file(self, part: dict, at: int) -> str:
        return self._attach("file", part, at)

    def _attach(self, kind: str, part: dict, at: int) -> str:
        units = part.get("units")
        units = 1.0 if units is None or not math.isfinite(units) or units < 0 else units
        self.attachments.append({"position": at, "kind": kind, "ref": part.get("ref"),
                                 "tokens": math.ceil(units * self.tokens_per_unit[kind])})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_turns(turns: list[dict], train_roles: frozenset[str], tokens_per_unit: dict[str, int]) -> dict:
    """One conversation's string, loss spans (code points, end exclusive) and attachments."""
    visitor, pieces, spans, at = PartVisitor(tokens_per_unit), [], [], 0
    for turn in turns:
        role = turn["role"] or ""
        pieces.append(f"<|{_escape_role(role)}|>\n")
        at += len(pieces[-1])
        start = at
        for part in turn["parts"] or ():
            if part is not None:
                pieces.append(visitor.visit(part, at))
                at += len(pieces[-1])
        if role in train_roles:
            spans.append({"start": start, "end": at})
        pieces.append(END)
        at += len(END)
    return {"formatted": "".join(pieces), "loss_spans": spans, "attachments": visitor.attachments}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; placeholders are dropped."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        end = formatted.find(END, head.end())
        content = formatted[head.end():end]
        if "<|" in content:
            content = _PLACEHOLDER.sub("", content)
        out.append((unescape(head[1]), unescape(content)))
        at = end + len(END)
    return out


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None,
                         train_roles: tuple[str, ...] = ("assistant",),
                         tokens_per_unit: dict[str, int] | None = None) -> DataFrame:
    """One row per conversation: its formatted string, loss spans and attachments.

    ``parts`` names a column of type ``PART_TYPE``; without it each row's
    text is its one text part. Where a row's parts are null its text is used.
    """
    as_text = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                               F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))
    content = as_text.cast(PART_TYPE) if parts is None else F.coalesce(F.col(parts).cast(PART_TYPE), as_text.cast(PART_TYPE))
    grouped = (rows.select(F.col(conv).alias("conv_id"),
                           F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), content.alias("parts")).alias("t"))
               .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    costs = {**TOKENS_PER_UNIT, **(tokens_per_unit or {})}
    trained = frozenset(train_roles)

    def run(batch):
        done = [format_turns(t, trained, costs) for t in batch.column("turns").to_pylist()]
        return {"conv_id": batch.column("conv_id"),
                "n_turns": [len(t) for t in batch.column("turns")],
                **{k: [d[k] for d in done] for k in ("formatted", "loss_spans", "attachments")},
                "expanded_tokens": [sum(a["tokens"] for a in d["attachments"]) for d in done]}

    return map_batches(grouped, run, FORMATTED.format(conv=dict(grouped.dtypes)["conv_id"]))


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted strings and their loss spans."""
    ddl = (f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, "
           "loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")

    def run(batch):
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for s, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = parse_turns(s)
            loss = "".join(unescape(_PLACEHOLDER.sub("", s[x["start"]:x["end"]])) for x in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(_sha("".join(f"{r}\n{t}\n" for r, t in turns)))
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(_sha(loss))
            out["formatted_chars"].append(len(s))
        return {**out, "conv_id": batch.column("conv_id"), "expanded_tokens": batch.column("expanded_tokens"),
                "n_attachments": [len(a) for a in batch.column("attachments")]}

    return map_batches(formatted, run, ddl)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
