"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from patterns: assign, access and hex (the base kinds) and
jwt and pem. Within a kind spans are leftmost and do not overlap; too short
matches are dropped without a retry. Offsets are code points, end exclusive.

Each candidate's value is hashed; over the whole corpus the hash is counted
by distinct owners and distinct repositories (an owner's collections). A
value that several owners hold is a copied example; a value that one owner
holds is live-looking. Duplicates (hash, owner, repository) are merged on
the map side first, so a value in a third of all rows costs one row per
task and owner.

Defined cases: null and empty texts have no spans; null owners and
repositories count as one owner and repository of their own; rows that
repeat an id share their verdicts' counts only within equal (id, text) rows;
a null id stays null; very long texts are one row each, whose work grows
with the length and the number of matches to the power 1.5; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch

# Kinds in order; the pattern, the group that holds the value,
# and its least length. The hex and access patterns carry their least length:
# their runs are maximal, so a shorter run has no longer match inside.
KINDS = ("assign", "access", "hex", "jwt", "pem")
PATTERNS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 0),
    "pem": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
}
BASE = KINDS[:3]
# A value of at least this many distinct owners is a copied example.
EXAMPLE_OWNERS = 3

SPAN_TYPE = "array<struct<start:long,kind_no:int,end:long,value_hash:string>>"


def _matches_of(text: Column, kind: str) -> Column:
    """(piece, match, value) of each match, ``piece`` the text between it and the one before."""
    pattern, group, _ = PATTERNS[kind]
    # -1 keeps the empty pieces at the end.
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.zip_with(matches, values, lambda m, v: F.struct(m.alias("match"), v.alias("value"))),
                        lambda p, mv: F.struct(p.alias("piece"), mv["match"].alias("match"), mv["value"].alias("value")))
    return F.when(text.rlike(pattern), zipped)


def _spans_of(found: Column, kind: str) -> Column:
    """The kind's spans: the pieces between matches and the matches, added up in order.

    Growing an array copies it, so the matches go in runs of about their square
    root: the runs' lengths add up to the places where they start, and each
    run grows spans of its own. The work is n^1.5 short copies for n matches.
    """
    least, no = PATTERNS[kind][2], KINDS.index(kind)
    empty, zero = F.array().cast(SPAN_TYPE), F.lit(0).cast("long")
    run = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(found))).cast("int"))
    firsts = F.sequence(F.lit(1), F.size(found), run)
    length = lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("long")
    lengths = F.transform(firsts, lambda at: F.aggregate(F.slice(found, at, run), zero, lambda acc, x: acc + length(x)))
    starts = F.aggregate(lengths, F.struct(zero.alias("at"), F.array().cast("array<long>").alias("all")),
                         lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
                         lambda acc: acc["all"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.cast("long").alias("start"), F.lit(no).alias("kind_no"), end.cast("long").alias("end"),
                        F.sha2(x["value"], 256).alias("value_hash"))
        spans = F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    runs = F.zip_with(firsts, starts, lambda at, start: F.aggregate(
        F.slice(found, at, run), F.struct(start.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"]))
    return F.when(F.size(found) > 0, F.flatten(runs)).otherwise(empty)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None) -> DataFrame:
    """(id, owner, repository, spans) of every whole text, spans by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.lit(None).cast("string") if owner is None else owner
    repository = F.lit(None).cast("string") if repository is None else repository
    matches = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"),
                          *[_matches_of(text, k).alias(f"m_{k}") for k in KINDS])
    found = matches.select("id", "owner", "repository", *[_spans_of(F.col(f"m_{k}"), k).alias(f"s_{k}") for k in KINDS])
    return found.select("id", "owner", "repository",
                        F.array_sort(F.concat(*[f"s_{k}" for k in KINDS])).alias("spans"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(value_hash, n_rows, n_owners, n_repositories) of every candidate value of the corpus."""
    held = (scanned.select("owner", "repository", F.explode("spans.value_hash").alias("value_hash"))
            .groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n")))
    by_owner = held.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"),
                                              F.sum("repositories").alias("n_repositories"))


def find_secrets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                 owner: Column | None = None, repository: Column | None = None,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(id, spans, verdicts): each distinct value of the row with its counts and whether it is an example.

    Rows without candidates take no part in the joins.
    """
    scanned = scratch.put(scan(docs, id_col, text_col, owner, repository), "scanned")
    values = (scanned.filter(F.size("spans") > 0)
              .select("id", F.explode(F.array_distinct(F.col("spans.value_hash"))).alias("value_hash")).distinct())
    verdict = F.struct("value_hash", "n_owners", "n_repositories", "n_rows",
                       (F.col("n_owners") >= example_owners).alias("example"))
    judged = scratch.put(values.join(ownership(scanned), "value_hash").select("id", verdict.alias("v")), "judged")
    per_row = judged.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("verdicts"))
    joined = scanned.alias("s").join(per_row.alias("r"), F.col("s.id").eqNullSafe(F.col("r.id")) & (F.size("s.spans") > 0), "left")
    none = F.array().cast(per_row.schema["verdicts"].dataType)
    return joined.select(F.col("s.id").alias(id_col), "s.spans",
                         F.filter(F.coalesce(F.col("r.verdicts"), none),
                                  lambda v: F.array_contains(F.col("s.spans.value_hash"), v["value_hash"])).alias("verdicts"))


def digest_secrets(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans, and the verdict counts."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind_no"] == KINDS.index(k))).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(joined(F.filter("spans", lambda x: x["kind_no"] < len(BASE))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("verdicts", lambda v: v["example"])).cast("long").alias("n_examples"),
                        F.size(F.filter("verdicts", lambda v: ~v["example"])).cast("long").alias("n_live"))
