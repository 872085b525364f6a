"""Substring dedup over prefix-partitioned suffix trees of word windows.

A window is ``WIDTH`` consecutive words of one document; a word goes when it
is covered by a window whose words also start in a document with a smaller
id. Suffixes are the windows' starts; two windows are equal when their
suffixes share a tree node at depth ``WIDTH``.

1. Equal texts are one text: the copies with larger ids lose whatever the
   smallest keeps or loses (all words, given a window), so only the smallest
   takes part.
2. Prefixes. Each window is filed under its anchor: of the short runs of
   ``PREFIX`` words inside it the leftmost with the smallest hash. Equal
   windows have the same anchor at the same place, and neighbouring windows
   share anchors, so about two in forty words are anchors. Anchor words that
   one document alone holds cannot start a shared node and go.
3. Suffix groups. The windows of one anchor prefix form a group of bounded
   size, counted in places, not in documents; a task sorts the suffixes of
   its groups by prefix doubling and takes the longest common prefixes of
   neighbours, which is their suffix tree. An internal node ``WIDTH`` words
   deep or deeper is a repeat; its smallest document marks the leaves of the
   others, and runs of marked places are the maximal repeats. A prefix with
   more than ``GROUP_ANCHORS`` places is lengthened instead, twice: a window
   holds its anchor anywhere, so the prefix grows on both sides. First to all
   the windows of an anchor together (a unit, about twenty windows): where a
   smaller document holds the same unit all of them are covered. Then, for
   the first holder of each unit alone, to the single window. (A window in a
   smaller document lies in a unit whose first holder is smaller still, so
   first holders are enough.) Such a long prefix is a leaf's whole path: only
   the smallest id of equal ones is needed, a minimum that combines on the
   map side.
4. The covered ranges of every document are merged and cut out of its text.

Words are compared by 32-bit hashes, fifty in a row inside a group of equal
anchors, and by 64-bit hashes of whole windows in lengthened groups.

Defined cases: words are runs without ASCII white space; null, empty and
white-space texts have no words; texts shorter than a window lose nothing;
very long texts are scanned whole, and a phrase that one repeats is counted in
places, so it lengthens its prefix; ties in the order of suffixes do not occur;
rows with equal ids do not act on each other, repeated rows get equal
results; a row with a null id stays whole and acts on none; an empty table
gives no rows; other columns are ignored by ``repeated_ranges`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, slices_of, texts_of, to_batch
from hourglass.llm.kernels import hash_texts, slices, windows

WIDTH = 50
PREFIX = 10
GROUP_ANCHORS = 200
_SPACE = " \t\n\r\x0b\x0c"


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


# --- anchors of windows ----------------------------------------------------------------


def window_anchors(prefixes: np.ndarray, n_windows: int, reach: int) -> np.ndarray:
    """For each window the place of its anchor: the leftmost smallest of ``reach`` prefixes from its start on."""
    place, size = np.arange(len(prefixes)), 1
    while size * 2 <= reach:
        left, right = place[:-size], place[size:]
        place = np.where(prefixes[left] <= prefixes[right], left, right)
        size *= 2
    left, right = place[:n_windows], place[reach - size:reach - size + n_windows]
    return np.where(prefixes[left] <= prefixes[right], left, right)


def anchor_runs(words: np.ndarray, width: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: (prefix hash, place, first window, end of windows) of every anchor, windows in order."""
    n = len(words) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    prefixes = windows(words, prefix)
    at = window_anchors(prefixes, n, width - prefix + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    place = at[first]
    return prefixes[place], place, first, np.r_[first[1:], n]


def scan_texts(docs: DataFrame, id_col: str, text_col: str, width: int, prefix: int) -> DataFrame:
    """(doc_id, same, tag, n_words, whole_sha256, anchors, places) of every row.

    ``same`` is the digest of the text, ``tag`` its first 8 bytes as a number,
    ``places`` how often each anchor prefix is an anchor of the text.
    """
    ddl = (f"doc_id {dict(docs.dtypes)[id_col]}, same binary, tag long, n_words long, whole_sha256 string, "
           "anchors array<long>, places array<int>")

    def run(batch):
        out = {k: [] for k in ("same", "tag", "n_words", "whole_sha256", "anchors", "places")}
        texts = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch, text_col)]
        for a, b in slices([len(t) for t in texts]):
            words, first = hash_texts(texts[a:b])
            for text, i, j in zip(texts[a:b], first[:-1].tolist(), first[1:].tolist()):
                digest = hashlib.sha256(text).digest()
                out["same"].append(digest)
                out["tag"].append(int.from_bytes(digest[:8], "little", signed=True))
                out["n_words"].append(j - i)
                out["whole_sha256"].append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                anchors, places = np.unique(anchor_runs(words[i:j], width, prefix)[0], return_counts=True)
                out["anchors"].append(anchors.view(np.int64))
                out["places"].append(places.astype(np.int32))
        return {"doc_id": batch.column(id_col), **out}

    return map_batches(docs.select(id_col, text_col), run, ddl)


# --- suffix groups -----------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places in the order of their suffixes, ranks of the runs of 1, 2, 4, ... symbols at every place).

    Prefix doubling, exact. The last symbol must occur once, as must one
    between any two texts: then no two suffixes are equal.
    """
    n = len(symbols)
    levels, size, key = [], 1, symbols
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        levels.append(rank)
        if n == 0 or rank[order[-1]] == n - 1:
            return order, levels
        ahead = np.zeros(n, np.int64)
        ahead[:-size] = rank[size:] + 1
        key, size = rank * (n + 1) + ahead, size * 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The longest common prefix of each suffix with the next one of ``order``, in symbols."""
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        ranks, size = levels[level], 1 << level
        # Equal runs hold no separator, so a place never leaves the array.
        step = np.where(ranks[left] == ranks[right], size, 0)
        left, right = left + step, right + step
    return left - order[:-1]


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The topmost internal nodes of at least ``depth`` symbols, as [first, end) of leaves in suffix order."""
    edge = np.flatnonzero(np.diff(np.r_[False, common >= depth, False].astype(np.int8)))
    return edge[::2], edge[1::2] + 1


def shared_suffixes(words: list[np.ndarray], n_windows: np.ndarray, doc: np.ndarray, width: int,
                    group: np.ndarray | None = None) -> list[np.ndarray]:
    """For each context the flags of its windows that also start in a smaller document of the group.

    The contexts lie end to end, each closed by a symbol of its own; words of
    different groups are different symbols. Sorted suffixes and their longest
    common prefixes are the groups' suffix trees: an internal node ``width``
    words deep or deeper is a repeat, its leaves are the places where it
    starts, and its smallest document marks the leaves of the others. The runs
    of marked places are the maximal repeats.
    """
    sizes = np.array([len(w) for w in words]) + 1
    begin = np.cumsum(sizes) - sizes
    group = np.zeros(len(words), np.uint64) if group is None else group.astype(np.uint64)
    flat = np.zeros(int(sizes.sum()), np.uint64)
    closing = begin + sizes - 1
    inside = np.ones(len(flat), bool)
    inside[closing] = False
    flat[inside] = np.concatenate(words).astype(np.uint64) | (np.repeat(group, sizes - 1) << np.uint64(32))
    symbols = np.zeros(len(flat), np.int64)
    symbols[inside] = np.unique(flat[inside], return_inverse=True)[1]
    symbols[closing] = len(flat) + np.arange(len(words))
    order, levels = suffix_order(symbols)
    # Leaves: the suffixes that start a window.
    context = np.repeat(np.arange(len(words)), sizes)
    leaf = np.arange(len(flat)) - begin[context] < n_windows[context]
    order = order[leaf[order]]
    first, end = deep_nodes(common_prefixes(order, levels), width)
    marked = np.zeros(len(flat), bool)
    if len(first):
        owner = doc[context[order]]
        node = np.repeat(np.arange(len(first)), end - first)
        below = np.arange(int((end - first).sum())) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + first[node]
        smallest = np.minimum.reduceat(owner[below], np.cumsum(end - first) - (end - first))
        marked[order[below]] = smallest[node] < owner[below]
    return [marked[b:b + n] for b, n in zip(begin.tolist(), n_windows.tolist())]


def _ranges(flags: np.ndarray, lo: int) -> list[tuple[int, int]]:
    """Runs of set flags as [start, end), moved by ``lo``."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))) + lo
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _group_contexts(members: DataFrame, width: int, spread: int) -> DataFrame:
    """(doc_id, tag, lo, hi): window ranges marked inside suffix groups.

    A task gets whole groups, sorted by prefix, and builds the trees of a
    bounded number of contexts at a time.
    """
    target = arrow_schema("doc_id long, tag long, lo long, hi long")
    dealt = members.repartition(spread, "prefix").sortWithinPartitions("prefix")

    def solve(rows: list[dict]) -> pa.RecordBatch:
        words = [np.frombuffer(r["words"], np.uint32) for r in rows]
        n = np.array([len(w) - width + 1 for w in words])
        # Words of different prefixes never meet.
        group = np.unique([r["prefix"] for r in rows], return_inverse=True)[1]
        flags = shared_suffixes(words, n, np.array([r["doc_id"] for r in rows], np.int64), width, group)
        out = [(r["doc_id"], r["tag"], s, e) for r, f in zip(rows, flags) for s, e in _ranges(f, r["lo"])]
        return to_batch(dict(zip(target.names, zip(*out) if out else ([], [], [], []))), target)

    def run(batches):
        held: list[dict] = []
        for part in (s for batch in batches for s in slices_of(batch)):
            held += part.to_pylist()
            if len(held) > 20 * GROUP_ANCHORS:
                last = held[-1]["prefix"]
                cut = next(i for i in range(len(held) - 1, -2, -1) if i < 0 or held[i]["prefix"] != last) + 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, "doc_id long, tag long, lo long, hi long")


def repeated_ranges(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    prefix: int = PREFIX, group_anchors: int = GROUP_ANCHORS) -> tuple[DataFrame, DataFrame]:
    """The scanned rows with ``is_copy``, and (doc_id, tag, ranges) of the texts that lose words.

    ``ranges``: merged [start, end) of words, for the smallest id of each text.
    """
    spark = docs.sparkSession
    scanned = scratch.put(scan_texts(docs, id_col, text_col, width, prefix), "scanned")
    smallest = scanned.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    rows = scratch.put(scanned.drop("anchors", "places").join(smallest.select("same", "doc_id", F.lit(False).alias("copy")), ["same", "doc_id"], "left")
                       .withColumn("is_copy", F.coalesce("copy", F.col("doc_id").isNotNull())).drop("copy"), "rows")
    firsts = scanned.filter(F.size("anchors") > 0).join(smallest.select("same", "doc_id"), ["same", "doc_id"], "left_semi")
    filed = (firsts.select("doc_id", "tag", F.explode(F.arrays_zip("anchors", "places")).alias("a"))
             .select("doc_id", "tag", F.col("a.anchors").alias("prefix"), F.col("a.places").alias("places")).distinct())
    live = filed.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("places").alias("places")).filter("lo < hi")
    wanted = scratch.put(filed.drop("places").join(live.select("prefix", (F.col("places") > group_anchors).alias("long")), "prefix")
                         .groupBy("doc_id", "tag").agg(F.collect_list(F.struct("prefix", "long")).alias("prefixes")), "wanted")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_col).filter(F.col(id_col).isNotNull()).select(
        "doc_id", F.coalesce(text_col, F.lit("")).alias("text"))
    ddl = "doc_id long, tag long, lo long, hi long, prefix long, words binary, unit long, windows array<long>"

    def contexts(batch):
        """Contexts of live anchors, and the units of lengthened prefixes (a unit that repeats in a row,
        as in a text of one repeated phrase, is one row)."""
        out = {k: [] for k in ("row", "lo", "hi", "prefix", "words", "unit", "windows")}
        wanted = batch.column("prefixes").to_pylist()
        tags = batch.column("tag").to_pylist()
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            words, first = hash_texts(texts[a:b])
            for row, i, j in zip(range(a, b), first[:-1].tolist(), first[1:].tolist()):
                if int.from_bytes(hashlib.sha256(texts[row]).digest()[:8], "little", signed=True) != tags[row]:
                    continue                          # another text under the same id
                own = words[i:j]
                key, _, lo, hi = anchor_runs(own, width, prefix)
                kind = {p["prefix"]: p["long"] for p in wanted[row]}
                short = own.astype(np.uint32)
                whole = windows(own, width) if any(kind.values()) else None
                for k, s, e in zip(key.view(np.int64).tolist(), lo.tolist(), hi.tolist()):
                    long = kind.get(k)
                    if long is None:
                        continue
                    if not long:
                        found = (row, s, e, k, short[s:e + width - 1].tobytes(), None, None)
                    else:
                        run = whole[s:e].view(np.int64)
                        unit = int.from_bytes(hashlib.blake2b(run.tobytes(), digest_size=8).digest(), "little", signed=True)
                        if out["row"] and (out["row"][-1], out["hi"][-1], out["unit"][-1]) == (row, s, unit):
                            out["hi"][-1] = e
                            continue
                        found = (row, s, e, None, None, unit, run)
                    for name, v in zip(out, found):
                        out[name].append(v)
        index = pa.array(out.pop("row"), pa.int64())
        return {"doc_id": batch.column("doc_id").take(index), "tag": batch.column("tag").take(index), **out}

    found = scratch.put(map_batches(wanted.join(texts, "doc_id").select("doc_id", "tag", "prefixes", "text"), contexts, ddl), "contexts")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = _group_contexts(found.filter("words is not null").select("prefix", "doc_id", "tag", "lo", "words"), width, spread)
    units = found.filter("unit is not null")
    holders = units.groupBy("unit").agg(F.min("doc_id").alias("least"))
    held = scratch.put(units.select("doc_id", "tag", "lo", "hi", "unit", "windows").join(holders, "unit"), "units")
    marked_2 = held.filter(F.col("least") < F.col("doc_id")).select("doc_id", "tag", "lo", "hi")
    # Windows of first holders. A window of a unit that repeats in a row comes
    # back every size-of-the-unit words; as that is less than a window, the
    # words it covers are those from its first to its last place.
    period = F.size("windows").cast("long")
    first = F.col("lo") + F.col("nth")
    firsts = (held.filter(F.col("least") == F.col("doc_id"))
              .select("doc_id", "tag", "lo", "hi", "windows", F.posexplode("windows").alias("nth", "window"))
              .select("doc_id", "tag", "window", first.alias("lo"),
                      (first + period * F.floor((F.col("hi") - 1 - first) / period) + 1).alias("hi")))
    least = firsts.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    marked_3 = firsts.join(least, "window").filter(F.col("least") < F.col("doc_id")).select("doc_id", "tag", "lo", "hi")
    ranges = (marked.unionByName(marked_2).unionByName(marked_3)
              .groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("lo", (F.col("hi") + width - 1).alias("end")))).alias("marks")))
    return rows, scratch.put(ranges, "ranges")


def cut_words(text: str, marks: list[dict]) -> tuple[int, bytes]:
    """(words removed, the kept words joined by one space)."""
    words = split_words(text)
    gone = np.zeros(len(words) + 1, np.int64)
    for m in marks:
        gone[m["lo"]] += 1
        gone[m["end"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _cut(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """(doc_id, tag, n_removed, kept_sha256[, kept]) of the texts that lose words."""
    ddl = "doc_id long, tag long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batch):
        out = {k: [] for k in ("row", "n_removed", "kept_sha256", "kept")}
        marks, tags = batch.column("marks").to_pylist(), batch.column("tag").to_pylist()
        for row, text in enumerate(batch.column("text").to_pylist()):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            if int.from_bytes(digest[:8], "little", signed=True) == tags[row]:
                n, kept = cut_words(text, marks[row])
                for name, v in (("row", row), ("n_removed", n), ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                                ("kept", kept.decode("utf-8", "surrogatepass") if with_text else None)):
                    out[name].append(v)
        index = pa.array(out.pop("row"), pa.int64())
        return {"doc_id": batch.column("doc_id").take(index), "tag": batch.column("tag").take(index), **out}

    return map_batches(ranges.join(texts, "doc_id").select("doc_id", "tag", "marks", "text"), run, ddl).dropDuplicates(["doc_id", "tag"])


def digest_kept(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``."""
    rows, ranges = repeated_ranges(docs, scratch, id_col, text_col, width, group_anchors=group_anchors)
    cut = _cut(docs, ranges, id_col, text_col, with_text=False)
    copy = F.col("is_copy") & (F.col("n_words") >= width)
    return (rows.join(cut, ["doc_id", "tag"], "left")
            .select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256")))


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   chars_col: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """The rows with repeats cut out of their texts; rows that lose all their words go.

    Texts that lose nothing stay as they are; ``chars_col``, if the table has
    it, is set to the new length where a text changes.
    """
    rows, ranges = repeated_ranges(docs, scratch, id_col, text_col, width)
    cut = scratch.put(_cut(docs, ranges, id_col, text_col, with_text=True).select("doc_id", "tag", "kept"), "cut")
    lost = rows.filter(F.col("is_copy") & (F.col("n_words") >= width)).select("doc_id", "tag", F.lit("").alias("kept"))
    changed = cut.unionByName(lost).dropDuplicates(["doc_id", "tag"]).select("doc_id", _tag_hex(F.col("tag")).alias("digest"), "kept")
    # The table's own columns travel in a struct, so that none of their names can clash.
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 16).alias("digest"))
    own = F.col("row").getField
    joined = (tagged.withColumn("doc_id", own(id_col)).join(changed, ["doc_id", "digest"], "left")
              .filter(F.col("kept").isNull() | (F.col("kept") != "")))
    values = {c: own(c) for c in docs.columns}
    values[text_col] = F.coalesce("kept", values[text_col])
    if chars_col in values:
        values[chars_col] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(own(chars_col)).cast(docs.schema[chars_col].dataType)
    return joined.select(*[v.alias(c) for c, v in values.items()])


def _tag_hex(tag):
    """The 16 hex digits of the digest whose little-endian number is ``tag``."""
    digits = F.lpad(F.lower(F.hex(tag)), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
