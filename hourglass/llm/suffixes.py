"""Repeated byte strings by merging the sorted suffixes of shards, refined symbol by symbol.

Wanted are all windows of ``length`` bytes that also start anywhere else.

* Sparse suffixes. Every window files under its anchor, the leftmost smallest
  k-mer hash among its first ``offsets`` places; equal windows have equal
  offsets to their anchors, so only the suffixes that start at anchors are
  ordered. What stands before an anchor are its preceding symbols, as a
  Burrows-Wheeler transform keeps them; [first, last] are its windows.
* Suffixes whose first ``length - offsets + 1`` bytes occur once in the corpus
  drop out by counts. Anchors whose whole context (all bytes of their windows)
  is repeated are settled by counts too: all their windows are repeated. Only
  one context of each kind goes on, and only under a prefix with several kinds.
* Shards. Each batch of texts is a shard: its contexts are sorted by their
  bytes once, each with the common prefix to the one before.
* Merge. Runs of several shards under the same prefixes meet in a task. The
  interleave starts as one interval a prefix and is refined by one symbol (8
  bytes) an iteration: a stable split of every interval, which keeps each
  shard's own order. A new border has the common prefix of its depth. An
  interval of one suffix, or of one shard, needs no more iterations: the
  shard's own order and common prefixes hold there. No suffix is sorted again.
* Repeats. A window that starts j bytes before its anchor is repeated if the
  repeated interval of depth ``length - j`` holds another suffix with the same
  j preceding bytes; these are refined in the same way, from the anchor back.
* A prefix with more than ``MOST_KINDS`` kinds of contexts (a passage just too
  short to be a repeat in very many documents) is solved by counting the 128
  bit hashes of its windows, in plain aggregates: no task gets a whole group.

Defined cases: null and empty texts, and texts shorter than ``length``, keep
all their bytes; matches never cross texts; rows with the same id and text
are documents of their own, so each repeats the other, as are rows with null
ids; overlapping repeats of one text count; very long texts are read whole,
in slices; an empty table gives no rows; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, to_batch
from hourglass.llm.kernels import mix

SLICE = 1 << 20              # bytes worked on at once
CHUNK = 8192                 # contexts merged at once, whole prefixes
MOST_KINDS = 2000
_POSITION = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


class Shape:
    """The sizes that follow from the length of a window."""

    def __init__(self, length: int):
        if length < 4:
            raise ValueError("a window has at least 4 bytes")
        self.length = length
        self.offsets = min(256, length * 5 // 8)
        self.kmer = min(16, length - self.offsets + 1)
        self.prefix = length - self.offsets + 1
        self.right, self.left = -(-length // 8), -(-self.offsets // 8)      # symbols


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = (1 << bits) + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class Hashes:
    """Hashes of all substrings of a byte array, from sums of bytes times powers modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base, max(int(len(data)).bit_length(), 12))
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def pieces(texts: list[bytes], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, texts, offsets): runs of texts of about ``SLICE`` bytes; long texts in overlapping pieces."""
    held, size = [], 0

    def joined():
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        return (data, np.cumsum([0] + [len(t) for _, _, t in held]), np.array([i for i, _, _ in held]),
                np.array([at for _, at, _ in held]))

    for i, text in enumerate(texts):
        for at in range(0, len(text) - shape.length + 1, SLICE):
            part = text if len(text) <= SLICE else text[at:at + SLICE + shape.length - 1]
            if held and size + len(part) > SLICE:
                yield joined()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
            if len(text) <= SLICE:
                break
    if held:
        yield joined()


def anchors(data: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first, last, prefix hash, context hash) of a run of pieces; places in the run."""
    one, two = (Hashes(data, b) for b in _BASES)
    n = len(data) - shape.kmer + 1
    at = np.arange(n)
    least = (one.of(at, at + shape.kmer) & ~_POSITION) | at.astype(np.uint64)
    size = 1
    while 2 * size <= shape.offsets:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < shape.offsets:
        more = shape.offsets - size
        least = np.minimum(least[:-more], least[more:])
    windows = np.maximum(np.diff(starts) - shape.length + 1, 0)
    piece = np.repeat(np.arange(len(windows)), windows)
    p = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[piece]
    anchor = (least[p] & _POSITION).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    first, last = p[edge], p[np.r_[edge[1:], len(p)] - 1]
    anchor, piece = anchor[edge], piece[edge]
    prefix = one.of(anchor, anchor + shape.prefix)
    whole = two.of(first, last + shape.length)
    return piece, anchor, first, last, prefix, mix(whole ^ ((anchor - first) << 20 | (anchor - last)).astype(np.uint64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, data): ``row`` tells texts with one id apart; equal rows share it and their repeats."""
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("row"), text.cast("binary").alias("data"))


def sparse_suffixes(texts: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, row, prefix, context, anchor, first, last): the last five are arrays, an entry an anchor."""
    kind = "doc_id long, row long, prefix array<long>, context array<long>, anchor array<long>, first array<long>, last array<long>"

    def run(batch):
        data = batch.column("data").to_pylist()
        parts = [[] for _ in range(6)]
        for joined, starts, text, offset in pieces(data, shape):
            piece, *places, prefix, context = anchors(joined, starts, shape)
            base = offset[piece] - starts[piece]
            for out, x in zip(parts, (text[piece], prefix.view(np.int64), context.view(np.int64), *(x + base for x in places))):
                out.append(x)
        text, *columns = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
        cut = pa.array(np.r_[0, np.cumsum(np.bincount(text.astype(np.int64), minlength=len(data)))], pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(c)) for c in columns]
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), **dict(zip(("prefix", "context", "anchor", "first", "last"), lists))}

    return map_batches(texts.filter(F.length("data") >= shape.length), run, kind)


# --- runs of shards and their merge -----------------------------------------------


def symbols(rows: list[bytes], count: int) -> np.ndarray:
    """Rows of bytes as ``count`` big-endian 8-byte symbols, zeros after the end."""
    packed = b"".join(r[:8 * count].ljust(8 * count, b"\0") for r in rows)
    return np.frombuffer(packed, ">u8").reshape(len(rows), count).astype(np.uint64)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of unequal symbols."""
    differ = (x ^ y).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    return differ.argmax(axis=1)


def interleave(prefix: np.ndarray, shard: np.ndarray, words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of all shards in order, with the bytes each shares with the one before (-1: another prefix).

    The rows come by prefix, shard and the shard's own order; ``own`` is the common prefix with the shard's row before.
    """
    m = len(prefix)
    order = np.arange(m)
    common = np.full(m, 8 * words.shape[1], np.int64)
    interval = np.cumsum(np.r_[False, prefix[1:] != prefix[:-1]]) if m else order
    common[np.r_[True, interval[1:] != interval[:-1]][:m]] = -1
    active = order.copy()
    for depth in range(words.shape[1]):
        active, of = _unsettled(active, interval, order, shard, own, common, 8 * depth)
        if not len(active):
            return order, common
        held = order[active]
        symbol = words[held, depth]
        place = np.lexsort((symbol, of))                        # stable: a shard's rows keep their order
        held, symbol = held[place], symbol[place]
        order[active] = held
        border = np.flatnonzero((of[1:] == of[:-1]) & (symbol[1:] != symbol[:-1])) + 1
        common[active[border]] = 8 * depth + _common(symbol[border - 1], symbol[border])
        fresh = np.zeros(len(active), np.int64)
        fresh[border] = 1
        fresh[1:] |= of[1:] != of[:-1]
        interval[active] = np.cumsum(fresh)
    return order, common


def _unsettled(active, interval, order, shard, own, common, depth) -> tuple[np.ndarray, np.ndarray]:
    """Places in intervals of several shards, with their intervals; the rest get their shard's common prefixes."""
    of = interval[active]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(of)])
    held = shard[order[active]]
    mixed = np.zeros(len(of), np.int64)
    mixed[1:] = (of[1:] == of[:-1]) & (held[1:] != held[:-1])
    open_ = np.repeat(np.add.reduceat(mixed, start) > 0, size) if len(of) else np.zeros(0, bool)
    inner = np.ones(len(of), bool)
    inner[start] = False
    inner &= ~open_
    common[active[inner]] = own[order[active[inner]]]
    return active[open_], of[open_]


def sorted_run(rows: list[tuple], shape: Shape) -> dict:
    """A shard's contexts in order: (prefix, doc_id, row, n, anchor, first, last, context bytes) with places and common prefixes."""
    right = symbols([r[7][r[4] - r[5]:] for r in rows], shape.right)
    prefix = np.array([r[0] for r in rows], np.int64)
    order = np.lexsort((*right.T[::-1], prefix))
    right, prefix = right[order], prefix[order]
    differ = right[1:] != right[:-1]
    same = ~differ.any(axis=1)
    at = differ.argmax(axis=1)
    line = np.arange(len(at))
    own = np.where(same, 8 * shape.right, 8 * at + _common(right[line, at], right[line + 1, at]))
    own = np.r_[-1, np.where(prefix[1:] == prefix[:-1], own, -1)]
    names = ("prefix", "doc_id", "row", "n", "anchor", "first", "last", "bytes")
    return {**dict(zip(names, zip(*[rows[i] for i in order]))), "place": np.arange(len(order)), "common": own}


def solve(rows: dict, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): ranges of window starts repeated elsewhere, of rows that are alone with their context.

    ``rows``: columns of contexts by prefix, shard and place, whole prefixes.
    """
    prefix, shard, own, n, anchor, first, last = (rows[c] for c in ("prefix", "shard", "common", "n", "anchor", "first", "last"))
    m = len(prefix)
    before, behind = anchor - first, anchor - last
    right = symbols([b[x:] for b, x in zip(rows["bytes"], before)], shape.right)
    left = symbols([b[:x][::-1] for b, x in zip(rows["bytes"], before)], shape.left)
    order, common = interleave(prefix, shard, right, own)
    back, back_common = interleave(prefix, np.arange(m), left, np.full(m, -1))
    repeated = np.zeros((m, shape.offsets + 2), np.int8)
    right_id, left_id = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(int(behind.min()), int(before.max()) + 1):
        here = np.flatnonzero((behind <= j) & (j <= before))
        if len(here) < 2:
            continue
        right_id[order] = np.cumsum(common < shape.length - j)
        left_id[back] = np.cumsum(back_common < j)
        key = right_id[here] * (m + 1) + left_id[here]
        _, group = np.unique(key, return_inverse=True)
        total = np.bincount(group, n[here])
        repeated[here, j + 1] = (total[group] >= 2) & (n[here] == 1)
    edge = np.diff(repeated, axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, anchor[row] - (high - 1), anchor[row] - low


_CONTEXT = "prefix long, shard string, place int, common int, doc_id long, row long, n long, anchor long, first long, last long, bytes binary"


def contexts(texts: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """The wanted contexts with their bytes, as sorted runs, a run a batch of texts.

    wanted: (doc_id, row, prefix, anchor, first, last, n, hot); a hot one gives a row for each window instead (``place`` -1).
    """
    found = _with(texts, wanted.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("prefix", "anchor", "first", "last", "n", "hot")).alias("of")), "inner")

    def run(batch):
        rows, hot = [], []
        shard = uuid.uuid4().hex                               # a name only: nothing depends on it but equality inside a written table
        for data, doc, row, of in zip(*(batch.column(c).to_pylist() for c in ("data", "doc_id", "row", "of"))):
            for x in of:
                part = data[x["first"]:x["last"] + shape.length]
                (hot if x["hot"] else rows).append((x["prefix"], doc, row, x["n"], x["anchor"], x["first"], x["last"], part))
        out = {c: [] for c in target.names}
        if rows:
            run_ = sorted_run(rows, shape)
            for c in target.names:
                out[c] += [shard] * len(rows) if c == "shard" else list(run_[c])
        for prefix, doc, row, n, anchor, first, last, part in hot:
            array = np.frombuffer(part, np.uint8)
            start = np.arange(last - first + 1)
            one, two = (Hashes(array, b).of(start, start + shape.length) for b in _BASES)
            for c, x in zip(target.names, (one.view(np.int64), None, None, None, doc, row, n, None, start + first, start + first, [w.tobytes() for w in two])):
                out[c] += list(x) if isinstance(x, (np.ndarray, list)) else [x if x is not None or c == "doc_id" else {"shard": "", "place": -1, "common": 0, "anchor": 0}[c]] * len(start)
        return out

    target = arrow_schema(_CONTEXT)
    return map_batches(found.select("doc_id", "row", "data", "of"), run, _CONTEXT, rows=256)


def merge_runs(runs: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, row, first, last): the repeated windows of the contexts of several shards."""
    kind = "doc_id long, row long, first long, last long"
    target = arrow_schema(kind)
    numbers = ("prefix", "common", "n", "anchor", "first", "last")

    def solved(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        rows = {c: table.column(c).to_numpy() for c in numbers}
        names = table.column("shard").combine_chunks().dictionary_encode()
        rows |= {"shard": names.indices.to_numpy(zero_copy_only=False), "bytes": table.column("bytes").to_pylist()}
        row, low, high = solve(rows, shape)
        return to_batch({"doc_id": table.column("doc_id").take(pa.array(row)), "row": table.column("row").take(pa.array(row)),
                         "first": low, "last": high}, target)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
            start = 0
            for cut in np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]).tolist() if len(prefix) else ():
                if size + cut - start >= CHUNK and (cut or prefix[0] != held[-1].column("prefix")[-1].as_py()):
                    if cut > start:
                        held.append(batch.slice(start, cut - start))
                    yield solved(held)
                    held, size, start = [], 0, cut
            held.append(batch.slice(start))
            size += len(prefix) - start
        if size:
            yield solved(held)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (runs.repartition(parts, "prefix").sortWithinPartitions("prefix", "shard", "place").mapInArrow(run, kind))


# --- the corpus ---------------------------------------------------------------------


def _with(texts: DataFrame, by_text: DataFrame, how: str) -> DataFrame:
    """``texts`` with the columns of (doc_id, row, ...); null ids meet null ids."""
    right = by_text.withColumnsRenamed({"doc_id": "__doc", "row": "__row"})
    return texts.join(right, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__doc")), how).drop("__doc", "__row")


def repeated_windows(texts: DataFrame, scratch: Scratch, length: int = 400, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(doc_id, row, first, last): ranges of the starts of windows that also start elsewhere."""
    shape = Shape(length)
    stored = scratch.put(sparse_suffixes(texts, shape), "suffixes")
    names = ("prefix", "context", "anchor", "first", "last")
    rows = stored.select("doc_id", "row", F.explode(F.arrays_zip(*names)).alias("x")).select("doc_id", "row", *[f"x.{c}" for c in names])
    # Counts are written before they are joined: a join of two written tables can split a hot prefix.
    often = scratch.put(stored.select(F.explode("prefix").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("prefix"), "often")
    alive = scratch.put(rows.join(often, "prefix"), "alive")
    kinds = scratch.put(alive.groupBy("prefix", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "anchor", "doc_id", "first", "last")).alias("one")), "kinds")
    by_prefix = scratch.put(kinds.groupBy("prefix").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "by-prefix")
    whole = alive.join(kinds.filter("n > 1").select("prefix", "context"), ["prefix", "context"]).select("doc_id", "row", "first", "last")
    wanted = scratch.put(kinds.join(by_prefix, "prefix").select(
        "one.doc_id", "one.row", "prefix", "one.anchor", "one.first", "one.last", "n", (F.col("kinds") > most_kinds).alias("hot")), "wanted")
    runs = scratch.put(contexts(texts, wanted, shape), "runs")
    merged = scratch.put(merge_runs(runs.filter("place >= 0"), shape), "merged")
    hot = runs.filter("place < 0").select("doc_id", "row", F.col("prefix").alias("one"), F.col("bytes").alias("two"), "n", "first", "last")
    twice = hot.groupBy("one", "two").agg(F.sum("n").alias("total")).filter("total > 1")
    single = hot.filter("n = 1").join(twice, ["one", "two"]).select("doc_id", "row", "first", "last")
    return whole.unionByName(merged).unionByName(single)


def remove_repeated_bytes(docs: DataFrame, scratch: Scratch, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                          most_kinds: int = MOST_KINDS, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``."""
    texts = _texts(docs, id_col, text_col)
    ranges = repeated_windows(texts, scratch, length, most_kinds).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    found = _with(texts, ranges, "left").select("doc_id", "data", "ranges.first", "ranges.last")

    def run(batch):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for data, first, last in zip(*(batch.column(c).to_pylist() for c in ("data", "first", "last"))):
            spans, at, parts = 0, 0, []
            for x, y in zip(first or (), last or ()):
                if x > at or not spans:
                    parts.append(data[at:x])
                    spans += 1
                at = max(at, y + length)
            kept = b"".join(parts) + data[at:]
            for c, v in zip(out, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)):
                out[c].append(v)
        return {id_col: batch.column("doc_id"), **out}

    kind = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return map_batches(found, run, kind)
