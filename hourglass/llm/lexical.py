"""Ranked lexical search by document FP-trees and branch and bound.

Terms are maximal runs of ASCII letters and digits and of characters beyond
ASCII, A-Z lower-cased. Of every whole text only the terms that some item
asks for are kept (its restricted vector), with their counts and the number
of all its terms; corpus counts (documents with terms, terms, documents by
term) are taken over all documents.

A task reads the restricted vectors in chunks. The terms of a vector are put
in order of falling document frequency, so vectors share paths of a trie,
which is stored depth first: a subtree is a run of documents. Every node
keeps the largest tf of each term and the smallest length norm m of its
subtree; as a term's part of the score grows with tf and falls with m, they
bound the score of all its documents. Each item walks the tree depth first,
best bound first, and leaves subtrees whose bound is below its k-th best score
so far; this threshold stays from chunk to chunk. A task returns k documents
an item; the k best of all tasks are the answer, exact as no bound is short.

The items go in blocks of a bounded number of terms, so what a task is sent
and what a node holds do not grow with the query set.

Defined cases: null and empty texts have no terms; an item without terms, and
documents that score 0, give no rows; the rows of a repeated item id are one
item with the terms of all; every row of a repeated document id is a document
of its own; a null document id comes last among equal scores, a null item id
is an item; very long texts are one document each, read whole; empty tables
give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, to_batch

# Terms of a block of items; documents, and entries of their vectors, of a
# chunk; documents of a leaf; levels of the trie (deeper paths share a leaf).
BLOCK_TERMS = 1 << 14
CHUNK_ROWS = 2048
CHUNK_ENTRIES = 1 << 20
LEAF_ROWS = 16
LEVELS = 12
NO_ID = np.iinfo(np.int64).max

_LOWER = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _utf8(batch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: all its terms counted, the vocabulary's kept."""
    def run(batch):
        n, terms, tfs = [], [], []
        for text in _utf8(batch, "t"):
            words = terms_of(text)
            counts = Counter(map(vocabulary.get, words))
            counts.pop(None, None)
            n.append(len(words))
            terms.append(list(counts))
            tfs.append(list(counts.values()))
        return {"doc_id": batch.column("id"), "n": n, "terms": terms, "tfs": tfs}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """The FP-tree of a chunk of documents: terms are numbers in order of falling frequency."""

    def __init__(self, ids, m, offsets, terms, tfs, n_terms: int):
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((terms, rows))
        terms, tfs = terms[order], tfs[order]
        level = np.arange(len(terms)) - offsets[rows]
        top = np.full((LEVELS, len(ids)), n_terms, np.int32)
        low = level < LEVELS
        top[level[low], rows[low]] = terms[low]
        place = np.lexsort(top[::-1])
        size = np.diff(offsets)[place]
        self.offsets = np.r_[0, np.cumsum(size)]
        entry = np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1] - offsets[:-1][place], size)
        self.terms, tfs = terms[entry], tfs[entry].astype(np.int64)
        self.ids, self.m, self.top = ids[place], m[place], top[:, place]
        self.row = np.repeat(np.arange(len(ids)), size)
        self.part = (1_000_000_000 * tfs) // (1000 * tfs + 8 * self.m[self.row])
        self.start: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        self._grow(0, len(ids), 0)
        self.most = np.zeros((n_terms, len(self.start)), np.int32)
        self.least = np.zeros(len(self.start), np.int64)
        leaf = np.zeros(len(ids), np.int64)
        for node, below in enumerate(self.children):
            if not below:
                leaf[self.start[node]:self.end[node]] = node
                self.least[node] = self.m[self.start[node]:self.end[node]].min()
        np.maximum.at(self.most, (self.terms, leaf[self.row]), tfs)
        for node in range(len(self.start) - 1, -1, -1):      # a child has a larger number than its parent
            if self.children[node]:
                self.most[:, node] = self.most[:, self.children[node]].max(axis=1)
                self.least[node] = self.least[self.children[node]].min()

    def _node(self, start: int, end: int) -> int:
        self.start.append(start)
        self.end.append(end)
        self.children.append([])
        return len(self.start) - 1

    def _grow(self, start: int, end: int, level: int) -> None:
        """Nodes of documents [start, end), whose first ``level`` terms agree; an explicit stack, as depth follows the data."""
        todo = [(self._node(start, end), level)]
        while todo:
            node, level = todo.pop()
            a, b = self.start[node], self.end[node]
            cut = np.empty(0, int)
            while b - a > LEAF_ROWS and level < LEVELS and not len(cut):   # a single child goes on in its parent
                cut = np.flatnonzero(np.diff(self.top[level, a:b])) + a + 1
                level += 1
            if b - a <= LEAF_ROWS:
                continue
            if not len(cut):                                            # equal to the last level: cut into leaves
                self.children[node] = [self._node(x, min(x + LEAF_ROWS, b)) for x in range(a, b, LEAF_ROWS)]
                continue
            edges, runs = [a, *cut.tolist(), b], []
            for x, y in zip(edges, edges[1:]):
                if runs and y - runs[-1][0] <= LEAF_ROWS:                # small neighbours share a leaf
                    runs[-1][1] = y
                else:
                    runs.append([x, y])
            for x, y in runs:
                child = self._node(x, y)
                self.children[node].append(child)
                todo.append((child, level))

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, k: int) -> list:
        """``best`` (score falling, id rising), at most k long, with this tree's documents; ``dense``: weight by term."""
        tf = self.most[terms].astype(np.int64)
        bound = weights @ ((1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * self.least, 1))
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < (best[-1][0] if len(best) == k else 1):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            a, b = self.start[node], self.end[node]
            x, y = self.offsets[a], self.offsets[b]
            part = dense[self.terms[x:y]] * self.part[x:y]
            score = np.add.reduceat(np.r_[part, 0], np.minimum(self.offsets[a:b] - x, len(part)))
            score[self.offsets[a:b] == self.offsets[a + 1:b + 1]] = 0
            least = best[-1][0] if len(best) == k else 1
            hit = np.flatnonzero(score >= least)
            if len(hit):
                found = zip(score[hit].tolist(), self.ids[a:b][hit].tolist())
                best = sorted(best + list(found), key=lambda x: (-x[0], x[1]))[:k]
        return best


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, n, offsets, terms, tfs) of bounded runs of rows."""
    held, rows, entries = [], 0, 0

    def joined():
        parts = list(zip(*held))
        sizes = np.concatenate(parts[2])
        return (np.concatenate(parts[0]), np.concatenate(parts[1]), np.r_[0, np.cumsum(sizes)],
                np.concatenate(parts[3]), np.concatenate(parts[4]))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            terms, tfs = part.column("terms"), part.column("tfs")
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            held.append((part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False),
                         part.column("n").to_numpy(zero_copy_only=False), sizes,
                         terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)))
            rows, entries = rows + part.num_rows, entries + int(sizes.sum())
            if rows >= CHUNK_ROWS or entries >= CHUNK_ENTRIES:
                yield joined()
                held, rows, entries = [], 0, 0
    if held:
        yield joined()


def _search_block(vectors: DataFrame, items: list[tuple], order: np.ndarray, weights: np.ndarray, n_docs: int,
                  n_terms: int, k: int) -> DataFrame:
    """The k best documents an item and task; items: (item_id, terms); order: a term's place by falling frequency."""
    asked = [(item, order[terms]) for item, terms in items]
    by_place = np.zeros(len(order), np.int64)
    by_place[order] = weights
    target = arrow_schema("item_id long, doc_id long, score long")

    def run(batches):
        best = [[] for _ in asked]
        for ids, n, offsets, terms, tfs in _chunks(batches):
            m = 10 + (90 * n * n_docs) // n_terms
            tree = Tree(ids, m, offsets, order[terms], tfs, len(order))
            dense = np.zeros(len(order), np.int64)
            for i, (_, places) in enumerate(asked):
                dense[places] = by_place[places]
                best[i] = tree.search(places, by_place[places], dense, best[i], k)
                dense[places] = 0
        rows = [(item, d, s) for (item, _), found in zip(asked, best) for s, d in found]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield to_batch({"item_id": list(item), "doc_id": [None if d == NO_ID else d for d in doc], "score": list(score)}, target)

    return vectors.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def item_blocks(items: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> Iterator[list[tuple]]:
    """Items as (item_id, their terms), in blocks of about ``BLOCK_TERMS`` terms."""
    def run(batch):
        return {"item_id": batch.column("id"), "terms": [sorted(set(terms_of(t))) for t in _utf8(batch, "t")]}

    rows = scratch.put(map_batches(items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")),
                                   run, "item_id long, terms array<binary>"), "items")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    for block in range(blocks):
        merged: dict = {}
        for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            merged.setdefault(r["item_id"], set()).update(bytes(t) for t in r["terms"])
        held = [(i, sorted(t)) for i, t in merged.items() if t]
        if held:
            yield held


def rank_documents(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    found = None
    for block in item_blocks(items, item_id_col, item_text_col, scratch):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        vectors = scratch.put(restricted_vectors(docs, vocabulary, id_col, text_col), "vectors")
        n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        places = np.empty(len(df), np.int64)
        places[np.argsort(-df, kind="stable")] = np.arange(len(df))
        asked = [(item, np.array([vocabulary[t] for t in terms])) for item, terms in block]
        best = scratch.put(_search_block(vectors, asked, places, weights, n_docs, n_terms, k), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item_id", F.row_number().over(by).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)
