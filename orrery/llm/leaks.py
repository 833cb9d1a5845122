"""Evaluation passages inside training texts, by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shingles import Hasher, among, bit_filter, runs_of
from orrery.llm.terms import terms
from orrery.runtime import cut_lineage

#: Characters of evaluation text that may be held in every task; beyond that, pieces and texts meet by a join.
BLOCK_CHARS = 16_000_000
#: Exact piece hits that are held at once.
HELD_HITS = 4_000_000
SCHEMA = "doc_id long, item_id long, edits int, run int"


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least edit distance of each pattern (up to 63 symbols) to any substring of its text, bit-parallel.

    patterns (C, m) and texts (C, L) hold symbols; -1 in a text matches nothing.
    """
    count, m = patterns.shape
    bits = np.uint64(1) << np.arange(m, dtype=np.uint64)
    top, one = bits[-1], np.uint64(1)
    plus = np.full(count, (1 << m) - 1, dtype=np.uint64)
    minus = np.zeros(count, dtype=np.uint64)
    score = np.full(count, m)
    best = score.copy()
    for j in range(texts.shape[1]):
        equal = np.where(patterns == texts[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus), plus & horizontal
        score += ((up & top) != 0).astype(int) - ((down & top) != 0)
        up, down = up << one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
        best = np.minimum(best, score)
    return best


class Items:
    """A block of evaluation passages: their terms as numbers, and the places of every piece."""

    def __init__(self, rows: list[tuple[int, str]], window: int, edits: int):
        self.window, self.edits = window, edits
        self.piece = window // (edits + 1)
        self.offsets = [j * self.piece for j in range(edits + 1)]
        self.vocabulary: dict[str, int] = {}
        fields, owner = [], []
        for item, text in rows:
            words = terms(text)
            if len(words) >= window:
                fields.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                owner.append(item)
        self.owner = np.array(owner, dtype=np.int64)
        lengths = np.array([len(f) for f in fields], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.symbols = np.array([s for f in fields for s in f], dtype=np.int64)
        self.field = np.repeat(np.arange(len(fields)), lengths)
        hashes = runs_of(self.symbols.astype(np.uint64), self.piece)
        place = np.arange(len(hashes))
        place = place[self.field[place] == self.field[place + self.piece - 1]] if len(hashes) else place
        order = np.argsort(hashes[place], kind="stable")
        self.place, self.hash = place[order], hashes[place][order]

    def _ranges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place of the text, where in the table its piece's places begin and end; both 0 where it is none."""
        if len(symbols) < self.piece or not len(self.hash):
            return (np.zeros(len(symbols), np.int64),) * 3
        known = symbols > 0
        at = np.flatnonzero(np.convolve(known, np.ones(self.piece, dtype=np.int64), "valid") == self.piece)
        h = runs_of(symbols.astype(np.uint64), self.piece)[at]
        low, high = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        low[at], high[at] = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        return low, high, high - low

    def count(self, symbols: np.ndarray) -> np.ndarray:
        """How many places of the passages each place of the text hits."""
        return self._ranges(symbols)[2]

    def hits(self, symbols: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in the passages) of every exact occurrence of a piece, at the given places of the text."""
        low, _, n = self._ranges(symbols)
        at = np.flatnonzero(n) if at is None else at
        low, n = low[at], n[at]
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(at, n), self.place[which]


def search(items: Items, symbols: np.ndarray, document: np.ndarray, slab: int = 200_000, held: int = HELD_HITS) -> tuple[np.ndarray, ...]:
    """(document, field, edits, run) of each window found; document gives the text of each symbol.

    No more than about `held` piece hits are in memory at once: texts are taken in halves, and the hits of
    one text by ranges of passages. Both keep whole what belongs together.
    """
    many = items.count(symbols)
    total = int(many.sum())
    if total <= held or len(items.owner) <= 1 and document[:1] == document[-1:]:
        return _search(items, symbols, document, *items.hits(symbols), slab)
    if document[0] != document[-1]:
        middle = int(np.searchsorted(document, (document[0] + document[-1] + 1) // 2))
        parts = [search(items, symbols[x], document[x], slab, held) for x in (slice(0, middle), slice(middle, None))]
    else:
        ranges = min(len(items.owner), -(-total // held))
        bounds = np.linspace(0, len(items.owner), ranges + 1).astype(int)
        parts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            found = [], []
            at = np.flatnonzero(many)
            cuts = np.flatnonzero(np.diff(np.cumsum(many[at]) // held)) + 1
            for block in np.split(at, cuts):
                q, p = items.hits(symbols, block)
                keep = (items.field[p] >= a) & (items.field[p] < b)
                found[0].append(q[keep])
                found[1].append(p[keep])
            parts.append(_search(items, symbols, document, np.concatenate(found[0]), np.concatenate(found[1]), slab))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _search(items: Items, symbols: np.ndarray, document: np.ndarray, q: np.ndarray, p: np.ndarray, slab: int) -> tuple[np.ndarray, ...]:
    w, k = items.window, items.edits
    found = []
    # exact runs: pieces that follow each other on one diagonal
    order = np.lexsort((q, items.field[p], q - p, document[q]))
    q, p = q[order], p[order]
    if len(q):
        breaks = np.flatnonzero((np.diff(q) != 1) | (np.diff(p) != 1) | (np.diff(document[q]) != 0) | (np.diff(items.field[p]) != 0))
        first = np.concatenate([[0], breaks + 1])
        run = np.diff(np.append(first, len(q))) + items.piece - 1
        good = run >= w
        found.append((document[q[first[good]]], items.field[p[first[good]]], np.zeros(good.sum(), np.int64), run[good]))
    if k and len(q):
        padded = np.concatenate([np.full(w + 2 * k, -1), symbols, np.full(2 * w + 2 * k, -1)])
        owner = np.concatenate([np.full(w + 2 * k, -1), document, np.full(2 * w + 2 * k, -1)])
        shift = w + 2 * k
        seen = [np.column_stack([q - o, p - o]) for o in items.offsets]
        both = np.concatenate(seen)
        own = np.repeat([document[q]], len(items.offsets), axis=0).ravel()
        inside = (both[:, 1] >= items.start[items.field[np.tile(p, len(items.offsets))]]) & (both[:, 1] + w <= items.start[items.field[np.tile(p, len(items.offsets))] + 1])
        both, own = both[inside], own[inside]
        both, index = np.unique(both, axis=0, return_index=True)
        own = own[index]
        for a in range(0, len(both), slab):
            at, place, mine = both[a : a + slab, 0], both[a : a + slab, 1], own[a : a + slab]
            span = at[:, None] + shift - k + np.arange(w + 2 * k)
            texts = np.where(owner[span] == mine[:, None], padded[span], -1)
            distance = myers(items.symbols[place[:, None] + np.arange(w)], texts)
            good = distance <= k
            found.append((mine[good], items.field[place[good]], distance[good], np.zeros(good.sum(), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(4))


def _scan(shared, batch_terms: int = 500_000):
    def emit(items: Items, ids: list[int], lists: list[list[int]]) -> pa.RecordBatch:
        symbols = np.array([s for x in lists for s in (*x, 0)], dtype=np.int64)
        document = np.repeat(np.arange(len(ids)), [len(x) + 1 for x in lists])
        doc, field, edits, run = search(items, symbols, document)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, f, e, r in zip(doc.tolist(), field.tolist(), edits.tolist(), run.tolist(), strict=True):
            key = (ids[d], int(items.owner[f]))
            old = best.get(key, (e, r))
            best[key] = (min(old[0], e), max(old[1], r))
        columns = [[k[0] for k in best], [k[1] for k in best], [v[0] for v in best.values()], [v[1] for v in best.values()]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "edits", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        number = items.vocabulary.get
        for batch in batches:
            ids, lists, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [number(w, 0) for w in terms(text)]
                ids.append(doc)
                lists.append(found)
                size += len(found)
                if size > batch_terms:
                    yield emit(items, ids, lists)
                    ids, lists, size = [], [], 0
            if ids:
                yield emit(items, ids, lists)

    return run


def _pieces(width: int, filter_):
    """(hash, key): the distinct runs of `width` terms of each text; of documents those only that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        bits = None if filter_ is None else filter_.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                runs = np.unique(runs_of(hasher(terms(text)), width))
                found.append(runs if bits is None else runs[among(bits, runs)])
            keys = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            every = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(keys, pa.int64())], ["hash", "key"])

    return run


def _verify(window: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, item, text, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "passage")), strict=True):
                items = Items([(item, passage)], window, edits)
                symbols = np.array([items.vocabulary.get(w, 0) for w in terms(text)], dtype=np.int64)
                _, _, e, r = search(items, symbols, np.zeros(len(symbols), np.int64))
                if len(e):
                    out.append((doc, item, int(e.min()), int(r.max())))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "edits", "run"])

    return run


def joined_leaks(documents: DataFrame, passages: DataFrame, window: int, edits: int) -> DataFrame:
    """leaks() of (doc_id, text) and distinct (item_id, passage) of any number: pieces meet by a join on their hashes.

    The corpus is read once for pieces that pass a bit filter of the passages' pieces (at most 16 MB), once for
    the texts of candidates. A candidate is a text and a passage that share a piece.
    """
    spark = documents.sparkSession
    width = window // (edits + 1)
    named = cut_lineage(passages.withColumn("pid", F.xxhash64("item_id", "passage")).filter(F.length("passage") >= window))
    asked = cut_lineage(named.select("pid", "passage").mapInArrow(_pieces(width, None), "hash long, key long"))
    bits = spark.sparkContext.broadcast(bit_filter(asked.select(F.col("hash").alias("key")).distinct()))
    found = documents.select("doc_id", "text").mapInArrow(_pieces(width, bits), "hash long, key long")
    pairs = found.select("hash", F.col("key").alias("doc_id")).join(asked.select("hash", F.col("key").alias("pid")).hint("merge"), "hash").select("doc_id", "pid").distinct()
    pairs = pairs.join(named.hint("merge"), "pid").join(documents.select("doc_id", "text").distinct().hint("merge"), "doc_id")
    return pairs.select("doc_id", "item_id", "text", "passage").mapInArrow(_verify(window, edits), SCHEMA)


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, edits: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, run): documents that repeat a passage of an evaluation item.

    documents(doc_id BIGINT, text); items(item_id BIGINT, passage STRING), one row per field of an item.
    A document leaks an item if some `window` consecutive terms of one of its passages occur in it with
    at most `edits` terms (not characters) inserted, left out or replaced; edits is the least number found,
    run the longest exactly repeated run of terms if it has at least `window`, else 0. Passages with fewer terms
    cannot leak. Null texts, passages and ids are left out, repeated rows count once, empty tables give
    an empty result. window is at most 63.

    Each window is split into edits + 1 pieces: edits can spoil all but one, so one occurs exactly.
    Exact piece hits come from a sorted table of piece hashes; each hit's window is verified by
    Myers' bit-parallel distance, many at once. Up to block_chars characters of passages (counted) the table is
    built on the driver and sent to the executors; beyond that pieces meet by a join (joined_leaks()), with the
    same result.
    """
    spark = documents.sparkSession
    passages = items.select("item_id", "passage").filter("item_id is not null and passage is not null").distinct()
    size = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    if size > block_chars:
        found = joined_leaks(rows, passages, window, edits)
    else:
        held = Items([tuple(r) for r in passages.orderBy("item_id", "passage").collect()], window, edits)
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(held)), SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("run").alias("run"))


def held_out(eval_items: DataFrame) -> DataFrame:
    """(item_id, passage) of question and support of the test and validation rows."""
    rows = eval_items.filter("split in ('test', 'validation')")
    return rows.select("item_id", F.explode(F.array("question", "support")).alias("passage"))
