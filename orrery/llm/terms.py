"""Term frequencies of every scope by burst-trie counting; also the terms and runs other operators use."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.runtime import cut_lineage, join_small

#: Python's word class without the underscore: exactly the Unicode classes L and N (see the tests).
_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    """Maximal runs of letters and numbers (Unicode classes L and N) of the lower-cased text."""
    return _WORD.findall(text.lower())


#: A container's counters in one number: occurrences below, records above.
RECORD = 1 << 48


class Node:
    """A burst container: a child for each next character, and the counters of the term that ends here."""

    __slots__ = ("children", "end")

    def __init__(self):
        self.children: dict = {}
        self.end = 0


class BurstTrie:
    """Counters of (occurrences, records) by term, in containers that burst into children by prefix.

    A container is a plain table of term suffixes; above `burst` entries it is replaced by a node
    with a child container for each next character, so frequent prefixes get deep routes and rare ones
    stay compact. Counters are packed: occurrences + records * RECORD.
    """

    def __init__(self, burst: int = 2048):
        self.burst = burst
        self.root: dict | Node = {}

    def add_text(self, words: list[str]) -> None:
        """One record's terms."""
        counts = Counter(words)
        table = self.root
        if type(table) is dict:
            get = table.get
            for term, n in counts.items():
                table[term] = get(term, 0) + n + RECORD
            if len(table) > self.burst:
                self.root = self._burst(table)
        else:
            for term, n in counts.items():
                self.add(term, n + RECORD)

    def add(self, term: str, packed: int) -> None:
        node, depth, parent, key = self.root, 0, None, ""
        while type(node) is not dict:
            if depth == len(term):
                node.end += packed
                return
            parent, key = node, term[depth]
            depth += 1
            node = parent.children.get(key)
            if node is None:
                node = parent.children[key] = {}
        suffix = term[depth:]
        node[suffix] = node.get(suffix, 0) + packed
        if len(node) > self.burst:
            if parent is None:
                self.root = self._burst(node)
            else:
                parent.children[key] = self._burst(node)

    @staticmethod
    def _burst(table: dict) -> Node:
        node = Node()
        for suffix, packed in table.items():
            if suffix:
                node.children.setdefault(suffix[0], {})[suffix[1:]] = packed
            else:
                node.end = packed
        return node

    def containers(self) -> Iterator[tuple[str, dict[str, int]]]:
        """Every container as (prefix, {suffix: packed counters})."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                if node:
                    yield prefix, node
            else:
                if node.end:
                    yield prefix, {"": node.end}
                stack.extend((prefix + key, child) for key, child in node.children.items())

    def entries(self) -> int:
        return sum(len(table) for _, table in self.containers())


#: A subtree on its way: the container of a prefix, its suffixes and their counters. A null prefix tells a scope's number of texts.
SUBTREE = "field string, scope string, prefix string, suffixes array<string>, occurrences array<long>, records array<long>"
_COLUMNS = ["field", "scope", "prefix", "suffixes", "occurrences", "records"]
_TYPES = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _batches(rows: Iterator[tuple], names: list[str], types: tuple, weight=lambda row: len(row[3])) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 1
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _subtree(field: str, scope: str, prefix: str, table: dict[str, int]) -> tuple:
    packed = table.values()
    return field, scope, prefix, list(table), [p & (RECORD - 1) for p in packed], [p >> 48 for p in packed]


def _count(burst: int, most_entries: int):
    """Count a partition's texts, a trie for each scope; empty all tries when they hold too many entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tries: dict[tuple, BurstTrie] = {}
        texts: Counter = Counter()
        for batch in batches:
            for field, scope, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = field, scope
                trie = tries.get(key)
                if trie is None:
                    trie = tries[key] = BurstTrie(burst)
                texts[key] += 1
                trie.add_text(terms(text))
            if sum(t.entries() for t in tries.values()) > most_entries:
                yield from (_subtree(*key, *c) for key, trie in tries.items() for c in trie.containers())
                tries = {}
        yield from (_subtree(*key, *c) for key, trie in tries.items() for c in trie.containers())
        yield from ((*key, None, [], [n], []) for key, n in texts.items())

    return lambda batches: _batches(rows(batches), _COLUMNS, _TYPES)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split each subtree by the routes beneath its prefix, and by further characters where a route is too large."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in (*_COLUMNS, "deeper", "more"))
            for field, scope, prefix, suffixes, occurrences, records, deeper, more in zip(*columns, strict=True):
                if not deeper and not more:
                    yield field, scope, prefix, suffixes, occurrences, records
                    continue
                routes = {prefix: more or 0} | {d["prefix"]: d["more"] for d in deeper or ()}
                lengths = sorted({len(r) for r in routes}, reverse=True)
                parts: dict[str, list] = {}
                for suffix, n, m in zip(suffixes, occurrences, records, strict=True):
                    term = prefix + suffix
                    own = next(term[:i] for i in lengths if term[:i] in routes)
                    own = term[: len(own) + routes[own]]
                    part = parts.setdefault(own, [[], [], []])
                    for column, value in zip(part, (term[len(own) :], n, m), strict=True):
                        column.append(value)
                for own, part in parts.items():
                    yield field, scope, own, *part

    return _batches(rows(), _COLUMNS, _TYPES)


def _merge(burst: int):
    """Merge the matching subtrees of all workers, which come sorted, and tell their terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, trie = None, BurstTrie(burst)

        def told() -> Iterator[tuple]:
            for prefix, table in trie.containers():
                for suffix, packed in table.items():
                    yield key[0], key[1], key[2] + prefix + suffix, packed & (RECORD - 1), packed >> 48

        for batch in batches:
            for field, scope, prefix, suffixes, occurrences, records in zip(*(batch.column(n).to_pylist() for n in _COLUMNS), strict=True):
                if (field, scope, prefix) != key:
                    if key is not None:
                        yield from told()
                    key, trie = (field, scope, prefix), BurstTrie(burst)
                for suffix, n, m in zip(suffixes, occurrences, records, strict=True):
                    trie.add(suffix, n + m * RECORD)
        if key is not None:
            yield from told()

    names = ["field", "scope", "term", "occurrences", "records"]
    return lambda batches: _batches(rows(batches), names, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), lambda row: 1)


def routed(subtrees: DataFrame, most: int) -> DataFrame:
    """Subtrees cut and named so that those that match have one prefix, whatever workers burst.

    A route is the prefix of any container that some worker has; a term takes the longest one that begins
    it. A route whose containers hold more than `most` entries altogether is cut further, by as many
    characters as bring them below it at a branching of eight.
    """
    sizes = subtrees.groupBy("field", "scope", "prefix").agg(F.sum(F.size("suffixes")).alias("n"))
    more = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / most) / F.log(F.lit(8.0)))).cast("int")
    routes = cut_lineage(sizes.select("field", "scope", "prefix", more.alias("more")))
    if not routes.filter("prefix <> '' or more > 0").take(1):
        return subtrees
    beneath = routes.filter("prefix <> ''").select("field", "scope", F.explode(F.sequence(F.lit(0), F.length("prefix") - 1)).alias("i"), F.struct("prefix", "more").alias("d"))
    beneath = beneath.select("field", "scope", F.substring("d.prefix", F.lit(1), F.col("i")).alias("prefix"), "d").groupBy("field", "scope", "prefix").agg(F.collect_list("d").alias("deeper"))
    plans = routes.join(beneath, ["field", "scope", "prefix"], "left").filter("deeper is not null or more > 0")
    found = join_small(subtrees, cut_lineage(plans), ["field", "scope", "prefix"], ["suffixes"], "left")
    return found.select(*_COLUMNS, "deeper", "more").mapInArrow(_route, SUBTREE)


def term_counts(
    texts: DataFrame, rare: int = 1, common: float = 0.5, least_texts: int = 0, burst: int = 2048, most_entries: int = 400_000, most_route: int = 400_000,
) -> DataFrame:
    """Every distinct term of every scope: (field, scope, term, occurrences, records, texts, mark).

    texts(field, scope, text). occurrences: how often the term occurs; records: in how many texts;
    texts: the scope's non-null texts, empty ones included. mark is `rare` for a term in at most `rare`
    texts, else `common` for one in more than the share `common` of the scope's texts, else null.
    Scopes with fewer than least_texts texts are left out. Null texts and texts without field or scope
    are left out; repeated rows count as often as they occur. Empty input gives an empty result. Terms:
    see terms(); no normalization, so Unicode forms stay apart.

    The texts are read once. Each task counts its texts in burst tries, one a scope, at most `most_entries`
    entries before it passes the subtrees on as compact rows, which are written out. Subtrees are routed
    by adaptive prefixes (see routed()) and the matching ones of all workers merged in a trie, so a scope
    that holds a third of all texts is spread over tasks by its prefixes, and no route holds much more
    than `most_route` entries.
    """
    rows = texts.select("field", "scope", "text").filter("text is not null and scope is not null and field is not null")
    parts = cut_lineage(rows.mapInArrow(_count(burst, most_entries), SUBTREE))
    scopes = parts.filter("prefix is null").groupBy("field", "scope").agg(F.sum(F.col("occurrences")[0]).alias("texts"))
    if least_texts:
        scopes = scopes.filter(F.col("texts") >= least_texts)
    found = routed(parts.filter("prefix is not null"), most_route)
    found = found.repartition("field", "scope", "prefix").sortWithinPartitions("field", "scope", "prefix")
    merged = found.mapInArrow(_merge(burst), "field string, scope string, term string, occurrences long, records long")
    marked = join_small(merged, scopes, ["field", "scope"], ["term"])
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("texts"), "common")
    return marked.withColumn("mark", mark)
