"""Near-duplicate texts: exact set-similarity links, by a universe partition or by prefixes of rare tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shingles import Hasher, among, bit_filter, mix, shingle_set
from orrery.runtime import BROADCAST_ROWS, at_most, cut_lineage

#: Counters of the cost sketch at most (4 bytes in a task, 1 once they are prices), cut into chunks that are summed apart.
SKETCH, CHUNK = 1 << 24, 1 << 16
#: Parity segments of a set, in words of 64 bits: four for each of its tokens, as a power of two of words.
WORDS, MOST_WORDS = 4, 256
#: Words that a prefix row has for the parities of the tokens from its own on: 1 for sets up to the first size, then 2, 4, 8.
SUFFIX = (48, 96, 256)
#: Similarity from which the universe is partitioned; below, segments hold too few tokens to tell sets apart.
UNIVERSE = 0.7
#: Bytes kept of a token: two different runs of a pair are taken for one with a chance of 2^-48.
TOKEN_BYTES = 6
#: Groups of texts with equal sets up to this size are written out as all their pairs; larger ones as links to their least key.
EXPAND = 100
SETS = "key long, n int, tokens binary"
SIGNS = "key long, n int, s1 long, s2 long, parity binary"
_WORDS = [f"w{i}" for i in range(2 ** len(SUFFIX))]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a binary column, and the index of the row each belongs to."""
    raw = column.to_pylist()
    lengths = np.array([len(r) // TOKEN_BYTES for r in raw], dtype=np.int64)
    wide = np.zeros((lengths.sum(), 8), dtype=np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view(np.uint64).ravel(), np.repeat(np.arange(len(raw)), lengths)


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _tokens(width: int, least_terms: int, asked=None):
    """The sets of texts; with a bit filter, of those whose key passes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            if asked is not None:
                batch = batch.filter(pa.array(among(asked.value, mix(batch.column(0).to_numpy().view(np.uint64)))))
            found = [(k, shingle_set(t, width, hasher, least_terms)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            keys, sets = [k for k, s in found if s is not None], [s for _, s in found if s is not None]
            columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([_short(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "tokens"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["key"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit filter of keys(key BIGINT), whatever pattern they have, for `_tokens`."""
    return bit_filter(keys.mapInArrow(_mixed, "key long"))


def parity_words(n: np.ndarray) -> np.ndarray:
    """Words of the parities of sets of n tokens: a power of two, so that those of a larger set fold onto a smaller one's."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) / 16)).astype(np.int64).clip(0), WORDS, MOST_WORDS)


def _signs(width: int, least_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text, width, hasher, least_terms)
                if found is not None:
                    keys.append(key)
                    sets.append(found)
            if not keys:
                continue
            n = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), n)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            words = parity_words(n)
            ends = np.cumsum(words)
            at = (64 * (ends - words))[row] + (mix(every) & (np.uint64(64) * words.astype(np.uint64) - np.uint64(1))[row]).astype(np.int64)
            parity = np.packbits((np.bincount(at, minlength=64 * ends[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
            columns = [pa.array(keys, pa.int64()), pa.array(n, pa.int32())]
            columns += [pa.array(np.add.reduceat(mix(every + np.uint64(salt)), starts).view(np.int64)) for salt in (1, 2)]
            columns.append(pa.array([parity[8 * (e - w) : 8 * e] for e, w in zip(ends.tolist(), words.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "s1", "s2", "parity"])

    return run


def _sketch(size: int):
    chunk = min(size, CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            tokens, _ = _lists(batch.column(0))
            np.add.at(counts, (tokens & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        used = [c for c in range(size // chunk) if counts[c * chunk : (c + 1) * chunk].any()]
        # the bytes of one weight lie together: the upper ones are mostly zeros
        planes = [zlib.compress(counts[c * chunk : (c + 1) * chunk].view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for c in used]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "counts": pa.array(planes, pa.binary())})

    return run


def _price(table: pa.Table) -> pa.Table:
    """The sum of the counts of a chunk as prices of one byte: eight steps for each doubling."""
    total: np.ndarray | int = 0
    for raw in table.column("counts").to_pylist():
        total = total + np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.uint64)
    price = np.minimum(np.ceil(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "price": pa.array([price.tobytes()], pa.binary())})


def cost_sketch(sets: DataFrame, tokens: int) -> np.ndarray:
    """Prices by how often the tokens of each hash bucket occur: about one counter for each token, up to SKETCH."""
    size = 1 << min(max(int(tokens), 1 << 12).bit_length(), SKETCH.bit_length() - 1)
    chunk = min(size, CHUNK)
    parts = sets.select("tokens").mapInArrow(_sketch(size), "chunk int, counts binary")
    price = np.zeros(size, dtype=np.uint8)
    for row in parts.groupBy("chunk").applyInArrow(_price, "chunk int, price binary").collect():
        price[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.price, dtype=np.uint8)
    return price


def _prefixes(cost, similarity: float):
    """The rarest tokens of each set, one more than its error budget: (token, key, n, place), and the parities of the tokens from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price = cost.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            tokens, row = _lists(batch.column(2))
            order = np.lexsort((tokens, price[(tokens & np.uint64(len(price) - 1)).astype(np.int64)], row))
            tokens, ends = tokens[order], np.cumsum(n)
            place = np.arange(len(row)) - (ends - n)[row]
            keep = np.flatnonzero(place < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[row])
            own = np.uint64(1) << (mix(tokens) & np.uint64(63))
            segment = (mix(tokens) >> np.uint64(6)).astype(np.int64) & (2 ** np.searchsorted(SUFFIX, n) - 1)[row]
            words = []
            for i in range(len(_WORDS)):
                # parities of all tokens from each on; those from the next set on are taken off again
                after = np.append(np.bitwise_xor.accumulate(np.where(segment == i, own, np.uint64(0))[::-1])[::-1], np.uint64(0))
                words.append(pa.array((after[keep] ^ after[ends[row[keep]]]).view(np.int64)))
            tokens, row, place = tokens[keep].view(np.int64), row[keep], place[keep]
            columns = [pa.array(tokens), pa.array(key[row]), pa.array((n[row] << 32) | place), *words]
            yield pa.RecordBatch.from_arrays(columns, ["token", "key", "np", *_WORDS])

    return run


def _suffixes_differ(na):
    """How many parities of the tokens from a met one on differ, those of the larger set b folded onto the words that a has."""
    many, found = len(_WORDS), None
    for most in (None, *reversed(SUFFIX)):
        b = [F.col(f"b.{w}") for w in _WORDS]
        folded = [reduce(Column.bitwiseXOR, b[i::many]) for i in range(many)]
        differ = reduce(Column.__add__, (F.bit_count(F.col(f"a.{_WORDS[i]}").bitwiseXOR(folded[i])) for i in range(many)))
        found = differ if most is None else F.when(na <= most, differ).otherwise(found)
        many //= 2
    return found


def size_band(n: np.ndarray, similarity: float) -> np.ndarray:
    """Bands of sizes, each from one size to that over the similarity: linked sets lie in one or in neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1) + 0.0) / -np.log(similarity) + 1e-9).astype(np.int64)


def band_segments(band: np.ndarray, similarity: float) -> np.ndarray:
    """Segments of a band: one more than its largest sets may differ in."""
    largest = np.floor(similarity ** -(band + 1.0) + 1e-6)
    return np.floor((1 - similarity) / (1 + similarity) * 2 * largest + 1e-9).astype(np.int64) + 1


def _cut(tokens: np.ndarray, row: np.ndarray, rows: int, band: np.ndarray, similarity: float):
    """The segments of sets in the given bands: (first, segment of each token, sum of each segment, part of each token)."""
    many = band_segments(band, similarity)
    first = np.concatenate([[0], np.cumsum(many)])
    turned = mix(tokens + (band[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    segment = first[row] + (turned % many[row].astype(np.uint64)).astype(np.int64)
    part = mix(turned)
    total = np.zeros(first[-1], dtype=np.uint64)
    np.add.at(total, segment, part)
    owner = np.repeat(np.arange(rows), many)
    name = mix(band[owner].astype(np.uint64) * np.uint64(1 << 32) + (np.arange(first[-1]) - first[owner]).astype(np.uint64))
    return first, owner, segment, total, part, name


#: The three ways in which two segments may differ by at most one token: equal, one too many in the index, one in the probe.
EQUAL, LACKS, HAS = (np.uint64(x) for x in (11, 13, 17))


def _index(similarity: float, asked):
    """(sig, key, n): what each set is indexed by in its own band and the next, as far as some set asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            tokens, row = _lists(batch.column(2))
            for step in (0, 1):
                _, owner, segment, total, part, name = _cut(tokens, row, len(n), size_band(n, similarity) + step, similarity)
                whole = total + name
                sigs = np.concatenate([mix(whole ^ EQUAL), mix(whole ^ HAS), mix((whole[segment] - part) ^ LACKS)])
                owners = np.concatenate([owner, owner, row])
                keep = np.flatnonzero(among(bits, sigs))
                yield pa.RecordBatch.from_arrays([pa.array(sigs[keep].view(np.int64)), pa.array(key[owners[keep]]), pa.array(n[owners[keep]].astype(np.int32))], ["sig", "key", "n"])

    return run


def _probe(similarity: float, cost):
    """(sig, key, n): what each set asks the index of its band for, with thresholds allotted to its segments by their cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price = cost.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            tokens, row = _lists(batch.column(2))
            first, owner, segment, total, part, name = _cut(tokens, row, len(n), size_band(n, similarity), similarity)
            # a segment costs what its rarest token occurs; with one token less, what its second one does; an empty one, all
            dear = float(price.sum()) + 1
            order = np.lexsort((price[(tokens & np.uint64(len(price) - 1)).astype(np.int64)], segment))
            rare = price[(tokens[order] & np.uint64(len(price) - 1)).astype(np.int64)].astype(np.float64)
            at = segment[order]
            begin = np.searchsorted(at, np.arange(first[-1]))
            size = np.bincount(at, minlength=first[-1])
            padded = np.append(rare, [dear, dear])
            zero = np.where(size > 0, padded[np.minimum(begin, len(rare))], dear)
            one = np.where(size > 1, padded[np.minimum(begin + 1, len(rare))], 2 * dear)
            budget = np.floor((1 - similarity) / (1 + similarity) * 2 * n + 1e-9).astype(np.int64) + 1
            place = np.arange(first[-1]) - first[owner]
            spare = np.diff(first) - budget
            dearest, cheapest = np.lexsort((place, -zero, owner)), np.lexsort((place, one, owner))
            threshold = np.zeros(first[-1], dtype=np.int64)
            threshold[dearest[place < spare[owner]]] = -1
            # the dearest of the others are given up for a second token in the cheapest, where that costs less
            j = place - spare[owner]
            mine = np.flatnonzero(j >= 0)
            swap = zero[dearest[mine]] > one[cheapest[(first[owner[mine]] + j[mine])]]
            threshold[dearest[mine[swap]]] = -1
            threshold[cheapest[(first[owner[mine]] + j[mine])[swap]]] = 1
            whole = total + name
            a, b = np.flatnonzero(threshold >= 0), np.flatnonzero(threshold == 1)
            c = np.flatnonzero(threshold[segment] == 1)
            sigs = np.concatenate([mix(whole[a] ^ EQUAL), mix(whole[b] ^ LACKS), mix((whole[segment[c]] - part[c]) ^ HAS)])
            owners = np.concatenate([owner[a], owner[b], row[c]])
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(key[owners]), pa.array(n[owners].astype(np.int32))], ["sig", "key", "n"])

    return run


def _alike(similarity: float):
    """(a, b, na, nb) of the pairs whose parities differ no more often than linked sets' may; a is the smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
            pa_, pb = batch.column("pa"), batch.column("pb")
            wa, wb = parity_words(na), parity_words(nb)
            differ = np.zeros(len(na), dtype=np.int64)
            for x, y in set(zip(wa.tolist(), wb.tolist(), strict=True)):
                at = np.flatnonzero((wa == x) & (wb == y))
                left, right = (np.frombuffer(b"".join(side.take(pa.array(at)).to_pylist()), dtype=np.uint64) for side in (pa_, pb))
                folded = np.bitwise_xor.reduce(right.reshape(len(at), y // x, x), axis=1)
                differ[at] = np.bitwise_count(left.reshape(len(at), x) ^ folded).sum(axis=1)
            least = np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9).astype(np.int64)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(differ <= na + nb - 2 * least))

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The common tokens of each pair, counted."""
    for batch in batches:
        left, i = _lists(batch.column("ta"))
        right, j = _lists(batch.column("tb"))
        row, token = np.concatenate([i, j]), np.concatenate([left, right])
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        same = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
        common = np.bincount(row[1:][same], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.select(["a", "b", "na", "nb"]).columns, pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])


class Near:
    """Links between the distinct sets of a collection of texts, and the texts that share a set.

    texts(key BIGINT unique, text STRING). The set of a text are its distinct runs of `width` terms;
    texts with fewer than max(least_terms, width) terms, or null, take no part. A link joins two
    different sets with |A n B| >= similarity * |A u B|. Links are exact (up to 48-bit hashes of runs).

    Two methods give the same links.

    universe (for a similarity of 0.7 or more): sizes are cut into bands, so that linked sets lie in one
    or in neighbouring bands. A band hashes the universe of tokens into one segment more than its sets may
    differ in. A set is indexed, in its own band and the next, by its segments and their one-deletion
    neighbourhoods; it asks in its own band with thresholds -1, 0 or 1 for each segment, allotted by cost (how often
    the segment's rarest tokens occur) so that they add up to its error budget: of two linked sets the larger
    one's question is always answered by the smaller one. Of the index only what some set asks for is kept.

    prefix (below, where segments would hold about one token each): of two linked sets the smaller, of size
    n, lacks at most e = n - o tokens in the other, o being the least overlap their sizes allow. With all
    tokens in one global order, by cost, two linked sets share one of their e + 1 rarest.

    Candidates are dropped if their sizes or places leave too little to share, or if the parities of
    the hash segments of the universe differ more often than the pair's symmetric difference may; those
    left are counted in full, and only their sets are made again. With prefixes, parities are first compared in
    the join itself, of the tokens from the met one on: at the first token that linked sets share, all that they
    share is there, so these may differ by what their tokens from there on exceed the least overlap. What is written of
    candidates so stays near the number of links, while the pairs that meet grow with the square of the texts.
    Costs come from a sketch of bounded size; it only decides the order of tokens, any order gives the same links.
    """

    def __init__(self, texts: DataFrame, similarity: float = 0.8, width: int = 5, least_terms: int = 0, method: str | None = None):
        self.similarity = similarity
        self.method = method or ("universe" if similarity >= UNIVERSE else "prefix")
        rows = texts.select("key", "text").filter("key is not null and text is not null")
        # signs are written out; the sets, several times their size, are made again from the texts where needed
        self.all = cut_lineage(rows.mapInArrow(_signs(width, least_terms), SIGNS))
        classes = self.all.groupBy("n", "s1", "s2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        narrow = self.all.select("key", "n", "s1", "s2")
        #: (key, rep, copies) of every text that shares its set
        classes = F.broadcast(classes) if at_most(classes, BROADCAST_ROWS) else classes
        self.members = cut_lineage(narrow.join(classes, ["n", "s1", "s2"]).select("key", "rep", "copies").distinct())
        others = self.members.filter("key <> rep").select("key")
        make = _tokens(width, least_terms)
        if at_most(others, BROADCAST_ROWS):
            others = F.broadcast(others)
            kept = rows.join(others, "key", "left_anti")
        else:
            # texts don't travel to a join: a bit filter of all sets' names leaves a few of the others, whose pairs meet no sign
            reps = self.all.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
            kept, make = rows, _tokens(width, least_terms, rows.sparkSession.sparkContext.broadcast(key_filter(reps)))
        self.signs = self.all.join(others, "key", "left_anti")
        self.sets = kept.mapInArrow(make, SETS)
        self._asked = lambda bits: rows.mapInArrow(_tokens(width, least_terms, bits), SETS)

    def links(self) -> DataFrame:
        """(a, b, na, nb, common): the links between different sets, each named by the least key of its texts."""
        t, context = self.similarity, self.sets.sparkSession.sparkContext
        cost = context.broadcast(cost_sketch(self.sets, self.all.agg(F.sum("n")).first()[0] or 0))
        pairs = (self._by_universe if self.method == "universe" else self._by_prefixes)(cost).repartition("a").distinct()
        for side in ("a", "b"):
            own = self.signs.select(F.col("key").alias(side), F.col("n").alias("n" + side), F.col("parity").alias("p" + side))
            pairs = pairs.join(own.hint("merge"), side)
        pairs = cut_lineage(pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_alike(t), "a long, b long, na int, nb int"))
        asked = context.broadcast(key_filter(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()))
        sets = self._asked(asked)
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("tokens").alias("t" + side)).hint("merge"), side)
        counted = pairs.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_overlaps, "a long, b long, na int, nb int, common long")
        # repeated rows give a link as often as they repeat
        return counted.filter(F.col("common") >= F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9).distinct()

    def _by_universe(self, cost) -> DataFrame:
        """(a, b): candidates by the partition of the universe, a the smaller set."""
        t = self.similarity
        kind = "sig long, key long, n int"
        narrow = self.sets.select("key", "n", "tokens")
        probes = cut_lineage(narrow.mapInArrow(_probe(t, cost), kind))
        asked = narrow.sparkSession.sparkContext.broadcast(bit_filter(probes.select(F.col("sig").alias("key"))))
        a, b = narrow.mapInArrow(_index(t, asked), kind).alias("a"), probes.alias("b")
        smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.key") < F.col("b.key")))
        met = b.hint("merge").join(a, (F.col("a.sig") == F.col("b.sig")) & smaller & (F.col("a.n") >= F.lit(t) * F.col("b.n") - 1e-9))
        return met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))

    def _by_prefixes(self, cost) -> DataFrame:
        """(a, b): candidates by the rarest tokens, a the smaller set."""
        t = self.similarity
        rows = self.sets.select("key", "n", "tokens").mapInArrow(_prefixes(cost, t), "token long, key long, np long, " + ", ".join(f"{w} long" for w in _WORDS))
        # size and place travel as one number through the exchange
        size = lambda side: F.shiftright(F.col(side + "np"), 32).cast("int")
        place = lambda side: F.col(side + "np").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        # `smaller` and `fits` together keep places of a below na - ceil(2t / (1 + t) na) + 1, all that the
        # smaller set needs; saying so in a filter would only make a second exchange of the same rows
        a, b = rows.alias("a"), rows.alias("b")
        na, nb = size("a."), size("b.")
        smaller = (na < nb) | ((na == nb) & (F.col("a.key") < F.col("b.key")))
        least = F.ceil(F.lit(t / (1 + t)) * (na + nb) - 1e-9)
        fits = (na >= F.lit(t) * nb - 1e-9) & (F.least(na - place("a."), nb - place("b.")) >= least)
        alike = _suffixes_differ(na) <= na - place("a.") + nb - place("b.") - 2 * least
        met = a.hint("merge").join(b, (F.col("a.token") == F.col("b.token")) & smaller & fits & alike)
        return met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))



def near_pairs(texts: DataFrame, similarity: float = 0.8, width: int = 5, least_terms: int = 0, expand: int = EXPAND) -> DataFrame:
    """(key_a, key_b), key_a < key_b: texts whose sets of runs are at least `similarity` alike. See Near.

    Texts with equal sets are one class. Classes of up to `expand` texts are written as all their pairs,
    and links to them as pairs with each text; a larger class is written as pairs of each text with the
    class's least key, and links to it as pairs with that key. No link between different sets is lost.
    Empty input, or input of nulls only, gives an empty result. Repeated rows make no pair of their own.
    """
    near = Near(texts, similarity, width, least_terms)
    links = near.links().select("a", "b")
    members = near.members
    small = members.filter(F.col("copies") <= expand)
    for side in ("a", "b"):
        copies = small.select(F.col("rep").alias(side), F.col("key").alias("copy"))
        links = links.join(copies, side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")
    x, y = small.alias("x"), small.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    stars = members.filter((F.col("copies") > expand) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("key").alias("b"))
    # links join different sets and members are distinct, so no pair comes twice
    every = links.unionByName(within).unionByName(stars)
    return every.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def _marks(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    hashes = (F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2))
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())


def _least(edges: DataFrame) -> DataFrame:
    """(w, m): the least neighbour of each node that has a lower one."""
    return edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node of each connected component of edges(a, b).

    Large-star and small-star in turn: first every node links its higher neighbours to the least of its
    neighbourhood, then its lower ones and itself. Edges are kept from the higher to the lower node, and are
    written out each round. It ends when a round changes nothing; then every edge leads to its component's
    least node. Any graph settles: the rounds grow with the logarithm of the nodes (a shuffled path of
    100,000 takes 15). Least neighbours are combined before the shuffle; a node with very many edges meets
    its one least neighbour in a join that adaptive execution splits on the side of the edges. Null nodes and
    loops are left out.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v")
    now = cut_lineage(now.distinct())
    before = None
    while (marks := _marks(now)) != before:
        before = marks
        large = now.join(_least(now).hint("merge"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = cut_lineage(large)
        least = _least(large)
        lower = large.join(least.hint("merge"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(lower.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots.select("node", F.col("node").alias("group")))


def near_groups(texts: DataFrame, similarity: float = 0.8, width: int = 5, least_terms: int = 0) -> DataFrame:
    """(key, group, copies, links), one row a text: groups of texts that chains of links connect.

    group is the least key of the group; copies the number of texts with the same set of runs, itself
    included; links the number of different sets that this one is linked to. Texts that take no part (null
    or too short) are groups of their own with copies 1 and links 0. Null keys are left out;
    repeated rows give one row. Exact copies are never paired: they share the row of their set. See Near.
    """
    near = Near(texts, similarity, width, least_terms)
    links = cut_lineage(near.links().select("a", "b"))
    found = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = found.join(degree, "node")
    rows = texts.select("key").filter("key is not null").distinct().join(near.members.hint("merge"), "key", "left")
    rows = rows.withColumns({"rep": F.coalesce("rep", "key"), "copies": F.coalesce("copies", F.lit(1))})
    joined = rows.join(named.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    return joined.select("key", F.coalesce("group", "rep").alias("group"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
