"""Texts cut off before their end: near-copies that go on, and closing-word terminality for the rest."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.mixture import source_key
from orrery.llm.shingles import FILTER, among, bit_filter, mix, runs_of
from orrery.llm.terms import terms
from orrery.runtime import cut_lineage, join_small, parallelism

#: Contexts of a word, and those of them that hold no word but frequent ones.
CONTEXTS, SKELETONS = 6, (0, 3, 5)
#: Terminality of an open tag, link, entity or half character: nothing ends there.
BROKEN = 1e-3
#: Words this frequent are kept in a sentence's skeleton; the others count by their kind only.
FRAME_WORDS = 80
#: Distinct words that a task counts before it passes their counts on.
HELD_WORDS = 200_000
#: Bands of the min-hash, each of ROWS values; last words tell candidates apart too, so bands are wide. At a similarity
#: of 0.8 all bands miss one pair in 3,500, at 0.65 (short texts with one edit) one in 70.
BANDS, ROWS = 8, 2
#: Words of a run that is hashed, and of the run at a text's end that its near-copies are asked for.
WIDTH, TAIL = 5, 3
#: How many last words may lie behind that run: none, half a word or a changed one, a few changed ones.
BEHIND = (0, 1, 2, 4)
#: Ratio of the lengths at which beginnings are hashed.
STEP = 2**0.5
#: Texts that a prior takes into account besides those it is counted from.
PSEUDO = 1.0
#: A word, with the mark behind it that its sentence goes on after.
_WORD = re.compile(r"[^\W_]+[,:;]?")
#: Where a sentence, paragraph, list item or table cell ends.
_CLOSE = re.compile(r"([.!?。…]+[\"'”’»)\]*_`]*(?=\s|$|[^\x00-\x7f])|[.!?。]+$|\n\s*(?:\n|[-*|>]|$))")
#: Endings that a closed text may have after its last sentence: quotes, brackets, emphasis, symbols.
_TRAIL = re.compile(r"[\s\"'”’»)\]*_\U0001F000-\U0001FAFF☀-➿️]+$")
_ENDED = re.compile(r"[.!?。！？]$")
_DOTS = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|(?:\.\.\.|…)(?:\s*\w+)?)$")
_MARKUP = re.compile(r"(?:<[A-Za-z/!][^<>\n]{0,200}|\[[^\]\n]{0,200}|\]\([^)\n]{0,300}|&[A-Za-z]{1,8})$")
_OPEN = re.compile(r"[,;:、(\[{/&–-]$")
_DECIMAL = re.compile(r"(?<![-\w])\d+\.$")  # a number that may go on behind its point
_TAG = re.compile(r"<[^<>]{0,200}>|&[A-Za-z]{2,8};")
_NONE = np.uint64(5)


def ending(text: str) -> tuple[str, str]:
    """How a text ends, and the text whose last words are to be judged.

    `empty`; `ended` (a final stop, or something else that closes: a bracket, a code fence, a table row, a
    symbol); and the open ones: `markup` (half a character, an open tag, link, entity, code fence or table
    row), `comma` (a mark that something must follow), `bracket`, `more`, `dots` (an ellipsis in brackets,
    before one more word, or bare), `plain`.
    """
    body = text.rstrip()
    if not body:
        return "empty", body
    if body[-1] == "�" or _MARKUP.search(body, max(0, len(body) - 400)) or body.count("```") % 2:
        return "markup", body
    dots = _DOTS.search(body, max(0, len(body) - 40))
    if dots:
        found = dots.group().strip()
        return ("bracket" if found[0] == "[" else "more" if found[-1].isalnum() else "dots"), body[: dots.start()]
    if _OPEN.search(body):
        return "comma", body
    line = body[body.rfind("\n") + 1 :]
    if body.endswith("```"):
        return "ended", body
    if line.lstrip().startswith("|"):
        return ("ended" if line.endswith("|") else "markup"), body
    core = _TRAIL.sub("", body[-400:])
    decimal = _DECIMAL.search(core)
    if not core or (_ENDED.search(core) and not decimal) or (core != body[-400:] and not core[-1].isalnum()):
        return "ended", body
    if body.endswith(")") and "(" in body[-400:-1]:
        return "ended", body
    return "plain", body[: len(body) - len(body[-400:]) + len(core)].rstrip(".") if decimal else body[: len(body) - len(body[-400:]) + len(core)]


class Lexicon(dict):
    """Numbers of words, with their hashes and their skeletons: a frequent word itself, of another its kind. Bounded."""

    def __init__(self, frame: set[str], most: int = 500_000):
        super().__init__()
        self.frame, self.most = frame, most
        self.exact: list[int] = []
        self.skeleton: list[int] = []
        self.kind: list[int] = []

    def __missing__(self, word: str) -> int:
        mark = ",:;".find(word[-1]) + 1
        lower = word[:-1].lower() if mark else word.lower()
        h = xxhash.xxh3_64_intdigest(lower)
        kind = 3 if word[0].isdigit() else 2 if word[0].isupper() else 1
        self[word] = at = len(self.exact)
        self.exact.append(h)
        self.kind.append(kind + 4 * mark)
        self.skeleton.append(h ^ mark if lower in self.frame else kind + 4 * mark)
        return at

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.exact, self.skeleton, self.kind = [], [], []
        at = np.array([self[w] for w in words], dtype=np.int64)
        return np.array(self.exact, dtype=np.uint64)[at], mix(np.array(self.skeleton, dtype=np.uint64))[at], mix(np.array(self.kind, dtype=np.uint64))[at]


class Read:
    """The words of many texts: which text each is of, whether a unit closes behind it, its hash and its skeleton."""

    def __init__(self, texts: list[str], lexicon: Lexicon):
        words: list[str] = []
        sizes, ends, opened, openers = [], [], [], []
        for text in texts:
            before = len(words)
            parts = _CLOSE.split(_TAG.sub(" ", text) if "<" in text or "&" in text else text)
            for i in range(0, len(parts), 2):
                if i and len(words) > before:
                    ends.append(len(words) - 1)
                opened.append(len(words))
                openers.append(0 if not i else ord(parts[i - 1][-1]) if parts[i - 1][-1] in "-*|>\n" else 1)
                words += _WORD.findall(parts[i])
            sizes.append(len(words) - before)
        self.words = words
        #: what a unit follows: nothing, a stop, a line end, the mark of a list, a quotation or a table
        self.opener = np.zeros(len(words) + 1, dtype=np.uint64)
        self.opener[opened] = openers
        self.sizes = np.array(sizes, dtype=np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.closes = np.zeros(len(words), dtype=bool)
        self.closes[ends] = True
        self.exact, self.skeleton, self.kind = lexicon(words) if words else (np.empty(0, np.uint64),) * 3
        self.last = np.zeros(len(words), dtype=bool)
        self.last[(self.first + self.sizes - 1)[self.sizes > 0]] = True

    def _before(self, values: np.ndarray, steps: int) -> np.ndarray:
        moved = np.concatenate([np.full(steps, _NONE), values])[: len(values)]
        same = np.concatenate([np.full(steps, -1), self.row])[: len(values)] == self.row
        return np.where(same, moved, _NONE)

    def contexts(self) -> np.ndarray:
        """(CONTEXTS, words): the unit so far as a skeleton, the last three words, two, their skeleton, the word, the unit's kinds of words."""
        n = len(self.exact)
        if not n:
            return np.empty((CONTEXTS, 0), np.uint64)
        # the skeletons of a unit, each turned by its place, are summed up
        begin = np.concatenate([[True], (self.closes | self.last)[:-1]])
        start = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        place = np.arange(n) - start
        units = []
        for values in (self.skeleton, self.kind):
            turned = mix(values + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            total = np.concatenate([[np.uint64(0)], np.cumsum(turned)])
            units.append(mix(total[1:] - total[start] + place.astype(np.uint64) + (self.opener[start] << np.uint64(32))))
        unit, shape = units[0], mix(units[1])
        one, two = self._before(self.skeleton, 1), self._before(self.skeleton, 2)
        pair = mix(mix(self._before(self.exact, 1)) + self.exact)
        return np.stack([unit, mix(mix(two) + pair), pair, mix(mix(two) + mix(one + self.skeleton) + self.skeleton), mix(self.exact), shape])

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, texts, places within the text) of all runs of `width` words."""
        found = runs_of(self.exact, width)
        whole = np.flatnonzero(self.row[: len(found)] == self.row[width - 1 :]) if len(found) else np.empty(0, np.int64)
        return found[whole], self.row[whole], whole - self.first[self.row[whole]]


def levels(most: int) -> list[int]:
    """The lengths, in runs, at which beginnings are hashed."""
    out, x = [], 4.0
    while round(x) <= most:
        out.append(round(x))
        x *= STEP
    return out


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)  # odd multipliers: each gives the runs another order


def bands(runs: np.ndarray, edges: np.ndarray, longest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(texts, keys): BANDS min-hash keys of the first runs of each text, at every level, or at its longest only.

    The runs of text i lie from edges[i] to edges[i + 1]. All texts are done at once: the least values
    between two levels first, then each level's and all below.
    """
    many = np.diff(edges)
    sizes = np.array(levels(int(many.max(initial=0))), dtype=np.int64)
    deep = np.searchsorted(sizes, many, side="right")
    total = int(deep.sum())
    if not total:
        return np.empty(0, np.int64), np.empty((0, BANDS), np.uint64)
    row = np.repeat(np.arange(len(many)), deep)
    first = np.cumsum(deep) - deep
    level = np.arange(total) - first[row]
    low = edges[row] + np.where(level > 0, sizes[level - 1], 0)
    # what lies behind a text's last level is a stretch of its own, of no use
    rest = edges[:-1] + np.where(deep > 0, sizes[np.maximum(deep - 1, 0)], 0)
    rest = rest[(rest < edges[1:]) | (deep == 0) & (many > 0)]
    starts = np.concatenate([low, rest])
    order = np.argsort(starts, kind="stable")
    least = np.empty((BANDS * ROWS, total), dtype=np.uint64)
    for i, seed in enumerate(_SEEDS):
        found = np.empty(len(starts), dtype=np.uint64)
        found[order] = np.minimum.reduceat(runs * seed, starts[order])
        least[i] = found[:total]
    for l in range(1, len(sizes)):  # noqa: E741
        at = first[deep > l] + l
        least[:, at] = np.minimum(least[:, at], least[:, at - 1])
    if longest:
        keep = (first + deep - 1)[deep > 0]
        row, level, least = row[keep], level[keep], least[:, keep]
    values = mix(least.reshape(BANDS, ROWS, -1) + np.arange(ROWS, dtype=np.uint64)[None, :, None])
    number = sizes[level].astype(np.uint64)[:, None] * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)[None, :]
    return row, mix(np.bitwise_xor.reduce(values, axis=1).T + number)


def _words(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, tail = terms(text), text.rstrip()[-40:]
                if words and (not _ENDED.search(tail) or _DOTS.search(tail)):
                    words.pop()  # it may be half a word, which would vouch for itself
                counts.update(words)
            if len(counts) > held:
                yield from flush()
        yield from flush()

    return run


def word_counts(texts: DataFrame, held: int = HELD_WORDS) -> DataFrame:
    """(word, n): every word of all texts and how often it occurs, without the last words of unended texts."""
    return texts.select("text").mapInArrow(_words(held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _begin(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in lengths:
                    if i >= len(word):
                        break
                    found[word[:i]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "longer"])

    return run


def pieces(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, own, longer) of the distinct words of asked(word): how often it occurs, and how often longer words begin with it. Exact."""
    asked = asked.select("word").filter("word is not null").distinct()
    lengths = sorted(r.length for r in asked.select(F.length("word").alias("length")).distinct().collect())  # a few
    begins = counts.select("word", "n").mapInArrow(_begin(lengths), "word string, longer long").groupBy("word").agg(F.sum("longer").alias("longer"))
    found = asked.join(counts.select("word", F.col("n").alias("own")).hint("merge"), "word", "left").join(begins.hint("merge"), "word", "left")
    return found.select("word", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("longer", F.lit(0)).alias("longer"))


ASKED = "doc_id long, source string, chars int, ending string, sig long, contexts array<long>, word string, bands array<long>, tails array<long>"


def _endings(shared):
    """Every text's ending; of open ones also their last contexts, last word and the keys that near-copies must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            docs, sources, texts = (c.to_pylist() for c in batch.columns)
            found = [ending(t) for t in texts]
            asked = [i for i, (kind, _) in enumerate(found) if kind not in ("ended", "empty")]
            own, last, own_bands, own_tails = ([None] * len(texts) for _ in range(4))
            read = Read([found[i][1] for i in asked], lexicon)
            contexts = read.contexts()
            runs, row, _ = read.runs(WIDTH)
            banded, keys = bands(runs, np.searchsorted(row, np.arange(len(asked) + 1)), longest=True)
            for at, key in zip(banded.tolist(), keys.view(np.int64).tolist(), strict=True):
                own_bands[asked[at]] = key
            for i, first, size in zip(asked, read.first.tolist(), read.sizes.tolist(), strict=True):
                if not size:
                    continue
                own[i] = contexts[:, first + size - 1].view(np.int64).tolist()
                word = read.words[first + size - 1].lower().rstrip(",:;")
                if word.isalpha() and "://" not in found[i][1].split()[-1]:
                    last[i] = word
                exact = read.exact[first : first + size]
                if own_bands[i] is not None:
                    tails = runs_of(exact[-TAIL - max(BEHIND) :], TAIL).view(np.int64)
                    own_tails[i] = [int(tails[-1 - b]) for b in BEHIND if b < len(tails)]
            sigs = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
            out = [docs, sources, [len(t.rstrip()) for t in texts], [k for k, _ in found], sigs, own, last, own_bands, own_tails]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "source", "chars", "ending", "sig", "contexts", "word", "bands", "tails"])

    return run


#: What the second reading finds: of a context how often it occurs and a unit ends behind it; of an asked band a text that has it.
FOUND = "kind int, key long, sig long, doc_id long, seen long, closed long"


def _survey(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, contexts, banded = shared.value
        lexicon = Lexicon(frame)
        for batch in batches:
            docs, texts = (c.to_pylist() for c in batch.columns)
            read = Read(texts, lexicon)
            keys = read.contexts()
            if not len(read.row):
                continue
            # how the last word of an open text ends is what is asked
            told = read.closes | ~read.last
            closing = np.tile(read.closes[told], CONTEXTS)
            keys = keys[:, told].ravel()
            asked = np.flatnonzero(among(contexts, keys))
            found, which, seen = np.unique(keys[asked], return_inverse=True, return_counts=True)
            closed = np.bincount(which[closing[asked]], minlength=len(found))
            none = np.zeros(len(found), dtype=np.int64)
            columns = [(np.zeros(len(found), np.int32), found.view(np.int64), none, none, seen.astype(np.int64), closed.astype(np.int64))]
            runs, row, _ = read.runs(WIDTH)
            which, every = bands(runs, np.searchsorted(row, np.arange(len(texts) + 1)))
            hits = np.flatnonzero(among(banded, every.ravel()))
            who = np.repeat(which, BANDS)[hits]
            sigs = {i: xxhash.xxh3_64_intdigest(texts[i]) - (1 << 63) for i in np.unique(who).tolist()}
            one, zero = np.ones(len(hits), dtype=np.int32), np.zeros(len(hits), dtype=np.int64)
            sig = np.array([sigs[i] for i in who.tolist()], dtype=np.int64)
            columns.append((one, every.ravel()[hits].view(np.int64), sig, np.array(docs, dtype=np.int64)[who], zero, zero))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["kind", "key", "sig", "doc_id", "seen", "closed"])

    return run


def survey(texts: DataFrame, frame: set[str], contexts: DataFrame, banded: DataFrame, most: int = FILTER) -> DataFrame:
    """FOUND for the distinct asked keys contexts(key) and banded(key), over all texts(doc_id, text), read once.

    Counts are exact (up to 64-bit hashes): bit filters of the asked keys go to the tasks, so that few
    others are passed on; those find no partner later. Equal texts count as one for bands.
    """
    shared = texts.sparkSession.sparkContext.broadcast((frame, bit_filter(contexts, most), bit_filter(banded, most, 64)))
    found = texts.select("doc_id", "text").mapInArrow(_survey(shared), FOUND)
    return found.groupBy("kind", "key", "sig").agg(F.min("doc_id").alias("doc_id"), F.sum("seen").alias("seen"), F.sum("closed").alias("closed"))


def _tails(shared):
    """(band, tail, sig, doc_id): the runs of a text's last words that are asked for, with each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bits = Lexicon(set()), shared.value
        for batch in batches:
            docs, sigs, own, texts = (batch.column(c).to_pylist() for c in ("doc_id", "sig", "own", "text"))
            runs, row, _ = Read(texts, lexicon).runs(TAIL)
            keep = np.flatnonzero(among(bits, runs)) if len(runs) else np.empty(0, np.int64)
            out: list[tuple] = []
            for tail, i in set(zip(runs[keep].view(np.int64).tolist(), row[keep].tolist(), strict=True)):
                out.extend((band, tail, sigs[i], docs[i]) for band in own[i])
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["band", "tail", "sig", "doc_id"])

    return run


def candidates(texts: DataFrame, opened: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, answers), each (key, sig, doc_id): open texts and those that share a band and a run of their last words.

    opened(sig, doc_id, bands, tails); met(key, sig, doc_id): who has which band. Only bands that different
    texts have are looked at, and only the texts that have them are read again.
    """
    own = opened.filter("bands is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("tails").alias("tails"))
    own = cut_lineage(own.select("sig", "doc_id", F.explode("bands").alias("band"), "tails"))
    met = met.join(own.select(F.col("band").alias("key")).distinct().hint("merge"), "key", "left_semi")
    shared = met.groupBy(F.col("key").alias("band")).agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("band")
    shared = cut_lineage(shared)
    asked = cut_lineage(own.join(shared.hint("merge"), "band").select("band", F.explode("tails").alias("tail"), "sig", "doc_id"))
    holders = met.withColumnRenamed("key", "band").join(shared.hint("merge"), "band").groupBy("doc_id", "sig").agg(F.collect_set("band").alias("own"))
    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(asked.select(F.col("tail").alias("key")).distinct(), each=64))
    answers = holders.join(texts.select("doc_id", "text").hint("merge"), "doc_id").mapInArrow(_tails(bits), "band long, tail long, sig long, doc_id long")
    keyed = lambda df: df.select(F.xxhash64("band", "tail").alias("key"), "sig", "doc_id")
    return keyed(asked), keyed(answers).distinct()


def align(a: np.ndarray, b: np.ndarray, width: int = TAIL) -> tuple[int, int, float]:
    """(i, j, share): the longest chain of common runs of two word lists ends behind word i of a and j of b.

    share is how much of a's words up to i the chain covers. Runs are matched exactly and chained in order (a
    longest increasing subsequence), so the work grows with n log n of the texts, whatever lies between.
    """
    left, right = runs_of(a, width), runs_of(b, width)
    if not len(left) or not len(right):
        return 0, 0, 0.0
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    tops: list[int] = []
    at: list[tuple[int, int]] = []
    back: list[int] = []
    held: list[int] = []
    for i, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        # of a run that is very frequent in b, the places about the diagonal are looked at
        places = order[x:y] if y - x <= 16 else order[x:y][np.argsort(np.abs(order[x:y] - i), kind="stable")[:16]]
        for j in sorted(places.tolist(), reverse=True):
            k = bisect_left(tops, j)
            if k == len(tops):
                tops.append(j)
                held.append(len(at))
            else:
                tops[k], held[k] = j, len(at)
            back.append(held[k - 1] if k else -1)
            at.append((i, j))
    if not at:
        return 0, 0, 0.0
    k, chain = held[-1], []
    while k >= 0:
        chain.append(at[k])
        k = back[k]
    i, j = chain[0]
    covered = np.zeros(len(a), dtype=bool)
    for x, _ in chain:
        covered[x : x + width] = True
    return i + width, j + width, float(covered[: i + width].mean())


def ends_early(short: str, long: str, lexicon: Lexicon | None = None, similarity: float = 0.8) -> int:
    """1 if `short` stops inside a sentence where its near-copy `long` goes on; -1 if both end alike; else 0.

    Near-copies: at least `similarity` of the runs of five words of the shorter one are in the other, and
    the alignment covers as much of its words.
    """
    lexicon = Lexicon(set()) if lexicon is None else lexicon
    read = Read([ending(short)[1], long], lexicon)
    n, m = read.sizes.tolist()
    a, b = read.exact[:n], read.exact[n:]
    left, right = np.unique(runs_of(a, WIDTH)), np.unique(runs_of(b, WIDTH))
    if not len(left) or len(np.intersect1d(left, right, assume_unique=True)) < similarity * len(left):
        return 0
    i, j, share = align(a, b)
    rest = n - i
    if share < similarity or rest > max(BEHIND):
        return 0
    closes = read.closes[n:]
    if rest:
        half = read.words[n - 1].lower().rstrip(",:;")
        # half a word, behind as many words as here; or the same number of changed words
        at = j + rest - 1
        if at >= m:
            return 0
        word = read.words[n + at].lower()
        if rest == 1 and word != half and word.startswith(half):
            return 1
        j = at + 1
        if j >= m:
            return 0
        return 0 if closes[j - 1] else 1
    if j >= m:
        return -1
    return 0 if closes[j - 1] else 1


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(set())
    for batch in batches:
        short, long = (batch.column(c).to_pylist() for c in ("text", "other_text"))
        yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([ends_early(s, x, lexicon) for s, x in zip(short, long, strict=True)], pa.int32())], ["sig", "cut"])


def cut_copies(texts: DataFrame, asked: DataFrame, answers: DataFrame, step: int = 4) -> DataFrame:
    """(sig): the asked texts that stop inside a sentence where a near-copy goes on.

    asked(key, sig, doc_id) and answers(key, sig, doc_id): texts that share a band and the last words of the
    asked one. Equal texts are one (sig; doc_id names one of them). The answers to a key are taken in
    rounds, each of `step` times as many, until one settles the asked text or none is left: no partner
    is left out, and a text with very many is rarely compared with all of them.
    """
    asked = cut_lineage(asked.distinct())
    answers = answers.join(asked.select("key").distinct().hint("merge"), "key", "left_semi")
    order = Window.partitionBy("key").orderBy("sig")
    answers = answers.select("key", F.col("sig").alias("other"), F.col("doc_id").alias("other_id"), F.row_number().over(order).alias("place"))
    # one answer to itself is no answer
    many = answers.groupBy("key").agg(F.max("place").alias("most"))
    answers = cut_lineage(answers)
    asked = cut_lineage(asked.join(many.filter("most > 1").hint("merge"), "key"))
    found, done, size = None, 0, step
    while asked.filter(F.col("most") > done).limit(1).count():
        turn = answers.filter((F.col("place") > done) & (F.col("place") <= done + size))
        pairs = asked.join(turn.hint("merge"), "key").filter("other <> sig").groupBy("sig", "other").agg(F.min("doc_id").alias("doc_id"), F.min("other_id").alias("other_id"))
        pairs = pairs.join(texts.select("doc_id", "text").hint("merge"), "doc_id").select("sig", "text", "other_id")
        pairs = pairs.join(texts.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text")).hint("merge"), "other_id")
        settled = pairs.repartition(parallelism(texts.sparkSession)).mapInArrow(_aligned, "sig long, cut int").filter("cut = 1")
        settled = cut_lineage(settled.select("sig").distinct())
        found = settled if found is None else found.unionByName(settled)
        asked = cut_lineage(asked.join(settled.hint("merge"), "sig", "left_anti"))
        done, size = done + size, size * step
    return found if found is not None else asked.select("sig").limit(0)


def terminality(opened: DataFrame, counts: DataFrame, base: float) -> DataFrame:
    """(contexts, terminality) of the distinct contexts of opened(sig, contexts): how likely a unit ends behind these words.

    counts(key, seen, closed) of each context. From the word alone to the whole unit so far, each context's
    share is drawn towards that of the last one as by PSEUDO + 1 texts. A unit also ends where an open text
    does: other texts that end with the same skeleton count (each different text once), with the same words
    do not, since pieces of words are found nowhere else.
    """
    each = opened.filter("contexts is not null").groupBy("contexts").agg(F.count_distinct("sig").alias("texts")).select("contexts", "texts", F.posexplode("contexts").alias("t", "key"))
    ends = each.filter(F.col("t").isin(*SKELETONS)).groupBy("key").agg(F.sum("texts").alias("ends"))
    found = join_small(each.drop("texts"), counts.select("key", "seen", "closed"), ["key"], ["contexts"], "left")
    found = join_small(found, ends, ["key"], ["contexts"], "left").withColumn("ends", F.coalesce(F.col("ends") - 1, F.lit(0)))
    pick = lambda c, t: F.coalesce(F.max(F.when(F.col("t") == t, F.coalesce(c, F.lit(0)) + F.col("ends"))), F.lit(0)).alias(f"{c}{t}")
    found = found.groupBy("contexts").agg(*(pick(c, t) for c in ("seen", "closed") for t in range(CONTEXTS)))
    rate: Column = F.lit(base)
    for t in (4, 3, 2, 1, 5, 0):
        rate = (F.col(f"closed{t}") + (PSEUDO + 1) * rate) / (F.col(f"seen{t}") + (PSEUDO + 1))
    return found.select("contexts", rate.alias("terminality"))


def _odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def with_priors(rows: DataFrame, base: float) -> DataFrame:
    """rows with `odds`: log odds that the text is cut, by its terminality and by priors of its source, ending and length.

    rows(source, chars, ending, terminality, own, longer, ...). A whole text ends at a unit's end, as
    likely behind a word as that is terminal (t); a cut falls anywhere. Two of its places leave a word whole
    that goes on, before and after its space, one a word that only lacks its stop, and one leaves it a piece, as
    much likelier as longer words occur oftener than the word itself. The priors are the shares of cut texts among the others of the same source, the same ending and, within a source, the same length (or
    up to three characters more, which trimming may take off), estimated twice: first without, then with
    priors. A field limit shows as a length at which most texts are cut. Nothing is tuned; each share counts
    PSEUDO texts of the wider one.
    """
    t = F.col("terminality")
    likely = F.log((1 - t / 2 + F.col("longer") / (2 * F.col("own") + PSEUDO)) / t) + float(np.log(base / (1 - base)))
    rows = cut_lineage(rows.withColumn("likely", likely).withColumn("odds", F.col("likely")))
    share = 1 / (1 + F.exp(-F.col("odds")))
    for _ in range(2):
        each = rows.withColumn("p", share)
        whole = each.agg(F.avg("p")).first()[0]
        if whole is None:
            return rows
        whole = min(max(whole, 1e-6), 1 - 1e-6)
        rate = lambda p, n, wide: (p + PSEUDO * wide) / (n + PSEUDO)
        cells = each.groupBy("source", "chars").agg(F.sum("p").alias("cp"), F.count(F.lit(1)).alias("cn"))
        near = Window.partitionBy("source").orderBy("chars").rangeBetween(0, 3)
        cells = cells.withColumns({"cp": F.sum("cp").over(near), "cn": F.sum("cn").over(near)}).withColumn("sk", F.coalesce("source", F.lit("\0"))).drop("source")
        sources = each.groupBy(F.coalesce("source", F.lit("\0")).alias("sk")).agg(F.sum("p").alias("sp"), F.count(F.lit(1)).alias("sn"))
        kinds = each.groupBy("ending").agg(F.sum("p").alias("kp"), F.count(F.lit(1)).alias("kn"))
        each = join_small(each.withColumn("sk", F.coalesce("source", F.lit("\0"))), sources, ["sk"], ["doc_id"])
        each = join_small(each, cells, ["sk", "chars"], ["doc_id"])
        each = each.join(F.broadcast(kinds), "ending")  # half a dozen
        own = F.col("p")
        by_source = rate(F.col("sp") - own, F.col("sn") - 1, F.lit(whole))
        by_kind = rate(F.col("kp") - own, F.col("kn") - 1, F.lit(whole))
        by_length = rate(F.col("cp") - own, F.col("cn") - 1, by_source)
        bounded = lambda r: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), r))
        odds = F.col("likely") + _odds(bounded(by_length)) + _odds(bounded(by_kind)) - float(np.log(whole / (1 - whole)))
        rows = cut_lineage(each.withColumn("odds", odds).select(*rows.columns))
    return rows


def truncations(documents: DataFrame, frame: int = FRAME_WORDS) -> DataFrame:
    """(doc_id, source, ending, terminality, copy, odds, truncated) of every document with a text.

    documents(doc_id BIGINT unique, text, source). Null or blank texts are not truncated; null texts and
    ids are left out; repeated rows are documents of their own; a null source is a source. The text's
    ending is read first (see ending()). For texts that do not end in a stop:

    - near-copies: a text meets those that share a min-hash band over runs of five words and its last words.
      Bands are taken over the beginnings of texts at lengths that grow by the square root of two, up to the
      whole text, so that a text meets the copies that go on however much of them it lacks. Pairs of which 0.8
      of the shorter one's runs are in the other are aligned (see ends_early()); a text that ends
      inside a sentence, or a word, where a partner goes on is cut (copy = 1).
    - the others: terminality is how often a sentence, line or text ends behind such words, counted over all
      documents (the unit's skeleton and kinds of words, the last three, two and one words). It is weighed with how often the last
      word is the beginning of others and with priors of the source, the ending and the length; see
      with_priors().

    Extra columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source"), "text").filter("doc_id is not null and text is not null")
    every = cut_lineage(word_counts(rows))
    words = {r.word for r in every.orderBy(F.desc("n"), "word").limit(frame).collect()}
    judged = cut_lineage(rows.mapInArrow(_endings(spark.sparkContext.broadcast(words)), ASKED))
    is_open = ~F.col("ending").isin("ended", "empty")
    opened = judged.filter(is_open)
    asked = cut_lineage(opened.filter("contexts is not null").select("contexts").distinct())
    banded = opened.filter("bands is not null").select(F.explode("bands").alias("key")).distinct()
    found = cut_lineage(survey(rows, words, asked.select(F.explode("contexts").alias("key")).distinct(), banded))
    copies = cut_copies(rows, *candidates(rows, opened, found.filter("kind = 1").select("key", "sig", "doc_id")))

    totals = every.agg(F.sum("n")).first()[0] or 0
    ends = judged.filter("ending <> 'empty'").count()
    counts = found.filter("kind = 0")
    rate = counts.agg(F.sum("closed") / F.sum("seen")).first()[0] if totals else None
    base = min(max(rate if rate is not None else 0.5, 1e-3), 1 - 1e-3) if ends else 0.5
    scored = opened.drop("bands", "tails")
    scored = join_small(scored, cut_lineage(terminality(opened, counts, base)), ["contexts"], ["doc_id"], "left").fillna(base, ["terminality"])
    scored = scored.withColumn("terminality", F.when(F.col("ending") == "markup", F.lit(BROKEN)).otherwise(F.col("terminality")))
    scored = join_small(scored, cut_lineage(pieces(opened, every)), ["word"], ["doc_id"], "left").fillna(0, ["own", "longer"])
    scored = with_priors(scored.select("doc_id", "source", "chars", "ending", "sig", "terminality", "own", "longer"), base)
    copies = copies.withColumn("copy", F.lit(1))
    scored = join_small(scored, cut_lineage(copies), ["sig"], ["doc_id"], "left")
    scored = scored.select("doc_id", "source", "ending", "terminality", "copy", "odds", ((F.coalesce("copy", F.lit(0)) == 1) | (F.col("odds") > 0)).alias("truncated"))
    closed = judged.filter(~is_open).select("doc_id", "source", "ending", *(F.lit(None).cast(t).alias(c) for c, t in (("terminality", "double"), ("copy", "int"), ("odds", "double"))), F.lit(False).alias("truncated"))
    return scored.unionByName(closed)


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, share): how often each source truncates. See truncations()."""
    found = truncations(documents).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("int")).alias("truncated"))
    return found.withColumn("share", F.col("truncated") / F.col("documents"))
