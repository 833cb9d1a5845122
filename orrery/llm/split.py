"""Splitting oversized texts at natural boundaries by pointer doubling over successor tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.runtime import join_small

#: Bytes of text whose tables are built at once. A longer text is done alone.
BATCH_BYTES = 2_000_000
KINDS = ("end", "paragraph", "sentence", "word", "character")
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[0x2E, 0x21, 0x3F]] = True  # . ! ?
PIECES = "start long, stop long, piece string, kind string"


def reachable(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which positions the chains from `first` visit, by squaring the successor table.

    After round r the marks hold every position within 2^r steps, and the table leads 2^r steps
    on, so all cuts of all texts come out in log2(longest chain) rounds. A last position is its own
    successor.
    """
    mark = np.zeros(len(successor), dtype=bool)
    mark[first] = True
    found = 0
    while (now := int(mark.sum())) != found:
        found = now
        mark[successor[np.flatnonzero(mark)]] = True
        successor = successor[successor]
    return mark


def cuts(data: np.ndarray, offsets: np.ndarray, limit: np.ndarray, overlap: np.ndarray):
    """Greedy pieces of the texts data[offsets[t]:offsets[t+1]] (UTF-8), as (text, start, stop, kind).

    A boundary is the place before or after a separator: space, tab, line feed, carriage return or
    the ideographic full stop. The best boundary of a piece is a paragraph's end (after an empty
    line), else a sentence's, each only if it lies in the last half of the room and beyond the
    overlap; else the farthest boundary at all; else, within a stretch longer than the limit, the
    farthest character. The next piece begins at the first place at or after stop - overlap from
    which the following boundary can be reached.
    """
    size = len(data)
    n = len(offsets) - 1
    space = SPACE[data]
    ideographic = np.zeros(size, dtype=bool)
    if size > 2:
        ideographic[:-2] = (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)
    after_ideographic = np.zeros(size + 1, dtype=bool)
    after_ideographic[3:] = ideographic[: size - 2] if size > 2 else False
    natural = np.zeros(size + 1, dtype=bool)
    natural[:size] |= space | ideographic
    natural[1:] |= space
    natural |= after_ideographic
    natural[offsets] = True
    # sentences end after . ! ? and separators behind it, or after the ideographic stop; paragraphs after two line feeds
    feed = data == 0x0A
    paragraph = np.zeros(size + 1, dtype=bool)
    if size > 1:
        paragraph[2:] = feed[1:] & feed[:-1]
        paragraph[3:] |= feed[2:] & (data[1:-1] == 0x0D) & feed[:-2]
    sentence = after_ideographic.copy()
    if size > 1:
        sentence[2:] |= space[1:] & STOP[data[:-1]]
    sentence |= paragraph
    where = np.flatnonzero(natural)
    # characters count as places only inside stretches that are longer than the limit
    text_of = np.searchsorted(offsets, where[:-1], side="right") - 1
    gap = np.diff(where)
    long = np.flatnonzero(gap > limit[np.minimum(text_of, n - 1)]) if n else np.empty(0, np.int64)
    inside = [where[:0]]
    for g in long:
        a, b = where[g], where[g + 1]
        inside.append(a + 1 + np.flatnonzero((data[a + 1 : b] & 0xC0) != 0x80))
    place = np.sort(np.concatenate([where, *inside])) if len(long) else where
    m = len(place)
    is_natural = natural[place]
    text = np.searchsorted(offsets, place, side="right") - 1
    end_place = np.searchsorted(place, offsets[1:])
    first_place = np.searchsorted(place, offsets[:-1])
    text = np.minimum(text, n - 1)
    room, share = limit[text], overlap[text]
    stop_at = end_place[text]
    index = np.arange(m)

    def last(of: np.ndarray) -> np.ndarray:
        """For each place, the index of the last place at or before it that is marked; -1 if none."""
        return np.maximum.accumulate(np.where(of, index, -1))

    # farthest legal end of a piece that begins at each place
    far = np.minimum(np.searchsorted(place, place + room, side="right") - 1, stop_at)
    least = place + np.maximum(room // 2, share)
    end = last(is_natural)[far]
    end = np.where(place[np.maximum(end, 0)] > place, end, far)
    best = np.where(is_natural[end], 3, 4)
    for mark, kind in ((sentence, 2), (paragraph, 1)):
        candidate = last(mark[place])[far]
        good = (candidate >= 0) & (place[np.maximum(candidate, 0)] > least)
        end = np.where(good, candidate, end)
        best = np.where(good, kind, best)
    done = far == stop_at
    end = np.where(done, stop_at, end)
    best = np.where(done, 0, best)
    stuck = (end <= index) & (index < stop_at)  # one character above the limit
    end = np.where(stuck, np.minimum(index + 1, stop_at), end)
    # where the piece after one that ends at each place begins
    later = np.where(is_natural, index, m - 1)
    next_natural = np.minimum.accumulate(later[::-1])[::-1]
    following = np.minimum(next_natural[np.minimum(index + 1, m - 1)], stop_at)
    reach = place[following] - place
    before = last(is_natural)
    back = np.searchsorted(place, np.maximum(place - share, place[following] - room), side="left")
    inner = np.searchsorted(place, np.maximum(place - share, place[before]), side="left")
    start = np.where(reach <= room, back, np.where(is_natural, index, inner))
    start = np.clip(start, first_place[text], index)
    following_start = start[end]
    successor = np.where(end == stop_at, stop_at, np.where(following_start > index, following_start, end))
    used = np.flatnonzero(reachable(successor, first_place))
    used = used[used < stop_at[used]]
    return text[used], place[used], place[end[used]], best[used]


def _split(carry: list[str], text: str, limit: str, overlap: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
            total = np.cumsum(size)
            a = 0
            while a < batch.num_rows:
                base = total[a] - size[a]
                b = max(a + 1, int(np.searchsorted(total, base + BATCH_BYTES, side="right")))
                part = batch.slice(a, b - a)
                raw = part.column(text).cast(pa.large_binary())
                joined = b"".join(raw.to_pylist())
                offsets = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int64)
                room = part.column(limit).to_numpy().astype(np.int64)
                share = np.clip(part.column(overlap).fill_null(0).to_numpy().astype(np.int64), 0, np.maximum(room - 5, 0))
                t, start, stop, kind = cuts(np.frombuffer(joined, dtype=np.uint8), offsets, room, share)
                out = {c: part.column(c).take(pa.array(t)) for c in carry}
                out |= {"start": pa.array(start - offsets[t]), "stop": pa.array(stop - offsets[t])}
                if keep_text:
                    out["piece"] = pa.array([joined[x:y].decode() for x, y in zip(start.tolist(), stop.tolist(), strict=True)])
                out["kind"] = pa.array(np.array(KINDS)[kind])
                yield pa.RecordBatch.from_pydict(out)
                a = b

    return run


def split_texts(rows: DataFrame, text: str, limit: Column | int, overlap: Column | int, carry: list[str], keep_text: bool = True) -> DataFrame:
    """Pieces of every text above its limit: (*carry, start, stop, piece, kind), by byte positions.

    limit and overlap are in UTF-8 bytes. Each piece has at most `limit` bytes, begins and ends
    between characters, and shares about `overlap` bytes with the one before (the overlap is lessened
    where the text beyond it could not be reached otherwise, and to the limit less 5). Pieces cover
    the text. kind says where the piece ends: `paragraph`, `sentence`, `word`, `character` (inside a
    stretch longer than the limit), or `end`. Texts that are null or not above the limit, and rows
    whose limit is null, give no pieces; the limit must be at least 4, a character's greatest size.
    A null overlap is none. Without keep_text the pieces' text is left out. Carried columns must not
    be named start, stop, piece or kind.
    """
    spark = rows.sparkSession
    limit = F.lit(limit) if isinstance(limit, int) else limit
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    taken = rows.select(*carry, F.col(text).alias("__text"), limit.cast("int").alias("__limit"), overlap.cast("int").alias("__overlap"))
    taken = taken.filter((F.octet_length("__text") > F.col("__limit")) & (F.col("__limit") >= 4))
    names = ["start long", "stop long", *(["piece string"] if keep_text else []), "kind string"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.select(*carry).schema.fields), *names])
    return taken.mapInArrow(_split(carry, "__text", "__limit", "__overlap", keep_text), schema)


def split_documents(records: DataFrame, collections: DataFrame, keep_text: bool = True) -> DataFrame:
    """Pieces of records.document by the limits of their collections: (rowid, start, stop[, piece], kind).

    records(rowid, collection_id, document); collections(collection_id, chunk_limit, chunk_overlap).
    Records without a collection, or of one without a limit, have no pieces. See split_texts().
    """
    limits = collections.select("collection_id", "chunk_limit", "chunk_overlap").filter("chunk_limit is not null").dropDuplicates(["collection_id"])
    rows = records.select("rowid", "collection_id", "document").filter("document is not null")
    joined = join_small(rows, limits, ["collection_id"], ["rowid"])
    return split_texts(joined, "document", F.col("chunk_limit"), F.col("chunk_overlap"), ["rowid"], keep_text)


def cut_kinds(records: DataFrame, collections: DataFrame) -> DataFrame:
    """(rowid, cut) of every record with pieces: `forced` if one ends inside a word, else `natural`."""
    pieces = split_documents(records, collections, keep_text=False)
    forced = F.max(F.when(F.col("kind") == "character", 1).otherwise(0))
    return pieces.groupBy("rowid").agg(F.when(forced == 1, "forced").otherwise("natural").alias("cut"))
