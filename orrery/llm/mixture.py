"""Mixing sources to target weights by entropy balancing with distributed Newton steps."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.terms import terms
from orrery.runtime import BROADCAST_ROWS, at_most, cut_lineage, join_small

#: Documents of one source and size that are ranked in one task, on average.
LOT_ROWS = 50_000


def source_key(column: str = "source") -> Column:
    """A source as it is compared: without outer white space, in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


@cache
def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, size): source as compared; size in tokens of the vocabulary file, or in terms.

    documents(doc_id, source, text). A null text has size 0. vocabulary is the path of a byte-pair rank
    file, the same on every worker. Whole texts are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if vocabulary:
                encode = _encoder(vocabulary).encode_ordinary
                size = [len(encode(t)) if t else 0 for t in texts]
            else:
                size = [len(terms(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64())], ["doc_id", "source", "size"])

    rows = documents.select(F.col("doc_id").cast("long"), source_key().alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, size long")


class Mixture:
    """A mixture of documents in which each source holds its weight of the total size.

    documents(doc_id BIGINT, source, text); targets(source, weight DOUBLE, max_repeats INT), one row a
    source, compared as source_key(). The budget is the size of all documents, those of null or
    unlisted sources included; they are not used themselves. A source's goal is weight * budget, or
    what max_repeats uses of all its documents yield, if that is less (it is then `short`). Targets
    with a null source, weight or max_repeats, a weight not above 0 or max_repeats below 0 are left out.

    Each document gets a rate: the rates nearest to one use each, in relative entropy, that meet the
    goals. The dual is convex with one multiplier a source, and the rate of a document of size t is
    min(max_repeats, exp(lambda * t / mean)). As it depends on source and size only, the documents are
    first gathered to a table of (source, size, documents), on which each Newton step is one
    aggregation over all sources at once; a bracket keeps steps that overshoot in place. A source whose
    dual has no finite solution, since all copies together stay below its weight, is found in the first
    step: it is short and uses max_repeats of each. Rates become whole copies by cumulative rounding over
    the sizes of a source, spread over its documents by hash, so the sum is met up to about one
    document. Documents of size 0 are not used.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, rounds: int = 60, precision: float = 1e-9):
        self.spark = documents.sparkSession
        self.sized = cut_lineage(sizes(documents, vocabulary))
        good = targets.filter("source is not null and weight > 0 and max_repeats >= 0")
        named = good.select(source_key().alias("source"), F.col("weight").cast("double"), F.col("max_repeats").cast("int"))
        named = named.groupBy("source").agg(F.min(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.*")
        cells = self.sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("documents"))
        self.cells = cut_lineage(cells.withColumn("mass", F.col("size") * F.col("documents")))
        self.total = self.cells.agg(F.sum("mass")).first()[0] or 0
        per = self.cells.filter("source is not null").groupBy("source").agg(F.sum("mass").alias("available"), F.sum("documents").alias("documents"), F.max("size").alias("longest"))
        goals = named.join(per, "source", "left").fillna(0, ["available", "documents", "longest"])
        self.goals = goals.withColumn("wanted", F.col("weight") * F.lit(float(self.total)))
        self.rounds, self.precision = rounds, precision
        self._solved: DataFrame | None = None

    def multipliers(self) -> DataFrame:
        """(source, weight, max_repeats, ..., wanted, goal, short, unit, multiplier) after Newton's iteration; multiplier null where all copies are used."""
        if self._solved is None:
            self._solved = self._solve()
        return self._solved

    def _solve(self) -> DataFrame:
        unit = F.when(F.col("available") > 0, F.col("available") / F.col("documents")).otherwise(F.lit(1.0))
        none = F.lit(None).cast("double")
        state = self.goals.withColumns({"unit": unit, "low": none, "high": none, "multiplier": F.lit(0.0), "goal": F.col("wanted"), "short": F.lit(False)})
        state = cut_lineage(state.withColumn("open", F.col("wanted") > 0))
        cells = self.cells.filter("size > 0")
        narrow = at_most(state, BROADCAST_ROWS)  # one row a source, in every step
        for _ in range(self.rounds):
            x = F.col("size") / F.col("unit")
            power = F.least(F.col("multiplier") * x, F.lit(700.0))
            rate = F.least(F.exp(power), F.col("max_repeats").cast("double"))
            slope = F.when(F.exp(power) < F.col("max_repeats"), rate * x).otherwise(F.lit(0.0))
            asked = state.filter("open").select("source", "unit", "multiplier", "max_repeats", "wanted")
            joined = cells.join(F.broadcast(asked), "source") if narrow else join_small(cells, asked, ["source"], ["size"])
            sums = joined.groupBy("source").agg(F.sum(rate * F.col("mass")).alias("got"), F.sum(slope * F.col("mass")).alias("slope"), F.sum(F.col("max_repeats") * F.col("mass")).alias("most"))
            state = state.join(sums, "source", "left").fillna(0, ["got", "slope", "most"])
            # the dual has no finite solution where all copies together stay below the goal
            state = state.withColumn("never", F.col("open") & (F.col("most") < F.col("wanted")))
            state = state.withColumns({
                "goal": F.when(F.col("never"), F.col("most").cast("double")).otherwise(F.col("goal")), "short": F.col("short") | F.col("never"), "open": F.col("open") & ~F.col("never"),
            }).drop("never")
            gap = F.col("got") - F.col("goal")
            near = F.abs(gap) <= F.col("goal") * self.precision
            low = F.when(F.col("open") & (gap < 0), F.col("multiplier")).otherwise(F.col("low"))
            high = F.when(F.col("open") & (gap > 0), F.col("multiplier")).otherwise(F.col("high"))
            state = state.withColumns({"low": low, "high": high})
            newton = F.col("multiplier") - F.least(F.greatest(gap / F.greatest(F.col("slope"), F.lit(1e-300)), F.lit(-4.0)), F.lit(4.0))
            inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
            middle = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2)
            step_to = F.when(inside, newton).otherwise(F.coalesce(middle, newton))
            stuck = (F.col("high") - F.col("low")) <= F.abs(F.col("multiplier")) * 1e-15
            state = state.withColumn("multiplier", F.when(F.col("open") & ~near, step_to).otherwise(F.col("multiplier")))
            state = state.withColumn("open", F.col("open") & ~near & ~F.coalesce(stuck, F.lit(False))).drop("got", "slope", "most")
            state = cut_lineage(state)
            if not state.filter("open").take(1):
                break
        return state.withColumn("multiplier", F.when(~F.col("short"), F.col("multiplier"))).drop("low", "high", "open")

    def copies(self) -> DataFrame:
        """(doc_id, source, size, copies) of the documents used at least once. Repeated doc_ids are separate documents."""
        state = self.multipliers().filter("goal > 0")
        x = F.col("size") / F.col("unit")
        rate = F.when(F.col("multiplier").isNull(), F.col("max_repeats")).otherwise(
            F.least(F.exp(F.least(F.col("multiplier") * x, F.lit(700.0))), F.col("max_repeats").cast("double"))
        )
        cells = join_small(self.cells.filter("size > 0"), state.select("source", "unit", "multiplier", "max_repeats"), ["source"], ["size"])
        cells = cells.withColumns({"rate": rate}).withColumn("base", F.floor(F.col("rate") + 1e-9))
        by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
        part = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) * F.col("documents")
        # one more copy for as many documents of each size as the running sum of fractions asks for
        cells = cells.withColumn("due", F.floor(F.sum(part).over(by_size) + 0.5))
        cells = cells.withColumn("extra", (F.col("due") - F.lag("due", 1, 0).over(Window.partitionBy("source").orderBy("size"))).cast("long"))
        # a cell may hold a third of all documents: share its extra copies among lots of bounded size, then rank in each lot
        cells = cells.withColumn("lots", F.ceil(F.col("documents") / LOT_ROWS).cast("int")).select("source", "size", "base", "extra", "documents", "max_repeats", "lots")
        rows = self.sized.filter("size > 0 and source is not null")
        rows = join_small(rows, cells, ["source", "size"], ["doc_id"]).withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.col("lots")).cast("int"))
        lots = rows.groupBy("source", "size", "lot", "extra", "documents").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, 0)
        lots = lots.withColumn("upto", F.sum("n").over(before))
        share = lambda n: F.floor(n * F.col("extra") / F.col("documents") + 0.5)
        lots = lots.withColumn("more", share(F.col("upto")) - share(F.col("upto") - F.col("n"))).select("source", "size", "lot", "more")
        order = Window.partitionBy("source", "size", "lot").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
        ranked = rows.withColumn("place", F.row_number().over(order)).join(lots, ["source", "size", "lot"])
        copies = F.least(F.col("base") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0), F.col("max_repeats")).cast("int")
        return ranked.select("doc_id", "source", "size", copies.alias("copies")).filter("copies > 0")

    def report(self) -> DataFrame:
        """(source, weight, max_repeats, available, longest, wanted, goal, short, reached, share, most_copies): what each source really holds.

        short: all copies together stay below its weight, so reached is below wanted. reached is within
        one document (longest) of goal.
        """
        used = self.copies().groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached"), F.max("copies").alias("most_copies"))
        rows = cut_lineage(self.multipliers().join(used, "source", "left").fillna(0, ["reached", "most_copies"]))
        every = rows.agg(F.sum("reached")).first()[0] or 0
        share = F.col("reached") / F.lit(float(every)) if every else F.lit(0.0)
        return rows.select("source", "weight", "max_repeats", "available", "longest", "wanted", "goal", "short", "reached", share.alias("share"), "most_copies")


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source): targets that the balanced mixture, sized in terms, leaves below their weight with all copies used."""
    return Mixture(documents, targets).report().filter(F.col("short") & (F.col("reached") < F.col("wanted"))).select("source")
