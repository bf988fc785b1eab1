"""Barcode pools: known sequences of one length, with IUPAC codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC, expansions, folded, mask_digits

#: Expansions of one seed of a barcode beyond which it's compared by mask instead.
WILD = 1024


#: What becomes of barcodes that can match the same sequence: an error, the first or the last of them wins, or none is matched.
POLICIES = ("error", "first", "last", "none")


class Pool:
    """frame: idx (0-based), barcode (as given), masks (digits) and whether it's wild; different: a row for each different barcode, with the lowest and the
    highest idx of equal ones; length: of every barcode; segments: their lengths; size: sequences that barcodes stand for, wild ones left out."""

    def __init__(self, frame: DataFrame, check: str = "error", segments: Sequence[int] | None = None):
        """frame: idx and barcode. check: one of POLICIES, which also settles ties between different barcodes. Reads frame once, and once more for `error` if it has IUPAC codes."""
        if check not in POLICIES:
            raise ValueError(f"unknown duplicate policy {check!r}")
        self.policy = check
        self.frame = frame.select(F.col("idx").cast("long"), "barcode", mask_digits(F.col("barcode")).alias("masks"), F.coalesce(n_expansions(F.col("barcode")) > WILD, F.lit(False)).alias("wild"))
        stats = self.frame.agg(F.min(F.length("barcode")).alias("a"), F.max(F.length("barcode")).alias("b"), F.first(F.when(folded(F.col("barcode")).rlike(f"[^{IUPAC}]"), F.col("barcode")), ignorenulls=True).alias("odd"), F.count_if(F.col("barcode").isNull()).alias("nulls"), F.count_if("wild").alias("wild"), F.sum(F.when(~F.col("wild"), n_expansions(F.col("barcode")))).alias("size"), F.max(n_expansions(F.col("barcode"))).alias("most"), F.count("*").alias("n"), F.count_distinct(folded(F.col("barcode"))).alias("different")).first()
        if stats["a"] != stats["b"]:
            raise ValueError("variable regions must have the same length")
        if stats["odd"] is not None or stats["nulls"]:
            raise ValueError(f"unknown base in barcode {stats['odd']!r}")
        self.length, self.wild = stats["a"] or 0, stats["wild"]
        self.segments = list(segments) if segments else [self.length]
        self.size = (stats["size"] or 0.0) * stats["different"] / (stats["n"] or 1)
        if stats["n"] == stats["different"]:
            self.different = self.frame.select(F.col("idx").alias("low"), F.col("idx").alias("high"), "barcode", "masks", "wild")
        else:
            self.different = self.frame.groupBy("masks", "wild").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.min("barcode").alias("barcode"))
        # of plain barcodes, only equal ones can match the same sequence
        clean = stats["n"] == stats["different"] and (stats["most"] or 1) == 1
        if check == "error" and not clean and (found := duplicates(self).orderBy("first", "second").first()):
            raise ValueError(f"duplicate sequences detected ({found['first'] + 1}, {found['second'] + 1}) when constructing the trie")

    @classmethod
    def of(cls, choices: Sequence[str] | DataFrame | Pool, spark: SparkSession, check: str = "error") -> Pool:
        if isinstance(choices, Pool):
            return choices
        if isinstance(choices, DataFrame):
            return cls(choices, check)
        return cls(spark.createDataFrame(list(enumerate(choices)), "idx long, barcode string"), check)


def expanded(c: Column) -> Column:
    """All sequences that a barcode of IUPAC codes can match."""
    codes = F.create_map(*(x for k in IUPAC for x in (F.lit(k), F.array(*map(F.lit, expansions(k))))))
    letters = F.filter(F.split(folded(c), ""), lambda x: x != "")
    return F.aggregate(letters, F.array(F.lit("")), lambda all_, k: F.flatten(F.transform(all_, lambda a: F.transform(F.element_at(codes, k), lambda b: F.concat(a, b)))))


def n_expansions(c: Column) -> Column:
    sizes = F.create_map(*(x for k in IUPAC for x in (F.lit(k), F.lit(float(len(expansions(k)))))))
    return F.aggregate(F.filter(F.split(folded(c), ""), lambda x: x != ""), F.lit(1.0), lambda n, k: n * F.element_at(sizes, k))


def duplicates(pool: Pool) -> DataFrame:
    """first and second idx of pairs of barcodes that can match the same sequence; of many with one sequence, the two lowest."""
    plain = pool.frame.where("not wild").select("idx", F.explode(expanded(F.col("barcode"))).alias("s"))
    # the two lowest idx of each sequence
    found = plain.groupBy("s").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).where("first < last")
    found = found.join(plain, "s").where("idx > first").groupBy("s", "first").agg(F.min("idx").alias("second")).select("first", "second")
    if not pool.wild:
        return found.distinct()
    wild, sized = pool.frame.where("wild"), pool.frame
    # two barcodes overlap where no position's masks are disjoint
    shared = lambda a, b: F.forall(F.sequence(F.lit(1), F.lit(max(1, pool.length))), lambda i: F.conv(F.substring(a, i, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.conv(F.substring(b, i, F.lit(1)), 16, 10).cast("int")) > 0)
    pairs = wild.alias("a").join(sized.alias("b"), (F.col("a.idx") != F.col("b.idx")) & shared(F.col("a.masks"), F.col("b.masks")))
    return found.unionByName(pairs.select(F.least("a.idx", "b.idx").alias("first"), F.greatest("a.idx", "b.idx").alias("second"))).distinct()
