"""The registered queries of the counting engine, each with DuckDB SQL for the same result."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import reverse_complement
from .operators import counters as C
from .operators.hits import template_hits
from .operators import matrix as M
from .operators.matrix import combine_combo_counts, matrix_of
from .operators.pool import Pool, duplicates
from .plans import oracle as O
from .plans.synth import COMBO, MATE1, MATE2, RANDOM, SINGLE, frame
from .plans.template import Template, parse_template, strands
from .sources.fastq import read_fastq, write_fastq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TWO = (MATE1, MATE2)


def _add(name: str, query: Callable, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _reads(spark, d, name, sample=False) -> DataFrame:
    return frame(spark, d, name).select(*(c for c in ("seq", "seq1", "seq2", *(["sample"] if sample else [])) if c in frame(spark, d, name).columns))


def _fresh(spark) -> str:
    """A new folder in the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return os.path.join(base.removeprefix("file:"), "barnacle-fastq", uuid.uuid4().hex)


def _pool(spark, d, name) -> Pool:
    """Barcodes of IUPAC codes may overlap: as in the SQL, a sequence that several of them match as well is none's."""
    return Pool(frame(spark, d, name), "none" if name == "pool_iupac" else "error")


def _files(spark, reads: DataFrame, samples: str, mates: int = 1) -> list:
    """FASTQ folders of the reads of each sample, or pairs of folders."""
    path, out = _fresh(spark), []
    for sample in samples:
        part, made = reads.where(F.col("sample") == sample), []
        for column in ("seq",) if mates == 1 else ("seq1", "seq2"):
            made.append(f"{path}/{column}/{sample}")
            write_fastq(part.select(F.lit("r").alias("name"), F.col(column).alias("seq")), made[-1], "gzip")
        out.append(made[0] if mates == 1 else tuple(made))
    return out


def _singles() -> None:
    for name, reads, pool, k, best, strand in (
        ("single_exact_first", "reads", "pool", 0, False, "original"),
        ("single_sub1_first", "reads", "pool", 1, False, "original"),
        ("single_sub1_best", "reads", "pool", 1, True, "original"),
        ("single_sub2_best", "reads_both", "pool", 2, True, "both"),
        ("single_strand_both", "reads_both", "pool", 1, False, "both"),
        ("single_strand_reverse", "reads_both", "pool", 1, False, "reverse"),
        ("single_iupac", "reads_both", "pool_iupac", 1, True, "both"),
    ):
        def query(spark, d, reads=reads, pool=pool, k=k, best=best, strand=strand):
            return C.count_single(_reads(spark, d, reads), _pool(spark, d, pool), template=SINGLE, substitutions=k, find_best=best, strand=strand).table

        make = O.iupac_pool if pool == "pool_iupac" else O.plain_pool
        ctes = [*O.source("reads", reads), *make("pool", pool), *O.single("m", "reads", "seq", SINGLE, "pool", k, best, strand)]
        one = f"(SELECT DISTINCT idx, {'code' if make is O.iupac_pool else 'barcode'} AS barcode FROM pool)"
        _add(name, query, O.sql(ctes, O.dense("m", "reads", "seq", one, "p.barcode AS choices")))

    ctes = [*O.source("reads", "reads_both"), *O.plain_pool("pool", "pool"), *O.single("m", "reads", "seq", SINGLE, "pool", 1, False, "both")]

    def counted(spark, d):
        return C.count_single(_reads(spark, d, "reads_both", True), Pool(frame(spark, d, "pool")), template=SINGLE, substitutions=1)

    _add("single_matrix_long", lambda s, d: matrix_of(counted(s, d), ["idx", "choices"], True).counts, O.sql(ctes, "SELECT p.idx::BIGINT AS idx, barcode AS choices, s.sample, coalesce(n, 0)::BIGINT AS counts FROM pool p CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT sample, idx, count(*) AS n FROM reads JOIN m USING (seq) GROUP BY ALL) c ON c.idx = p.idx AND c.sample = s.sample"))
    _add("single_matrix_wide", lambda s, d: matrix_of(counted(s, d), ["idx", "choices"], True).wide(["A", "N", "R"]), O.sql(ctes, "SELECT p.idx::BIGINT AS idx, barcode AS choices, " + ", ".join(f"count(*) FILTER (WHERE sample = '{x}')::BIGINT AS \"{x}\"" for x in "ANR") + " FROM pool p LEFT JOIN (SELECT sample, idx FROM reads JOIN m USING (seq)) c ON c.idx = p.idx GROUP BY ALL"))
    _add("single_totals", lambda s, d: matrix_of(counted(s, d), ["idx", "choices"], True).col_data, O.sql(ctes, "SELECT sample, count(*)::BIGINT AS nreads, count(m.idx)::BIGINT AS nmapped FROM reads LEFT JOIN m USING (seq) GROUP BY sample"))

    def roundtrip(spark, d):
        path = _fresh(spark)
        write_fastq(frame(spark, d, "reads").select(F.lit("r").alias("name"), "seq"), path, "gzip")
        return C.count_single(read_fastq(spark, f"{path}/part-*"), Pool(frame(spark, d, "pool")), template=SINGLE, substitutions=1, strand="original").table

    _add("fastq_roundtrip", roundtrip, SQL["single_sub1_first"])

    def flanked(spark, d):
        return C.count_single(_reads(spark, d, "reads"), Pool(frame(spark, d, "pool")), flank5="ACGT", flank3="TGCA", substitutions=1, strand="original").table

    _add("single_flanks", flanked, SQL["single_sub1_first"])

    def either_first(spark, d):
        return C.count_single_paired(_reads(spark, d, "pairs_mixed"), Pool(frame(spark, d, "pool")), SINGLE, 1, False, "original").table

    ctes = [*O.source("reads", "pairs_mixed"), *O.plain_pool("pool", "pool"), *O.single("a", "reads", "seq1", SINGLE, "pool", 1, False, "original"), *O.single("b", "reads", "seq2", SINGLE, "pool", 1, False, "original")]
    ctes.append("m AS (SELECT DISTINCT seq1, seq2, coalesce(a.idx, b.idx) AS idx FROM reads LEFT JOIN a USING (seq1) LEFT JOIN b USING (seq2))")
    _add("single_either_mate_first", either_first, O.sql(ctes, O.dense("m", "reads", "seq1, seq2", "pool", "p.barcode AS choices")))

    def either(spark, d):
        return C.count_single_paired(_reads(spark, d, "pairs_mixed"), Pool(frame(spark, d, "pool")), SINGLE, 1, True, "original").table

    ctes = [*O.source("reads", "pairs_mixed"), *O.plain_pool("pool", "pool"), *O.single("a", "reads", "seq1", SINGLE, "pool", 1, True, "original"), *O.single("b", "reads", "seq2", SINGLE, "pool", 1, True, "original")]
    ctes.append("m AS (SELECT DISTINCT seq1, seq2, CASE WHEN b.idx IS NULL OR a.total < b.total THEN a.idx WHEN a.idx IS NULL OR b.total < a.total THEN b.idx WHEN a.idx = b.idx THEN a.idx END AS idx FROM reads LEFT JOIN a USING (seq1) LEFT JOIN b USING (seq2))")
    _add("single_either_mate", either, O.sql(ctes, O.dense("m", "reads", "seq1, seq2", "pool", "p.barcode AS choices")))


def _matches() -> None:
    for name, pool, k, reverse in (("match_sub0", "pool", 0, False), ("match_sub1", "pool", 1, False), ("match_reverse", "pool", 1, True), ("match_iupac", "pool_iupac", 1, False)):
        def query(spark, d, pool=pool, k=k, reverse=reverse):
            return C.match_barcodes(frame(spark, d, "queries"), _pool(spark, d, pool), k, reverse)

        make = O.iupac_pool if pool == "pool_iupac" else O.plain_pool
        v = "reverse(translate(seq, 'ACGT', 'TGCA'))" if reverse else "seq"
        ctes = [*O.source("q0", "queries"), f"q AS (SELECT *, {v} AS v0 FROM q0)", *make("pool", pool), *O.resolve("r", "q", "v0", "pool", k)]
        _add(name, query, O.sql(ctes, 'SELECT p_partkey, seq, (idx + 1)::BIGINT AS "index", d::BIGINT AS mismatches FROM q LEFT JOIN r ON v0 = v'))
    # which of several equal barcodes is found is up to the pool's policy
    for policy, one in (("first", "min(idx)"), ("last", "max(idx)"), ("none", "CASE WHEN count(*) = 1 THEN min(idx) END")):
        def settled(spark, d, policy=policy):
            p = frame(spark, d, "repeated")
            return C.match_barcodes(p.select(F.col("barcode").alias("seq")), Pool(p, policy))

        _add(f"match_duplicates_{policy}", settled, O.sql(O.source("p", "repeated"), f'SELECT barcode AS seq, (i + 1)::BIGINT AS "index", CASE WHEN i IS NOT NULL THEN 0 END::BIGINT AS mismatches FROM p JOIN (SELECT barcode, {one} AS i FROM p GROUP BY barcode) USING (barcode)'))
    _add("revcomp", lambda s, d: frame(s, d, "pool_iupac").select(F.col("idx").cast("long").alias("idx"), reverse_complement(F.col("barcode")).alias("rc")), O.sql(O.source("p", "pool_iupac"), "SELECT idx::BIGINT AS idx, reverse(translate(barcode, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc FROM p"))

    def parsed(spark, d):
        rows = [(i, *v) for i, v in enumerate(parse_template(COMBO)["variable"], 1)]
        return spark.createDataFrame(rows, "region long, pos long, len long")

    _add("parse_template", parsed, "SELECT * FROM (VALUES (1::BIGINT, 5::BIGINT, 8::BIGINT), (2, 17, 5)) t(region, pos, len)")

    def found(spark, d):
        hits = template_hits(_reads(spark, d, "reads_both").distinct(), "seq", Template.of(SINGLE), strands("both"), 1)
        return hits.groupBy("pos", "is_reverse", "cm").agg(F.count("*").alias("n")).select(F.col("pos").cast("long").alias("pos"), "is_reverse", F.col("cm").cast("long").alias("cm"), "n")

    _add("template_hits", found, O.sql([*O.source("reads", "reads_both"), *O.hits("h", "reads", "seq", SINGLE, "both", 1)], "SELECT p::BIGINT AS pos, is_reverse, cm, count(*)::BIGINT AS n FROM h GROUP BY ALL"))
    _add("pool_duplicates", lambda s, d: duplicates(Pool(frame(s, d, "repeated"), "first")), O.sql(O.source("p", "repeated"), "SELECT a::BIGINT AS first, b::BIGINT AS second FROM (SELECT min(idx) AS a, list_sort(list(idx))[2] AS b FROM p GROUP BY barcode HAVING count(*) > 1)"))


def _randoms() -> None:
    ctes = lambda best: [*O.source("reads", "reads_random"), *O.hits("h", "reads", "seq", RANDOM, "both", 1), "m AS (" + ("SELECT seq, min(v0) AS v FROM (SELECT *, min(cm) OVER (PARTITION BY seq) AS m FROM h) WHERE cm = m GROUP BY seq HAVING count(*) = 1" if best else "SELECT seq, arg_min(v0, place) AS v FROM h GROUP BY seq") + ")"]
    for name, best in (("random_first", False), ("random_best", True)):
        _add(name, lambda s, d, best=best: C.count_random(_reads(s, d, "reads_random"), RANDOM, 1, best).table, O.sql(ctes(best), "SELECT v AS sequences, count(*)::BIGINT AS counts FROM reads JOIN m USING (seq) GROUP BY v"))
    _add("random_matrix", lambda s, d: matrix_of(C.count_random(_reads(s, d, "reads_random", True), RANDOM, 1), ["sequences"], True).counts, O.sql(ctes(False), "SELECT k.v AS sequences, s.sample, coalesce(n, 0)::BIGINT AS counts FROM (SELECT DISTINCT v FROM m) k CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT v, sample, count(*) AS n FROM reads JOIN m USING (seq) GROUP BY ALL) c ON c.v = k.v AND c.sample = s.sample"))


def _combos() -> None:
    def pools(spark, d):
        return [Pool(frame(spark, d, "pool")), Pool(frame(spark, d, "pool2"))]

    def ctes(best, k=1):
        return [*O.source("reads", "reads_combo"), *O.plain_pool("pool", "pool"), *O.plain_pool("pool2", "pool2"), *O.combo("m", "reads", COMBO, k, best, "both", ("pool", "pool2"))]

    def counted(spark, d, best=False, sample=False, indices=False):
        return C.count_combo(_reads(spark, d, "reads_combo", sample), COMBO, pools(spark, d), 1, best, "both", indices).table

    flat = lambda df, *more: df.select("combinations.*", *more, "counts")
    named = "SELECT a.barcode AS first, b.barcode AS second, {more}count(*)::BIGINT AS counts FROM reads JOIN m USING (seq) JOIN pool a ON a.idx = m.idx // 1000000 JOIN pool2 b ON b.idx = m.idx % 1000000 GROUP BY ALL"
    _add("combo_single", lambda s, d: flat(counted(s, d)), O.sql(ctes(False), named.format(more="")))
    _add("combo_best", lambda s, d: flat(counted(s, d, True)), O.sql(ctes(True), named.format(more="")))
    _add("combo_indices", lambda s, d: flat(counted(s, d, indices=True)), O.sql(ctes(False), "SELECT (idx // 1000000 + 1)::BIGINT AS first, (idx % 1000000 + 1)::BIGINT AS second, count(*)::BIGINT AS counts FROM reads JOIN m USING (seq) GROUP BY ALL"))

    def matrix(spark, d):
        seqs = _reads(spark, d, "reads_combo", True)
        return matrix_of(C.count_combo(seqs, COMBO, pools(spark, d), 1), ["combinations"], True).counts.select("combinations.*", "sample", "counts")

    _add("combo_matrix", matrix, O.sql([*ctes(False), f"n AS ({named.format(more='sample, ')})"], "SELECT k.*, s.sample, coalesce(n.counts, 0)::BIGINT AS counts FROM (SELECT DISTINCT first, second FROM n) k CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN n ON n.first = k.first AND n.second = k.second AND n.sample = s.sample"))

    def numbered(spark, d):
        m = matrix_of(C.count_combo(_reads(spark, d, "reads_combo", True), COMBO, pools(spark, d), 1), ["combinations"], True)
        return M._named_rows(m).row_data.select("combinations.*", "name")

    keys = "SELECT DISTINCT a.barcode AS first, b.barcode AS second FROM reads JOIN m USING (seq) JOIN pool a ON a.idx = m.idx // 1000000 JOIN pool2 b ON b.idx = m.idx % 1000000"
    _add("combo_row_names", numbered, O.sql([*ctes(False), f"k AS ({keys})"], "SELECT first, second, 'BARCODE_' || row_number() OVER (ORDER BY first, second) AS name FROM k"))

    def of_files(spark, d):
        files = _files(spark, _reads(spark, d, "reads_combo", True), "ANR")
        return M.matrix_of_combo(spark, files, COMBO, pools(spark, d), substitutions=1).counts.select("combinations.*", "sample", "counts")

    _add("files_combo", of_files, SQL["combo_matrix"])

    def of_pairs(spark, d):
        files = _files(spark, _reads(spark, d, "pairs", True), "FOP", 2)
        return M.matrix_of_combo_paired(spark, files, pools(spark, d), template=TWO, substitutions=1)

    c = [*O.source("reads", "pairs"), *O.plain_pool("pool", "pool"), *O.plain_pool("pool2", "pool2"), *O.single("m1", "reads", "seq1", MATE1, "pool", 1, False, "original"), *O.single("m2", "reads", "seq2", MATE2, "pool2", 1, False, "original")]
    c.append("w AS (SELECT sample, m1.idx AS a, m2.idx AS b FROM reads LEFT JOIN m1 USING (seq1) LEFT JOIN m2 USING (seq2))")
    c.append("n AS (SELECT a.barcode AS first, b.barcode AS second, sample, count(*) AS n FROM w JOIN pool a ON a.idx = w.a JOIN pool2 b ON b.idx = w.b GROUP BY ALL)")
    _add("files_combo_paired", lambda s, d: of_pairs(s, d).counts.select("combinations.*", "sample", "counts"), O.sql(c, "SELECT k.*, s.sample, coalesce(n, 0)::BIGINT AS counts FROM (SELECT DISTINCT first, second FROM n) k CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN n USING (first, second, sample)"))
    _add("files_combo_paired_totals", lambda s, d: of_pairs(s, d).col_data.select("sample", "npairs", "barcode1_only", "barcode2_only"), O.sql(c, "SELECT sample, count(*)::BIGINT AS npairs, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL)::BIGINT AS barcode1_only, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL)::BIGINT AS barcode2_only FROM w GROUP BY sample"))

    def combined(spark, d):
        t = counted(spark, d, sample=True)
        return combine_combo_counts({x: t.where(F.col("sample") == x) for x in "ANR"}).select("combinations.*", *"ANR")

    _add("combine_combo", combined, O.sql([*ctes(False), f"n AS ({named.format(more='sample, ')})"], "SELECT first, second, " + ", ".join(f"coalesce(sum(counts) FILTER (WHERE sample = '{x}'), 0)::BIGINT AS \"{x}\"" for x in "ANR") + " FROM n GROUP BY ALL"))

    def paired(best, randomized):
        reads = "pairs_mixed" if randomized else "pairs"

        def result(spark, d):
            return C.count_combo_paired(_reads(spark, d, reads), pools(spark, d), template=TWO, substitutions=1, find_best=best, randomized=randomized)

        c = [*O.source("reads", reads), *O.plain_pool("pool", "pool"), *O.plain_pool("pool2", "pool2")]
        for n, col, t, p in (("m1", "seq1", MATE1, "pool"), ("m2", "seq2", MATE2, "pool2"), ("n1", "seq2", MATE1, "pool"), ("n2", "seq1", MATE2, "pool2")):
            c += O.single(n, "reads", col, t, p, 1, best, "original")
        c.append("j AS (SELECT r.seq1, r.seq2, m1.idx AS a1, m2.idx AS a2, m1.total + m2.total AS m_total, n1.idx AS b1, n2.idx AS b2, n1.total + n2.total AS n_total FROM reads r LEFT JOIN m1 ON m1.seq1 = r.seq1 LEFT JOIN m2 ON m2.seq2 = r.seq2 LEFT JOIN n1 ON n1.seq2 = r.seq2 LEFT JOIN n2 ON n2.seq1 = r.seq1)")
        a, b, same = "m_total IS NOT NULL", "n_total IS NOT NULL" if randomized else "false", "a1 = b1 AND a2 = b2"
        which = f"CASE WHEN {a} AND {b} AND n_total < m_total THEN 'b' WHEN {a} AND {b} AND n_total = m_total AND NOT ({same}) THEN 'x' WHEN {a} THEN 'a' WHEN {b} THEN 'b' END" if best else f"CASE WHEN {a} THEN 'a' WHEN {b} THEN 'b' END"
        only = ["a1 IS NOT NULL OR b1 IS NOT NULL", "a2 IS NOT NULL OR b2 IS NOT NULL"] if randomized else ["a1 IS NOT NULL", "a2 IS NOT NULL"]
        c.append(f"w AS (SELECT *, {which} AS which, {only[0]} AS has1, {only[1]} AS has2 FROM j)")
        table = O.sql(c, "SELECT a.barcode AS first, b.barcode AS second, count(*)::BIGINT AS counts FROM w JOIN pool a ON a.idx = CASE which WHEN 'a' THEN a1 WHEN 'b' THEN b1 END JOIN pool2 b ON b.idx = CASE which WHEN 'a' THEN a2 WHEN 'b' THEN b2 END GROUP BY ALL")
        totals = O.sql(c, "SELECT count(*)::BIGINT AS npairs, count(*) FILTER (WHERE which IS NULL AND has1)::BIGINT AS barcode1_only, count(*) FILTER (WHERE which IS NULL AND NOT has1 AND has2)::BIGINT AS barcode2_only FROM w")
        return result, table, totals

    for name, best, randomized in (("combo_paired", False, False), ("combo_paired_best", True, False), ("combo_paired_randomized", False, True), ("combo_paired_randomized_best", True, True)):
        result, table, totals = paired(best, randomized)
        _add(name, lambda s, d, f=result: flat(f(s, d).table), table)
        _add(f"{name}_totals", lambda s, d, f=result: f(s, d).metadata, totals)


def _duals() -> None:
    for name, best in (("dual_single_end", False), ("dual_single_end_best", True)):
        def query(spark, d, best=best):
            return C.count_dual(_reads(spark, d, "reads_dual"), frame(spark, d, "rows"), COMBO, 1, best).table

        ctes = [*O.source("reads", "reads_dual"), *O.source("rows_", "rows"), *O.dual("m", "reads", COMBO, 1, best, "both", "rows_")]
        _add(name, query, O.sql(ctes, O.dense("m", "reads", "seq", "rows_", "p.x, p.y")))

    def with_invalid(spark, d):
        return C.count_dual(_reads(spark, d, "reads_dual"), frame(spark, d, "rows"), COMBO, 1, include_invalid=True).table.select("x", "y", "counts", "valid")

    ctes = [*O.source("reads", "reads_dual"), *O.source("rows_", "rows"), *O.dual("m", "reads", COMBO, 1, False, "both", "rows_")]
    ctes += ["rest AS (SELECT * FROM reads ANTI JOIN m USING (seq))", "px AS (SELECT idx, x AS barcode FROM rows_)", "py AS (SELECT idx, y AS barcode FROM rows_)", *O.combo("c", "rest", COMBO, 1, False, "both", ("px", "py"), True)]
    lost = "SELECT a.x, b.y, count(*)::BIGINT AS counts, false AS valid FROM rest JOIN c USING (seq) JOIN rows_ a ON a.idx = c.idx // 1000000 JOIN rows_ b ON b.idx = c.idx % 1000000 GROUP BY a.x, b.y"
    _add("dual_single_end_invalid", with_invalid, O.sql(ctes, f"SELECT x, y, counts, true AS valid FROM ({O.dense('m', 'reads', 'seq', 'rows_', 'p.x, p.y')}) UNION ALL {lost}"))

    def with_invalid_totals(spark, d):
        return C.count_dual(_reads(spark, d, "reads_dual"), frame(spark, d, "rows"), COMBO, 1, include_invalid=True).metadata

    _add("dual_single_end_invalid_totals", with_invalid_totals, O.sql(ctes, f"SELECT (SELECT count(*) FROM reads)::BIGINT AS nreads, (SELECT coalesce(sum(counts), 0) FROM ({lost}))::BIGINT AS invalid_reads"))

    def named(spark, d):
        rows = frame(spark, d, "rows").withColumn("name", F.concat(F.lit("PAIR_"), F.col("idx").cast("string")))
        files = _files(spark, _reads(spark, d, "reads_dual", True), "ANR")
        return M.matrix_of_dual(spark, files, rows, COMBO, substitutions=1).counts

    c = [*O.source("reads", "reads_dual"), *O.source("rows_", "rows"), *O.dual("m", "reads", COMBO, 1, False, "both", "rows_")]
    _add("files_dual", named, O.sql(c, "SELECT p.idx::BIGINT AS idx, x, y, 'PAIR_' || p.idx AS name, s.sample, coalesce(n, 0)::BIGINT AS counts FROM rows_ p CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT sample, idx, count(*) AS n FROM reads JOIN m USING (seq) GROUP BY ALL) c ON c.idx = p.idx AND c.sample = s.sample"))

    def files_invalid(spark, d):
        files = _files(spark, _reads(spark, d, "reads_dual", True), "ANR")
        return M.matrix_of_dual(spark, files, frame(spark, d, "rows"), COMBO, substitutions=1, include_invalid=True).counts

    every = f"SELECT x, y, sample, count(*) AS n FROM reads JOIN m USING (seq) JOIN rows_ p ON p.idx = m.idx GROUP BY ALL UNION ALL {lost.replace('count(*)::BIGINT AS counts, false AS valid', 'sample, count(*) AS n').replace('GROUP BY a.x, b.y', 'GROUP BY a.x, b.y, sample')}"
    _add("files_dual_invalid", files_invalid, O.sql([*ctes, f"n AS ({every})", "k AS (SELECT x, y FROM rows_ UNION SELECT x, y FROM n)"], "SELECT k.x, k.y, s.sample, coalesce(sum(n.n), 0)::BIGINT AS counts, EXISTS (SELECT 1 FROM rows_ r WHERE r.x = k.x AND r.y = k.y) AS valid FROM k CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN n ON n.x = k.x AND n.y = k.y AND n.sample = s.sample GROUP BY k.x, k.y, s.sample"))

    both = lambda reads: [*O.source("reads", reads), *O.source("rows_", "rows")]
    for name, reads, best, randomized, ks in (("dual_paired_first", "pairs", False, False, (1, 1)), ("dual_paired_best", "pairs", True, False, (1, 1)), ("dual_paired_caps", "pairs", False, False, (1, 0)), ("dual_paired_randomized", "pairs_mixed", False, True, (1, 1)), ("dual_paired_randomized_best", "pairs_mixed", True, True, (1, 1))):
        def query(spark, d, reads=reads, best=best, randomized=randomized, ks=ks):
            return C.count_dual_paired(_reads(spark, d, reads), frame(spark, d, "rows"), template=TWO, substitutions=ks, find_best=best, randomized=randomized).table

        if randomized:
            ctes = [*both(reads), *O.dual_paired("a", "reads", ("seq1", "seq2"), TWO, ks, best, "rows_", best), *O.dual_paired("b", "reads", ("seq2", "seq1"), TWO, ks, best, "rows_", best)]
            none = sum(ks) + 1
            idx = f"CASE WHEN a.idx IS NULL OR coalesce(a.total, {none}) > coalesce(b.total, {none}) THEN b.idx WHEN coalesce(a.total, {none}) = coalesce(b.total, {none}) AND a.idx IS DISTINCT FROM b.idx THEN NULL ELSE a.idx END" if best else "coalesce(a.idx, b.idx)"
            ctes.append(f"m AS (SELECT seq1, seq2, {idx} AS idx FROM a FULL JOIN b USING (seq1, seq2))")
        else:
            ctes = [*both(reads), *O.dual_paired("m", "reads", ("seq1", "seq2"), TWO, ks, best, "rows_")]
        _add(name, query, O.sql(ctes, O.dense("m", "reads", "seq1, seq2", "rows_", "p.x, p.y")))

    def invalid(spark, d):
        return C.count_dual_paired(_reads(spark, d, "pairs"), frame(spark, d, "rows"), template=TWO, substitutions=1, include_invalid=True)

    ctes = [*both("pairs"), *O.dual_paired("m", "reads", ("seq1", "seq2"), TWO, (1, 1), False, "rows_"), "rest AS (SELECT * FROM reads ANTI JOIN m USING (seq1, seq2))", "px AS (SELECT idx, x AS barcode FROM rows_)", "py AS (SELECT idx, y AS barcode FROM rows_)"]
    ctes += [*O.single("c1", "rest", "seq1", MATE1, "px", 1, False, "original", True), *O.single("c2", "rest", "seq2", MATE2, "py", 1, False, "original", True)]
    lost = "SELECT a.x, b.y, count(*)::BIGINT AS counts, false AS valid FROM rest JOIN c1 USING (seq1) JOIN c2 USING (seq2) JOIN rows_ a ON a.idx = c1.idx JOIN rows_ b ON b.idx = c2.idx GROUP BY a.x, b.y"
    _add("dual_paired_invalid", lambda s, d: invalid(s, d).table.select("x", "y", "counts", "valid"), O.sql(ctes, f"SELECT x, y, counts, true AS valid FROM ({O.dense('m', 'reads', 'seq1, seq2', 'rows_', 'p.x, p.y')}) UNION ALL {lost}"))
    _add("dual_paired_invalid_totals", lambda s, d: invalid(s, d).metadata, O.sql(ctes, "SELECT (SELECT count(*) FROM reads)::BIGINT AS npairs, count(*) FILTER (WHERE c1.idx IS NOT NULL AND c2.idx IS NULL)::BIGINT AS barcode1_only, count(*) FILTER (WHERE c1.idx IS NULL AND c2.idx IS NOT NULL)::BIGINT AS barcode2_only, count(*) FILTER (WHERE c1.idx IS NOT NULL AND c2.idx IS NOT NULL)::BIGINT AS invalid_pair FROM rest LEFT JOIN c1 USING (seq1) LEFT JOIN c2 USING (seq2)"))

    def matrix(spark, d):
        return matrix_of(C.count_dual_paired(_reads(spark, d, "pairs", True), frame(spark, d, "rows"), template=TWO, substitutions=1), ["idx", "x", "y"], False).counts

    ctes = [*both("pairs"), *O.dual_paired("m", "reads", ("seq1", "seq2"), TWO, (1, 1), False, "rows_")]
    _add("dual_matrix", matrix, O.sql(ctes, "SELECT p.idx::BIGINT AS idx, x, y, s.sample, coalesce(n, 0)::BIGINT AS counts FROM rows_ p CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT sample, idx, count(*) AS n FROM reads JOIN m USING (seq1, seq2) GROUP BY ALL) c ON c.idx = p.idx AND c.sample = s.sample"))


def _last() -> None:
    def paired(spark, d):
        files = _files(spark, _reads(spark, d, "pairs", True), "FOP", 2)
        return M.matrix_of_dual_paired(spark, files, frame(spark, d, "rows"), template=TWO, substitutions=1).counts

    _add("files_dual_paired", paired, SQL["dual_matrix"])

    def single(spark, d):
        files = _files(spark, _reads(spark, d, "reads_both", True), "ANR")
        return M.matrix_of_single(spark, files, Pool(frame(spark, d, "pool")), template=SINGLE, substitutions=1)

    _add("files_single", lambda s, d: single(s, d).counts, SQL["single_matrix_long"])
    _add("files_single_totals", lambda s, d: single(s, d).col_data.select("sample", "nreads", "nmapped"), SQL["single_totals"])


for _make in (_singles, _matches, _randoms, _combos, _duals, _last):
    _make()
