"""Per-read matches and counts of barcodes.

Reads are a DataFrame with `seq`, or `seq1` and `seq2` for pairs, and perhaps `sample`. One scan finds the places of the template in each read,
on both strands, and what decides a read's match is put in one array: for each place, in the order in which places are tried, the mismatches in the constant bases and
the variable regions. That is all that is kept of a read; flanks go. Reads are summed by it before anything else, in each task first, so what is shuffled
is as much as there are different variable regions, and no read is shuffled whole. Each different region is then looked up once: candidates
come from a join with the pool, which Spark broadcasts if it's small enough, and the nearest barcode is joined back to the sums, where the first or best place
is chosen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import reverse_complement
from ..plans.template import Template, from_flanks, strands
from .hits import sites
from .pool import Pool
from .resolve import IDX, nearest, within


@dataclass
class CountResult:
    """table: a row for each barcode or combination; metadata: one row of totals, or one for each sample."""

    table: DataFrame
    metadata: DataFrame


def _by(reads: DataFrame) -> list[str]:
    return ["sample"] if "sample" in reads.columns else []


def _totals(reads: DataFrame, name: str) -> DataFrame:
    return reads.groupBy(*_by(reads)).agg(F.count("*").alias(name))


@dataclass
class Role:
    """One thing that a read is searched for. places: an array of structs, each with c, the mismatches in the constant bases of each mate, and v,
    one text for each of pools, all of which must have their nearest barcode there. caps: for each segment of a pool. budget: of all mismatches at a place.
    keep_ties: whether best places with different barcodes are a match without idx, and not none."""

    places: Column
    pools: list[Pool]
    caps: list[int]
    find_best: bool
    budget: int
    keep_ties: bool = False


def _single(column: str, template: Template, pool: Pool, reverse: tuple[bool, ...], k: int, find_best: bool) -> Role:
    if template.lengths != [pool.length]:
        raise ValueError(f"the variable region has length {template.lengths}, the barcodes {pool.length}")
    return Role(_places(sites(column, template, reverse, k)), [pool], [k], find_best, k)


def _places(found: Column, joined: bool = False) -> Column:
    v = lambda h: F.array(F.concat(*(h["v"][i] for i in range(joined)))) if joined else h["v"]
    return F.transform(found, lambda h: F.struct(F.array(h["cm"], F.lit(0)).alias("c"), v(h).alias("v")))


def matches(reads: DataFrame, roles: Sequence[Role], kept: bool = False) -> DataFrame:
    """sample if reads have it, w (reads that are alike), and for each role n: a struct m{n} of idx (an array) and total, null where it found nothing.

    Only reads with a match of some role. kept: the sums of reads stay cached until the session's end or clearCache(), for reads whose scan Spark doesn't
    share between branches.
    """
    by, pools = _by(reads), []
    for r in roles:
        pools += [p for p in r.pools if not any(p is q for q in pools)]
    number = {id(p): n for n, p in enumerate(pools)}
    caps = {number[id(p)]: r.caps for r in roles for p in r.pools}
    tag = lambda n: lambda h, i: F.struct(F.lit(n).alias("role"), i.alias("place"), h["c"].alias("c"), h["v"].alias("v"))
    tagged = [F.transform(r.places, tag(n)) for n, r in enumerate(roles)]
    key = tagged[0] if len(tagged) == 1 else F.concat(*tagged)
    alike = reads.select(*by, key.alias("key")).groupBy(*by, "key").agg(F.count("*").alias("w"))
    alike = alike.persist() if kept else alike
    keys = [*by, "key", "w"]
    at = [*keys, "role", "place", "c"]
    regions = max(len(r.pools) for r in roles)
    # an inner explode would have its own test for empty arrays pushed down to the scan, where it would search each read a second time
    rows = alike.select(*keys, F.explode_outer("key").alias("h")).where("h is not null").select(*keys, "h.role", "h.place", "h.c", "h.v")
    own = F.array(*(F.array(*(F.lit(number[id(p)]) for p in r.pools)) for r in roles))[F.col("role")]
    if regions > 1:
        rows = rows.select(*at, F.posexplode("v").alias("region", "v")).withColumn("pool", own[F.col("region")])
    else:
        rows = rows.select(*at, F.lit(0).alias("region"), F.col("v")[0].alias("v"), own[0].alias("pool"))
    policy = F.array(*(F.lit(p.policy) for p in pools))[F.col("pool")]
    # each different region is looked up once; mismatches so far matter to that only where segments have caps of their own, else the budget sees to them
    what = ["pool", "v", *(["c"] if any(len(p.segments) > 1 for p in pools) else [])]
    # w is asked for so that the sums are those that it's joined with below, exchanged once: without w they'd be others, from a scan of their own
    asked = rows.groupBy(*what).agg(F.max("w").alias("most")).where("most > 0").select(*what)
    asked = asked if "c" in what else asked.withColumn("c", F.array(F.lit(0), F.lit(0)))
    near = rows.join(nearest(within(asked, pools, [caps[n] for n in range(len(pools))]), what, policy), what)
    total = F.col("c")[0] + F.col("c")[1]
    budget = F.array(*(F.lit(r.budget) for r in roles))[F.col("role")]
    if regions > 1:
        idx = [F.max(F.when(F.col("region") == i, F.col("idx"))) for i in range(regions)]
        near = near.groupBy(*at).agg(F.sum("d").cast("int").alias("d"), F.count("*").alias("found"), *(c.alias(f"i{i}") for i, c in enumerate(idx)))
        near = near.where(F.col("found") == F.array(*(F.lit(len(r.pools)) for r in roles))[F.col("role")])
    else:
        near = near.withColumnRenamed("idx", "i0")
    near = near.withColumn("total", total + F.col("d")).where(F.col("total") <= budget)
    picked = []
    for n, r in enumerate(roles):
        here = lambda x, n=n: F.when(F.col("role") == n, x)
        values = [F.col(f"i{i}") for i in range(len(r.pools))]
        if not r.find_best:
            first = lambda x, h=here: F.min_by(x, h(F.col("place")))
            picked += [first(v).alias(f"m{n}_i{i}") for i, v in enumerate(values)] + [first(F.col("total")).alias(f"m{n}_total")]
        elif len(values) == 1:
            packed = lambda x, h=here: F.min(h(F.col("total").cast("long") * IDX + x))
            picked += [packed(values[0]).alias(f"m{n}_low"), packed(IDX - 1 - values[0]).alias(f"m{n}_high")]
        else:
            picked += [F.min(here(F.struct("total", *values))).alias(f"m{n}_low"), F.max(here(F.struct((-F.col("total")).alias("total"), *values))).alias(f"m{n}_high")]
    out = near.groupBy(*keys).agg(*picked)
    named = []
    for n, r in enumerate(roles):
        if not r.find_best:
            value, total = [F.col(f"m{n}_i{i}") for i in range(len(r.pools))], F.col(f"m{n}_total")
            none = total.isNull()
        elif len(r.pools) == 1:
            low, high = F.col(f"m{n}_low"), F.col(f"m{n}_high")
            value, total = [F.pmod(low, F.lit(IDX))], F.floor(low / IDX).cast("int")
            none, tied = low.isNull(), value[0] != IDX - 1 - F.pmod(high, F.lit(IDX))
        else:
            low, high = F.col(f"m{n}_low"), F.col(f"m{n}_high")
            value, total, none = [low[f"i{i}"] for i in range(len(r.pools))], low["total"], low.isNull()
            tied = F.struct(*value) != F.struct(*(high[f"i{i}"] for i in range(len(r.pools))))
        found = F.struct(F.array(*value).alias("idx"), total.alias("total"))
        if r.find_best and not r.keep_ties:
            none = none | tied
        elif r.find_best:
            found = F.when(tied, F.struct(F.lit(None).cast("array<bigint>").alias("idx"), total.alias("total"))).otherwise(found)
        named.append(F.when(~none, found).alias(f"m{n}"))
    return out.select(*by, "w", *named)


def _has(n: int) -> Column:
    return F.col(f"m{n}.idx").isNotNull()


def _idx(n: int, region: int = 0) -> Column:
    return F.col(f"m{n}.idx")[region]


def _summed(found: DataFrame, by: list[str], *values: str) -> DataFrame:
    return found.where(" AND ".join(f"{v} IS NOT NULL" for v in values)).groupBy(*by, *values).agg(F.sum("w").cast("long").alias("counts"))


def _dense(reads: DataFrame, found: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every barcode of pool, zeros too; found: idx and w."""
    by = _by(reads)
    counts = _summed(found, by, "idx")
    every = reads.select(*by).distinct().crossJoin(pool) if by else pool  # a row for each sample and barcode is what is asked for
    return every.join(counts, [*by, "idx"], "left").select(*by, "idx", *columns, F.coalesce("counts", F.lit(0)).alias("counts"))


def count_single(reads: DataFrame, choices, flank5: str | None = None, flank3: str | None = None, template: str | None = None, substitutions: int = 0, find_best: bool = False, strand: str = "both") -> CountResult:
    """counts of each of choices; metadata nreads."""
    pool = Pool.of(choices, reads.sparkSession)
    t = Template.of(from_flanks(flank5, flank3, pool.length, template), 1, fold=False)
    found = matches(reads, [_single("seq", t, pool, strands(strand), substitutions, find_best)])
    table = _dense(reads, found.withColumn("idx", _idx(0)), pool.frame.select("idx", F.col("barcode").alias("choices")), ["choices"])
    return CountResult(table, _totals(reads, "nreads"))


def count_single_paired(reads: DataFrame, choices, template: str, substitutions: int = 0, find_best: bool = False, strand: str = "both") -> CountResult:
    """counts of each of choices found in either mate; metadata npairs."""
    pool = Pool.of(choices, reads.sparkSession)
    t = Template.of(template, 1)
    found = matches(reads, [_single(c, t, pool, strands(strand), substitutions, find_best) for c in ("seq1", "seq2")])
    m1, m2, t1, t2 = _idx(0), _idx(1), F.col("m0.total"), F.col("m1.total")
    if find_best:
        idx = F.when(~_has(1) | (t1 < t2), m1).when(~_has(0) | (t2 < t1), m2).when(m1 == m2, m1)
    else:
        idx = F.coalesce(m1, m2)
    table = _dense(reads, found.withColumn("idx", idx), pool.frame.select("idx", F.col("barcode").alias("choices")), ["choices"])
    return CountResult(table, _totals(reads, "npairs"))


def _combination(pools: Sequence[Pool], names: Sequence[str], frame: DataFrame, indices: bool) -> DataFrame:
    """frame (i0, i1, ...) with `combinations` instead: sequences, or 1-based indices."""
    if indices:
        value = [(F.col(f"i{r}") + 1).alias(n) for r, n in enumerate(names)]
    else:
        for r, p in enumerate(pools):
            frame = frame.join(p.frame.select(F.col("idx").alias(f"i{r}"), F.col("barcode").alias(f"b{r}")), f"i{r}")
        value = [F.col(f"b{r}").alias(n) for r, n in enumerate(names)]
    return frame.withColumn("combinations", F.struct(*value))


def _pools(choices, reads: DataFrame, check: str = "error") -> tuple[list[Pool], list[str]]:
    names = list(choices) if isinstance(choices, dict) else ["first", "second"]
    each = list(choices.values()) if isinstance(choices, dict) else list(choices)
    if len(each) != 2:
        raise ValueError("'choices' must have two pools")
    return [Pool.of(c, reads.sparkSession, check) for c in each], names


def _combo(template: Template, pools: Sequence[Pool], reverse: tuple[bool, ...], k: int, find_best: bool) -> Role:
    """All regions at one place."""
    if template.lengths != [p.length for p in pools]:
        raise ValueError(f"the variable regions have lengths {template.lengths}, the barcodes {[p.length for p in pools]}")
    return Role(_places(sites("seq", template, reverse, k)), list(pools), [k], find_best, k)


def count_combo(reads: DataFrame, template: str, choices, substitutions: int = 0, find_best: bool = False, strand: str = "both", indices: bool = False) -> CountResult:
    """counts of the combinations that occur, in the order of their indices (i0, i1); metadata nreads."""
    pools, names = _pools(choices, reads)
    t = Template.of(template, 2, fold=False)
    found = matches(reads, [_combo(t, pools, strands(strand), substitutions, find_best)])
    found = found.withColumns({"i0": _idx(0), "i1": _idx(0, 1)})
    return CountResult(_combinations(reads, found, pools, names, indices), _totals(reads, "nreads"))


def _combinations(reads: DataFrame, found: DataFrame, pools, names, indices: bool) -> DataFrame:
    """found: i0, i1 and w."""
    by = _by(reads)
    out = _combination(pools, names, _summed(found, by, "i0", "i1"), indices).select(*by, "i0", "i1", "combinations", "counts")
    return out.orderBy(*by, "i0", "i1")


def _two(value, what: str) -> list:
    out = list(value) if isinstance(value, (list, tuple)) else [value, value]
    if len(out) != 2:
        raise ValueError(f"{what} must have one or two values")
    return out


def _paired(choices_lengths, flank5, flank3, template, substitutions, strand):
    texts = [from_flanks(a, b, n, t) for a, b, n, t in zip(_two(flank5, "flank5"), _two(flank3, "flank3"), choices_lengths, _two(template, "template"))]
    return [Template.of(t, 1) for t in texts], _two(substitutions, "substitutions"), [strands(s, paired=True) for s in _two(strand, "strand")]


def _combo_paired(templates, pools, reverse, ks, find_best: bool, randomized: bool) -> list[Role]:
    """Both mates; randomized: and each mate searched for what the other should have."""
    mates = [("seq1", 0), ("seq2", 1), *([("seq2", 0), ("seq1", 1)] if randomized else [])]
    return [_single(c, templates[r], pools[r], reverse[r], ks[r], find_best) for c, r in mates]


def _chosen(found: DataFrame, at: int, find_best: bool, randomized: bool) -> DataFrame:
    """found with i0 and i1 of a combination, only1 and only2; at: the number of the first role of _combo_paired()."""
    m1, m2 = _has(at), _has(at + 1)
    m = m1 & m2
    if randomized:
        n1, n2 = _has(at + 2), _has(at + 3)
        n = n1 & n2
        use_m, use_n = m, n & ~m
        if find_best:
            mt, nt = (F.col(f"m{a}.total") + F.col(f"m{a + 1}.total") for a in (at, at + 2))
            same = (_idx(at) == _idx(at + 2)) & (_idx(at + 1) == _idx(at + 3))
            use_m = (m & ~n) | (m & n & ((mt < nt) | ((mt == nt) & same)))
            use_n = (n & ~m) | (m & n & (nt < mt))
        none, one, two = ~m & ~n, m1 | n1, m2 | n2
        pick = lambda r: F.when(use_m, _idx(at + r)).when(use_n, _idx(at + 2 + r))
    else:
        none, one, two = ~m, m1, m2
        pick = lambda r: F.when(m, _idx(at + r))
    return found.select("*", pick(0).alias("i0"), pick(1).alias("i1"), (none & one).alias("only1"), (none & ~one & two).alias("only2"))


def _with_only(totals: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """totals with barcode1_only and barcode2_only."""
    each = [F.sum(F.when(F.col(f"only{i}"), F.col("w"))).cast("long").alias(f"barcode{i}_only") for i in (1, 2)]
    only = found.groupBy(*by).agg(*each)
    joined = totals.join(only, by, "left") if by else totals.crossJoin(only)  # without samples both have one row
    return joined.fillna(0, ["barcode1_only", "barcode2_only"])


def count_combo_paired(reads: DataFrame, choices, flank5=None, flank3=None, template=None, substitutions=0, find_best: bool = False, strand="original", randomized: bool = False, indices: bool = False) -> CountResult:
    """counts of the combinations that occur, in the order of their indices; metadata npairs, barcode1_only and barcode2_only."""
    pools, names = _pools(choices, reads)
    templates, ks, reverse = _paired([p.length for p in pools], flank5, flank3, template, substitutions, strand)
    found = _chosen(matches(reads, _combo_paired(templates, pools, reverse, ks, find_best, randomized)), 0, find_best, randomized)
    return CountResult(_combinations(reads, found, pools, names, indices), _with_only(_totals(reads, "npairs"), found, _by(reads)))


def _rows(choices, reads: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """idx and the columns of dual choices (a DataFrame with idx and perhaps `name`, or a dict of lists), the barcodes' columns, and all but idx."""
    if isinstance(choices, DataFrame):
        names = [c for c in choices.columns if c not in ("idx", "name")]
        every = [c for c in choices.columns if c != "idx"]
        return choices.select(F.col("idx").cast("long"), *(F.col(c).cast("string") for c in every)), names, every
    names = list(choices)
    if len({len(choices[n]) for n in names}) > 1:
        raise ValueError("the columns of 'choices' differ in length")
    rows = [(i, *map(str, r)) for i, r in enumerate(zip(*choices.values()))]
    return reads.sparkSession.createDataFrame(rows, "idx long, " + ", ".join(f"`{n}` string" for n in names)), names, names


def _side(rows: DataFrame, name: str, check: str) -> Pool:
    return Pool(rows.select("idx", F.col(name).alias("barcode")), check)


def _both(rows: DataFrame, names: list[str], segments: list[int] | None = None) -> Pool:
    return Pool(rows.select("idx", F.concat(*names).alias("barcode")), segments=segments)


def _invalid(by: list[str], found: DataFrame, rows: DataFrame, names: list[str], every: list[str]) -> DataFrame:
    """found (i0, i1, counts) decoded through the rows of choices."""
    for r, n in enumerate(names):
        found = found.join(rows.select(F.col("idx").alias(f"i{r}"), n), f"i{r}")
    extra = [F.lit("").alias(c) for c in every if c not in names]
    return found.select(*by, F.lit(None).cast("long").alias("idx"), "i0", "i1", *names, *extra, "counts", F.lit(False).alias("valid"))


def count_dual(reads: DataFrame, choices, template: str, substitutions: int = 0, find_best: bool = False, strand: str = "both", include_invalid: bool = False, kept: bool = False) -> CountResult:
    """counts of each row of choices in single-end reads; metadata nreads.

    include_invalid adds the combinations that no row has, of reads without a valid one, in the order of i0 and i1, with `valid`, and
    invalid_reads. A read that is ambiguous between rows may turn up there with a combination that a row has. kept: as in matches().
    """
    rows, names, every = _rows(choices, reads)
    t = Template.of(template, len(names))
    sides = [_side(rows, n, "first") for n in names]
    if t.lengths != [p.length for p in sides]:
        raise ValueError(f"the variable regions have lengths {t.lengths}, the barcodes {[p.length for p in sides]}")
    if include_invalid and len(names) != 2:
        raise ValueError("include_invalid needs two variable regions")
    # searched once for both roles
    searched = reads.select(*_by(reads), sites("seq", t, strands(strand), substitutions).alias("hits"))
    roles = [Role(_places(F.col("hits"), len(names)), [_both(rows, names)], [substitutions], find_best, substitutions)]
    if include_invalid:
        roles.append(Role(_places(F.col("hits")), sides, [substitutions], find_best, substitutions))
    found = matches(searched, roles, kept)
    table = _dense(reads, found.withColumn("idx", _idx(0)), rows, every)
    if not include_invalid:
        return CountResult(table, _totals(reads, "nreads"))
    lost = found.where(~_has(0)).withColumns({"i0": _idx(1), "i1": _idx(1, 1)})
    lost = _invalid(_by(reads), _summed(lost, _by(reads), "i0", "i1"), rows, names, every)
    return _with_invalid(reads, table, lost, every, _totals(reads, "nreads"), "invalid_reads")


def _with_invalid(reads: DataFrame, table: DataFrame, invalid: DataFrame, names: list[str], totals: DataFrame, name: str) -> CountResult:
    by, null = _by(reads), F.lit(None).cast("long")
    valid = table.select(*by, "idx", null.alias("i0"), null.alias("i1"), *names, "counts", F.lit(True).alias("valid"))
    lost = invalid.groupBy(*by).agg(F.sum("counts").cast("long").alias(name))
    totals = totals.join(lost, by, "left") if by else totals.crossJoin(lost)
    return CountResult(valid.unionByName(invalid), totals.withColumn(name, F.coalesce(name, F.lit(0))))


def _pair_places(columns: tuple[str, str], templates, reverse, ks) -> Column:
    """All pairs of a place in one mate and a place in the other, those of the first mate's first place first."""
    one, two = (sites(c, t, r, k) for c, t, r, k in zip(columns, templates, reverse, ks))
    pair = lambda a, b: F.struct(F.array(a["cm"], b["cm"]).alias("c"), F.array(F.concat(a["v"][0], b["v"][0])).alias("v"))
    return F.flatten(F.transform(one, lambda a: F.transform(two, lambda b: pair(a, b))))


def count_dual_paired(reads: DataFrame, choices, flank5=None, flank3=None, template=None, substitutions=0, find_best: bool = False, strand="original", randomized: bool = False, include_invalid: bool = False, kept: bool = False) -> CountResult:
    """counts of each row of choices (two columns) in read pairs; metadata npairs, and with include_invalid as in count_dual()."""
    rows, names, every = _rows(choices, reads)
    if len(names) != 2:
        raise ValueError("'choices' must have two columns")
    sides = [_side(rows, n, "first") for n in names]
    templates, ks, reverse = _paired([p.length for p in sides], flank5, flank3, template, substitutions, strand)
    for t, p in zip(templates, sides):
        if t.lengths != [p.length]:
            raise ValueError(f"the variable region has length {t.lengths}, the barcodes {p.length}")
    pool = _both(rows, names, [p.length for p in sides])
    turns = [("seq1", "seq2"), *([("seq2", "seq1")] if randomized else [])]
    roles = [Role(_pair_places(c, templates, reverse, ks), [pool], ks, find_best, sum(ks), keep_ties=randomized) for c in turns]
    if include_invalid:
        roles += _combo_paired(templates, sides, reverse, ks, find_best, randomized)
    found = matches(reads, roles, kept)
    idx = _idx(0)
    if randomized and find_best:
        none = sum(ks) + 1
        a, b = (F.coalesce(F.col(f"m{n}.total"), F.lit(none)) for n in (0, 1))
        # an ambiguous second orientation with fewer mismatches keeps the first from counting, but not the other way round
        idx = F.when(~_has(0) | (a > b), _idx(1)).when((a == b) & ~_idx(0).eqNullSafe(_idx(1)), F.lit(None)).otherwise(_idx(0))
    elif randomized:
        idx = F.coalesce(_idx(0), _idx(1))
    found = found.withColumn("idx", idx)
    table = _dense(reads, found, rows, every)
    if not include_invalid:
        return CountResult(table, _totals(reads, "npairs"))
    lost = _chosen(found.where("idx is null"), len(turns), find_best, randomized)
    totals = _with_only(_totals(reads, "npairs"), lost, _by(reads))
    lost = _invalid(_by(reads), _summed(lost, _by(reads), "i0", "i1"), rows, names, every)
    return _with_invalid(reads, table, lost, every, totals, "invalid_pair")


def count_random(reads: DataFrame, template: str, substitutions: int = 0, find_best: bool = False, strand: str = "both") -> CountResult:
    """counts of each sequence found in the first variable region, in its order; metadata nreads. best drops reads with two places at the least mismatches."""
    t, by = Template.of(template, fold=False), _by(reads)
    rows = reads.select(*by, sites("seq", t, strands(strand), substitutions, raw=True).alias("found"))
    if find_best and substitutions:
        rows = rows.select(*by, "found", F.array_min(F.transform("found", lambda h: h["cm"])).alias("least"))
        rows = rows.select(*by, F.filter("found", lambda h: h["cm"] == F.col("least")).alias("found"))
    hit = F.when(F.size("found") == 1 if find_best else F.size("found") > 0, F.get("found", F.lit(0)))
    rows = rows.select(*by, hit.alias("h")).select(*by, "h.is_reverse", F.col("h.v")[0].alias("v"))
    # a test of v itself would be pushed down to the scan, where it would search each read again
    rows = rows.groupBy(*by, "is_reverse", "v").agg(F.count("v").alias("w")).where("w > 0")
    odd = F.col("is_reverse") & F.col("v").rlike("[^ACGTN]")
    sequence = F.when(odd, F.raise_error(F.concat(F.lit("cannot complement base in "), F.col("v"))).cast("string")).otherwise(F.col("v"))
    table = rows.select(*by, sequence.alias("sequences"), "w").groupBy(*by, "sequences").agg(F.sum("w").alias("counts"))
    return CountResult(table.orderBy(*by, "sequences"), _totals(reads, "nreads"))


def match_barcodes(sequences: DataFrame, choices, substitutions: int = 0, reverse: bool = False) -> DataFrame:
    """sequences (seq and others) with the 1-based index and the mismatches of the nearest choice; null if none or several."""
    pool = Pool.of(choices, sequences.sparkSession)
    wrong = F.when(F.length("seq") != pool.length, F.raise_error(F.lit("sequences and choices must have the same length")))
    v = reverse_complement(F.col("seq")) if reverse else F.translate("seq", "acgt", "ACGT")
    keyed = sequences.withColumn("v", F.coalesce(wrong.cast("string"), v))
    asked = keyed.select("v").distinct().select("v", F.lit(0).alias("pool"), F.array(F.lit(0), F.lit(0)).alias("c"))
    found = nearest(within(asked, [pool], [[substitutions]]), ["v"], F.lit(pool.policy))
    return keyed.join(found, "v", "left").select(*sequences.columns, (F.col("idx") + 1).alias("index"), F.col("d").cast("long").alias("mismatches"))
