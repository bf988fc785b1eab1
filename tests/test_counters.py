"""Hand-made cases of the counters."""

import pytest
from pyspark.sql import functions as F

from barnacle.operators import counters as C
from barnacle.operators.matrix import combine_combo_counts, matrix_of, matrix_of_dual
from barnacle.operators.pool import Pool
from barnacle.operators.resolve import nearest, seed_places, within
from barnacle.plans.template import Template, parse_template

T = "ACGTNNNNNNNNNNTGCA"
HOMO = [b * 10 for b in "ACGT"]
G1 = ["ACGTGGGGGGGGGGTGCA", "ACGTGGGGCGGGGGTGCA", "ACGTGGGGCCGGGGTGCA", "ACGTGGGGGGGGGGTTCA", "CCGTGGGGGGGGGGTGCA"]
A9, B9 = "A" * 9, "AAAAAACAA"


def reads(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "seq1 string, seq2 string")


def counts(result):
    rows = [r for r in result.table.collect() if r["idx"] is not None]
    return [r["counts"] for r in sorted(rows, key=lambda r: r["idx"])]


def total(result, name="nreads"):
    return result.metadata.first()[name]


def wrap(v):
    return "ACGT" + v + "TGCA"


@pytest.mark.parametrize("best", [False, True])
def test_single_substitutions(spark, best):
    r = C.count_single(reads(spark, G1), HOMO, template=T, substitutions=1, find_best=best)
    assert counts(r) == [0, 0, 4, 0] and total(r) == 5


def test_flanks_are_a_template(spark):
    r = C.count_single(reads(spark, G1), HOMO, flank5="ACGT", flank3="TGCA")
    assert counts(r) == [0, 0, 1, 0]


def test_single_ambiguity(spark):
    r = C.count_single(reads(spark, [wrap("CCCCCCCCC" + x) for x in "CAGT"]), ["CCCCCCCCCC", "CCCCCCCCCA"], template=T, substitutions=1)
    assert counts(r) == [1, 1]


@pytest.mark.parametrize(("k", "want"), [(0, [2, 1, 1, 1]), (1, [3, 2, 1, 1])])
def test_single_iupac(spark, k, want):
    v = ["AAAAACAAAA", "AAAAAGAAAA", "AAAAAAAAAA", "CCCCCACCCC", "CCCCAACCCC", "GGGGGTGGGG", "TTTTTGTTTT"]
    r = C.count_single(reads(spark, map(wrap, v)), ["AAAAABAAAA", "CCCCCDCCCC", "GGGGGHGGGG", "TTTTTVTTTT"], template=T, substitutions=k, strand="original")
    assert counts(r) == want


def test_strands_interleave(spark):
    # a reverse match at place 0 stands before a forward match further right
    forward, backward = wrap("A" * 9 + "C"), "TGCA" + "G" * 10 + "ACGT"
    r = C.count_single(reads(spark, [backward + forward]), ["A" * 9 + "C", "C" * 10], template=T)
    assert counts(r) == [0, 1]
    assert counts(C.count_single(reads(spark, [backward + forward]), ["A" * 9 + "C", "C" * 10], template=T, strand="original")) == [1, 0]


def test_case_short_reads_and_n(spark):
    r = C.count_single(reads(spark, [wrap("G" * 10).lower(), "ACGT", "", wrap("GGGGGNGGGG")]), ["G" * 10, "N" * 9 + "A"], template=T, strand="original")
    assert counts(r) == [1, 0] and total(r) == 4
    r = C.count_single(reads(spark, [wrap("GGGGGNGGGG")]), ["G" * 10], template=T, substitutions=1)
    assert counts(r) == [1]
    # a read's N is a mismatch against a barcode's N too
    assert counts(C.count_single(reads(spark, [wrap("ANAAAAAAAA")]), ["ANAAAAAAAA"], template=T, substitutions=0)) == [0]


def test_pools_are_checked(spark):
    with pytest.raises(ValueError, match="same length"):
        Pool.of(["AA", "AAA"], spark)
    with pytest.raises(ValueError, match=r"duplicate sequences detected \(1, 3\)"):
        Pool.of(["AANA", "CCCC", "aata"], spark)
    with pytest.raises(ValueError, match=r"duplicate sequences detected \(1, 2\)"):
        Pool.of(["N" * 12, "A" * 12], spark)
    with pytest.raises(ValueError, match="unknown base"):
        Pool.of(["AXA"], spark)
    with pytest.raises(ValueError, match="unknown base"):
        Template.of("ACGZNNN")
    with pytest.raises(ValueError, match="strand"):
        C.count_single(reads(spark, []), HOMO, template=T, strand="up")


@pytest.mark.parametrize(
    ("k", "reverse", "seqs", "index", "mismatches"),
    [
        (0, False, ["AAAAAA", "AAATAA"], [1, None], [0, None]),
        (1, False, ["AAAAAA", "AAATAA"], [1, 1], [0, 1]),
        (0, True, ["AAAAAA", "AAATAA"], [4, None], [0, None]),
        (1, True, ["AAAAAA", "AAATAA"], [4, 4], [0, 1]),
    ],
)
def test_match(spark, k, reverse, seqs, index, mismatches):
    df = spark.createDataFrame(list(enumerate(seqs)), "n int, seq string")
    rows = C.match_barcodes(df, [b * 6 for b in "ACGT"], k, reverse).orderBy("n").collect()
    assert [r["index"] for r in rows] == index and [r["mismatches"] for r in rows] == mismatches


@pytest.mark.parametrize(("k", "reverse", "index", "mismatches"), [(0, False, [1, 1, None], [0, 0, None]), (0, True, [None, None, 4], [None, None, 0]), (2, True, [4, 4, 4], [1, 2, 0])])
def test_match_iupac(spark, k, reverse, index, mismatches):
    df = spark.createDataFrame(list(enumerate(["AAAAAA", "AAAGAA", "AAGAAA"])), "n int, seq string")
    rows = C.match_barcodes(df, ["AAARAA", "CCCYCC", "GGGMGG", "TTTSTT"], k, reverse).orderBy("n").collect()
    assert [r["index"] for r in rows] == index and [r["mismatches"] for r in rows] == mismatches


@pytest.mark.parametrize(("k", "want"), [(1, {"GGGGGC": 1, "GGGGGG": 1}), (2, {"GGGGCC": 1, "GGGGGC": 1, "GGGGGG": 1})])
def test_random(spark, k, want):
    r = C.count_random(reads(spark, ["AAAAACGTGGGGGGACGTGGGG", "AAATACGTGGGGGCACGTGGGG", "AAATACGTGGGGCCACGTGGGC"]), "AAAAACGTNNNNNNACGTGGGG", k)
    assert {x["sequences"]: x["counts"] for x in r.table.collect()} == want


def test_random_reverse_with_unequal_flanks_and_ties(spark):
    # AAAAAC + v + TT, on the other strand AA + rc(v) + GTTTTT
    r = C.count_random(reads(spark, ["AA" + "GTCC" + "GTTTTT"]), "AAAAACNNNNTT")
    assert [x["sequences"] for x in r.table.collect()] == ["GGAC"]
    two = "ACACNNNNCCCC".replace("NNNN", "TTGG")
    assert not C.count_random(reads(spark, [two + two]), "ACACNNNNCCCC", find_best=True).table.collect()
    assert C.count_random(reads(spark, [two + two]), "ACACNNNNCCCC").table.first()["counts"] == 1


def test_combo_and_best(spark):
    t = "ACGTNNNNAAAANNNTGCA"
    seqs = ["ACGTCCCCAAAAGGGTGCA", "ACGTCCCCAAAAGGGTGCA", "ACGTGGGGAAAATTTTGCA"]
    seqs.append(seqs[2].translate(str.maketrans("ACGT", "TGCA"))[::-1])
    r = C.count_combo(reads(spark, seqs), t, {"a": ["CCCC", "GGGG"], "b": ["GGG", "TTT"]})
    assert {(tuple(x["combinations"]), x["counts"]) for x in r.table.collect()} == {(("CCCC", "GGG"), 2), (("GGGG", "TTT"), 2)}
    near = "ACGTCNCCAAAAGGGTGCA" + "GATC" + "ACGTGGGGAAAATTTTGCA"
    one = lambda best: [tuple(x["combinations"]) for x in C.count_combo(reads(spark, [near]), t, [["CCCC", "GGGG"], ["GGG", "TTT"]], 1, best, indices=True).table.collect()]
    assert one(False) == [(1, 1)] and one(True) == [(2, 2)]


@pytest.mark.parametrize(("k", "want"), [(0, [0, 0, 1, 0]), (1, [0, 0, 2, 0]), (2, [0, 0, 3, 0])])
def test_dual_single_end(spark, k, want):
    t = "ACGTNNNNNNNNNNTGCAAGGANNNNNNNNNNNNNNNAGGA"
    seqs = ["ACGTGGGGGGGGGGTGCAAGGAAAAAAAAAAAAAAAAAGGA", "ACGTGGGGGGGGGGTGCAAGGAAAAAAAAAAATAAAAAGGA", "ACGTGGGGCGGGGGTGCAAGGAAAAAAAAAAATAAAAAGGA"]
    assert counts(C.count_dual(reads(spark, seqs), {"x": HOMO, "y": ["A" * 15] * 4}, t, k)) == want


DUAL = ["ACGTGGGGGGGGGGTGCA", "ACGTGGGGCGGGGGTGCA", "ACGTGGGGGGGGGTGCA", "ACGTGGGGGGGGGGGTGCA"], ["ACGTGGGGCGGGGGTGCA", "ACGTGGGGGGGGGGTGCA", "ACGTGGGGGGGGGGGTGCA", "ACGTGGGGGGGGGTGCA"]


@pytest.mark.parametrize(("mates", "k", "want"), [((0, 0), 0, 1), ((0, 0), 1, 2), ((0, 1), 0, 0), ((0, 1), (0, 1), 1), ((0, 1), (1, 0), 1), ((0, 1), 1, 2)])
def test_dual_edits(spark, mates, k, want):
    df = pairs(spark, list(zip(*(DUAL[m] for m in mates))))
    assert sum(counts(C.count_dual_paired(df, {"x": HOMO, "y": HOMO}, template=T, substitutions=k))) == want


@pytest.mark.parametrize(("k", "randomized", "rows", "want"), [(0, False, 1, [1]), (0, True, 1, [1]), ((1, 0), False, 1, [2]), ((0, 1), False, 1, [2]), ((0, 1), True, 1, [3]), (1, True, 2, [2, 2])])
def test_dual_orientation(spark, k, randomized, rows, want):
    df = pairs(spark, list(zip([A9, A9, B9, B9], [A9, B9, A9, B9])))
    choices = {"x": [A9, B9][:rows], "y": [A9, A9][:rows]}
    assert counts(C.count_dual_paired(df, choices, template="-" * 9, substitutions=k, randomized=randomized)) == want


def test_caps_choose_among_candidates(spark):
    # the first row is as near in total, but beyond the second mate's cap
    r = C.count_dual_paired(pairs(spark, [("AAAA", "CCCG")]), {"x": ["AAAA", "AAAT"], "y": ["CCCC", "CCCG"]}, template="----", substitutions=(1, 0))
    assert counts(r) == [0, 1]


def test_dual_invalid_and_totals(spark):
    df = pairs(spark, [("AAAA", "CCCC"), ("AAAA", "GGGG"), ("AAAA", "TATA"), ("TATA", "GGGG"), ("TATA", "TATA")])
    r = C.count_dual_paired(df, {"x": ["AAAA", "CCCC"], "y": ["CCCC", "GGGG"]}, template="----", include_invalid=True)
    rows = {(x["x"], x["y"], x["valid"]): x["counts"] for x in r.table.collect()}
    assert rows == {("AAAA", "CCCC", True): 1, ("CCCC", "GGGG", True): 0, ("AAAA", "GGGG", False): 1}
    assert r.metadata.first().asDict() == {"npairs": 5, "barcode1_only": 1, "barcode2_only": 1, "invalid_pair": 1}


def test_samples_make_a_matrix(spark):
    df = spark.createDataFrame([("a", wrap("G" * 10)), ("b", wrap("G" * 10)), ("b", wrap("A" * 10)), ("b", "T")], "sample string, seq string")
    m = matrix_of(C.count_single(df, HOMO, template=T), ["idx", "choices"], True)
    assert [(r["a"], r["b"]) for r in m.wide().orderBy("idx").collect()] == [(0, 1), (0, 0), (1, 1), (0, 0)]
    assert {tuple(r) for r in m.col_data.select("sample", "nreads", "nmapped").collect()} == {("a", 1, 1), ("b", 3, 2)}


def test_combine(spark):
    t = lambda rows: spark.createDataFrame(rows, "combinations struct<x:string,y:string>, counts long")
    out = combine_combo_counts({"p": t([(("A", "B"), 1), (("C", "D"), 2)]), "q": t([(("C", "D"), 5)])}).collect()
    assert [(tuple(r["combinations"]), r["p"], r["q"]) for r in out] == [(("A", "B"), 1, 0), (("C", "D"), 2, 5)]
    with pytest.raises(ValueError, match="unique"):
        combine_combo_counts({"p": t([(("A", "B"), 1), (("A", "B"), 2)])})


def test_parse():
    assert parse_template("AAAANNNNCCCCNNGGGG") == {"variable": [(5, 4), (13, 2)], "constant": ["AAAA", "CCCC", "GGGG"]}
    assert parse_template("NN") == {"variable": [(1, 2)], "constant": ["", ""]}
    with pytest.raises(ValueError, match="no stretches of Ns"):
        parse_template("ACGT")


def test_reads_may_hold_anything(spark):
    df = reads(spark, ["ß" * 30, "é" + wrap("G" * 10), None, "\r\n" + wrap("G" * 10)]).withColumn("idx", F.lit(1))
    assert counts(C.count_single(df, HOMO, template=T)) == [0, 0, 2, 0]


def test_combined_tables_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(("A", "B"), 1), (("C", "D"), 2)], "combinations struct<x:string,y:string>, counts long")
    rows = rows.coalesce(1).mapInPandas(counted, rows.schema)
    assert [(tuple(r["combinations"]), r["p"]) for r in combine_combo_counts({"p": rows}).collect()] == [(("A", "B"), 1), (("C", "D"), 2)]
    assert made.value == 2


def test_equal_regions_are_looked_up_once(spark):
    # 4,000 reads, 80 of 50 regions each, two barcodes in ten copies: candidates are pairs of different regions and barcodes
    x, y = ["".join("ACGT"[i // 4**j % 4] for j in range(6)) for i in range(80)], ["".join("ACGT"[i // 4**j % 4] for j in range(5)) for i in range(50)]
    df = reads(spark, ["ACGT" + a + "TT" + b + "GGCA" for a in x for b in y])
    rows = {"x": [a for a in x for _ in range(10)], "y": [y[i % 50] for i in range(800)]}
    r = C.count_dual(df, rows, "ACGT" + "N" * 6 + "TT" + "N" * 5 + "GGCA", 0, strand="original", include_invalid=True)
    assert sum(r["counts"] for r in r.table.collect()) == 4000 and total(r, "invalid_reads") == 4000 - len(set(zip(rows["x"], rows["y"])))
    seen = []
    inner = C.within
    try:
        C.within = lambda rows, *a: seen.append(inner(rows, *a)) or seen[-1]
        C.count_dual(df, rows, "ACGT" + "N" * 6 + "TT" + "N" * 5 + "GGCA", 0, strand="original", include_invalid=True)
    finally:
        C.within = inner
    assert seen[0].where("pool > 0").count() == 80 + 50


@pytest.mark.parametrize("policy", ["first", "last", "none"])
@pytest.mark.parametrize(("segments", "caps"), [([5], [1]), ([5], [2]), ([5], [0]), ([3, 2], [1, 1]), ([3, 2], [1, 0]), ([3, 2], [2, 1])])
def test_nearest_in_a_crowded_pool(spark, policy, segments, caps):
    # a pool that fills most of its space has more parts than k + 1; its equal barcodes are one candidate
    text = lambda i: "".join("ACGT"[i // 4**j % 4] for j in range(5))
    barcodes = [text(i * 37 % 700) for i in range(900)]
    pool = Pool(spark.createDataFrame(list(enumerate(barcodes)), "idx long, barcode string"), policy, segments)
    assert all(len({a for a, b in places for a in range(a, b)}) for places in seed_places(pool, caps))
    asked = [text(i) for i in range(0, 1024, 9)]
    rows = spark.createDataFrame([(v, 0, [0, 0]) for v in asked], "v string, pool int, c array<int>")
    got = {r["v"]: (r["idx"], r["d"]) for r in nearest(within(rows, [pool], [caps]), ["v"], F.lit(policy)).collect()}
    edges, want = [0, *(sum(segments[: i + 1]) for i in range(len(segments)))], {}
    for v in asked:
        near = []
        for i, b in enumerate(barcodes):
            each = [sum(x != y for x, y in zip(v[s:e], b[s:e])) for s, e in zip(edges, edges[1:])]
            if all(d <= k for d, k in zip(each, caps)):
                near.append((sum(each), i))
        best = [i for d, i in near if d == min(near)[0]]
        if best and (policy != "none" or len(best) == 1):
            want[v] = ({"first": min(best), "last": max(best), "none": best[0]}[policy], min(near)[0])
    assert got == want


def test_files_with_invalid_are_summed_once(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@r\n{x}\n+\n{'I' * len(x)}\n" for x in ("ACGTAAAATTCCCCGGCA", "ACGTAAAATTGGGGGGCA")))
    kept, inner = [], C.matches
    monkeypatch.setattr(C, "matches", lambda reads, roles, keep=False: kept.append(keep) or inner(reads, roles, keep))
    m = matrix_of_dual(spark, [str(path)], {"x": ["AAAA", "CCCC"], "y": ["CCCC", "GGGG"]}, "ACGTNNNNTTNNNNGGCA", include_invalid=True)
    assert {(r["x"], r["y"], r["valid"]): r["counts"] for r in m.counts.collect()} == {("AAAA", "CCCC", True): 1, ("CCCC", "GGGG", True): 0, ("AAAA", "GGGG", False): 1}
    plan = m.counts._jdf.queryExecution().executedPlan().toString()
    assert kept == [True] and "InMemoryTableScan" in plan
