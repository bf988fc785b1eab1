"""Operators against brute force, exact round trips and held-out accuracy, on small tables with every odd case."""

import hashlib
import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from barnacle.llm import binary, bpe, common, kneser, neardup, packing, quality, sharding, toxicity, urls, vectors  # noqa: E402
from barnacle.llm.gbt import Trees  # noqa: E402
from barnacle.llm.graph import components  # noqa: E402
from barnacle.llm.sketch import sketch  # noqa: E402
from barnacle.llm.tokens import tokens_of  # noqa: E402

RNG = random.Random(7)
WORDS = ["".join(RNG.choice(["the", "in", "ti", "on", "er", "blé", "x"]) for _ in range(RNG.randrange(1, 4))) for _ in range(400)]
PROSE = [" ".join(RNG.choice(WORDS) for _ in range(n)) for n in (3, 30, 80, 80, 200)]
EDITED = PROSE[4].split()
EDITED[50] = "changed"
ODD = [None, "", " \n\t ", "a", "a  b   c ", "\u0085 x\u00a0y", "ab" * 4000, "one two three one two three\n\nline\nline\n", "#*$%&|<> !!", "日本 é\u0301 İ Σ\u0345", "word " * 60]
TEXTS = [*ODD, *PROSE, PROSE[2], PROSE[4], " ".join(EDITED), PROSE[4].upper()]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, `group` string, shard int, score double, text_crc32 string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, None if i % 5 == 0 else "en", "s", 1, "g", 1, 0.5, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "a", "en", "s", 1, "g", 1, 0.5, "x"), (None, PROSE[3], "en", "s", 1, "g", 1, 0.5, "x"), (None, None, None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i >= len(ODD)), int(i % 7 == 0)) for i in range(len(TEXTS))] + [(None, 1, 1), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(t):
    return (t or "").encode().split()


def test_quality_counts(docs, labels):
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    got = Counter(tuple(r)[:7] for r in rows)
    want = Counter()
    for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()):
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        n, failed = len(w), len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[d, n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert got == want
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(3000) > 0).astype(float)
    t = Trees([1, -1, 0]).fit(x, y)
    assert ((t.predict(x) > 0.5) == y).mean() > 0.8
    for f, way in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 21, axis=0)
        grid[:, f] = np.tile(np.linspace(-0.5, 1.5, 21), 50)
        assert (way * np.diff(t.predict(grid).reshape(50, 21), axis=1) >= -1e-12).all()


def test_trees_score_as_a_plain_walk_does():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((800, 4)), 1)  # with many ties at the thresholds
    t = Trees([0, -1, 0, 1], trees=12).fit(x, (x[:, 0] + x[:, 3] > x[:, 1] + 0.5).astype(float))
    assert (t.feature >= 0).any()
    for row, got in zip(x[:200], t.predict(x[:200])):
        score = t.base
        for feature, threshold, value in zip(t.feature, t.threshold, t.value):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            score += value[node]
        assert got == pytest.approx(1 / (1 + math.exp(-score)))
    assert len(t.predict(x[:0])) == 0


def test_toxicity_separates_held_out(spark, docs, labels):
    rng = random.Random(3)
    plain = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows = []
    for i in range(900):
        w, bad = plain(60), i % 3 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["scoundrel", "nitwit", "zzyq" + rng.choice(WORDS)])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([out[i]["predicted"] == t for i, _, t in held]) > 0.95
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_is_a_comparison_of_window_lengths():
    rng = random.Random(9)
    text = lambda: [rng.choice(WORDS) for _ in range(40)]
    insert = lambda w, x: " ".join([*w[:7], x, *w[7:]])
    ordinary = [" ".join(text()) for _ in range(400)]
    toxic = [insert(text(), rng.choice(["scoundrel", "abscheulich", "malvadisimo"])) for _ in range(400)] + [insert(text(), "once" + str(i)) for i in range(40)] + [insert(PROSE[4].split(), "copied")] * 30
    rng.shuffle(toxic)
    # a word of one document, or of copies of one document, says nothing
    assert {x.strip() for x in toxicity.unexplained(toxic, ordinary)} == {b"scoundrel", b"abscheulich", b"malvadisimo"}
    model = toxicity.fit(toxic, ordinary)
    made, plain = model.parts
    # both dictionaries are what the library makes of the windows
    samples = [w for t in ordinary[::2] for w in toxicity.windows(t)]
    random.Random(0).shuffle(samples)
    assert plain == toxicity.Z.train_dictionary(toxicity.ORDINARY, samples).as_bytes()
    assert made in [toxicity.toxic_dictionary(toxicity.unexplained(toxic[::2], ordinary[::2]), n) for n in toxicity.SIZES]
    long = " ".join(text() * 500)
    lengths = [toxicity.Gains._compressor(d) for d in (plain, made + plain)]
    for t in (*toxic[:20], *ordinary[:20], None, "", " \n", long, insert(long.split(), "scoundrel"), toxic[0].upper()):
        w = [x.lower() for x in words(t)]
        cut = [b" " + b" ".join(w[i : i + 16]) + b" " for i in range(0, len(w), 16)]
        gains = sorted((len(lengths[0].compress(x)) - len(lengths[1].compress(x)) for x in cut), reverse=True)
        top = [max(0, g) for g in (*gains, 0, 0, 0)][:3]
        want = model.weights[0] + sum(c * (g - m) / s for c, g, m, s in zip(model.weights[1:], top, model.mean, model.scale))
        assert model.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, want)))))


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "https://A.Example.com/en/1", None), (2, "http://www.example.com/en/2?q", ""), (3, "x://b.net/es/", link("far.org")), (4, "x://net/fr", link("friend.org")),
        (5, "http://c.com", ""), (6, None, None), (7, "no scheme", ""), (8, "https://bad.org/a", link("only.net", "b.net")), (9, "https://friend.org/#f", link("bad.org")), (1, "https://A.Example.com/en/1", None),
        (10, "https://only.net/es/", ""),
    ]
    out = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    # bad.org links to nothing but hosts with blocked pages, friend.org to nothing but bad.org, net to nothing but friend.org
    assert all(got[n][2:] == (None, "block") for n in (8, 9, 4))
    seeds = spark.createDataFrame([("a", 1, 0), ("c", 0, 2)], "node string, trust long, distrust long")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "c", 2)], "src string, dst string, w long")
    found = {r["node"]: (r["trust"], r["distrust"]) for r in urls.propagate(seeds, edges, steps=3).collect()}
    trust, distrust = {"a": 1.0}, {"c": 2.0}
    for _ in range(3):
        trust = {"a": 1.0, "b": 0.85 * trust.get("a", 0) / 4, "c": 0.85 * (trust.get("a", 0) * 3 / 4 + trust.get("b", 0))}
        distrust = {"c": 2.0, "b": 0.85 * distrust.get("c", 0) * 2 / 5, "a": 0.85 * (distrust.get("c", 0) * 3 / 5 + distrust.get("b", 0))}
    for n in "abc":
        assert found[n] == pytest.approx((trust[n], distrust[n]))


def test_shared_distrust_blocks_all_who_link(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rules = [("block", "bad.org/"), ("block", "mixed.org/no/"), ("allow", "good.org/"), ("allow", "liked.org/in/")]
    rows = [("https://bad.org/", None), ("https://one.org/", link("bad.org")), ("https://two.org/", link("bad.org")), ("https://big.org/1", link("bad.org")), ("https://big.org/2", None), ("https://big.org/3", None)]
    rows += [(f"https://good.org/{i}", link("news.org", "liked.org")) for i in range(20)] + [("https://news.org/", link("bad.org")), ("https://liked.org/a", link("bad.org")), ("https://liked.org/in/a", None)]
    rows += [("https://mixed.org/no/", None), *((f"https://mixed.org/{i}", None) for i in range(5)), ("https://far.org/", link("one.org")), ("https://apart.org/", None)]
    # a and b link to each other, and one of them to a blocked host: walks go round for long
    rows += [("https://a.net/", link("b.net")), ("https://b.net/", link("a.net", "bad.org"))]
    out = urls.url_verdicts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string"), rules).collect()
    assert len(out) == len(rows)
    got = {(r["host"], r["rule"] is None): r["verdict"] for r in out}
    assert {h for (h, unruled), v in got.items() if unruled and v == "block"} == {"one.org", "two.org", "big.org", "far.org", "a.net", "b.net"}
    seeds = spark.createDataFrame([("a", 1, 0)], "node string, trust long, distrust long")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, w long")
    found = {r["node"]: r["trust"] for r in urls.propagate(seeds, edges).collect()}
    assert found["a"] == pytest.approx(1 / (1 - 0.85**2), rel=1e-3)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200):
        common, x, y = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(3))
        a, b = (sketch(np.unique(np.concatenate([common, z]))) for z in (x, y))
        assert 0.1 < (a == b).mean() < 0.6  # a third
        assert (a == sketch(np.unique(np.concatenate([common, x])))).all()


def shingles(t, k):
    w = [x.lower() for x in words(t)]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    rng = random.Random(k)
    base = [[rng.choice(WORDS) for _ in range(120)] for _ in range(6)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(160):  # copies, near copies and documents that share passages
        w = list(base[i % 6])
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(w[: rng.choice([60, 110, 120, 120])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    sets = [(d, shingles(t, k)) for d, t in rows]
    label = {i: i for i in range(len(rows))}
    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if d is not None and e is not None and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = {n: y if v == x else v for n, v in label.items()}
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    want = Counter((d, len(s), least[label[i]] if d is not None else None, d is None or d == least[label[i]]) for i, (d, s) in enumerate(sets))
    assert Counter(tuple(r) for r in neardup.near_duplicates(df, k).collect()) == want


def test_near_dedup_keeps_one_row_of_a_group(spark):
    from corpus_pipeline import near_dedup

    long = PROSE[4].split()
    copy = " ".join([*long[:-1], "other"])
    unique, third = " ".join(long[::-1]), " ".join(sorted(long))
    rows = [
        (1, PROSE[4], "a"), (2, copy, "b"), (2, unique, "c"),  # the second doc 2 is no copy of anything
        (3, third, "d"), (3, third, "e"), (None, third, "f"), (None, PROSE[2], "g"), (None, PROSE[2], "h"),
        (4, None, "i"), (4, None, "j"), (5, "", "k"), (5, "", "l"), (None, None, "m"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = near_dedup(spark, df, "")
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, PROSE[4]), (2, unique), (3, third), (None, PROSE[2]), (4, None), (4, None), (5, ""), (5, ""), (None, None)])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: v for n, v in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_components_of_many_partitions(spark):
    # a step leaves no folder, and its many small files are few tasks for the next one
    edges = [(i, i + 1) for i in range(300)]
    made = len(common._made)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame(edges, "a long, b long"))
        assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(301)}
        assert len(common._made) == made + 1
        assert found.where("node <> label").select("node").rdd.getNumPartitions() < 80  # two uses
        assert len(found.inputFiles()) > 30
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


HELD = r"""
import re, sys
import pyarrow as pa
from barnacle.llm import common


def mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def task(batches):
    held = [bytes(50_000) for _ in range(4000)]
    top.append(bytes(50_000))  # lies after them and stays, so that the C library's heap can't just shrink
    yield from batches


top, before = [], mb()
list((getattr(common, sys.argv[1]) if len(sys.argv) > 1 else lambda f: f)(task)(iter([pa.record_batch([pa.array([1])], ["a"])])))
print(mb() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_tasks_give_memory_back():
    run = lambda *a: float(subprocess.run([sys.executable, "-c", HELD, *a], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert run() > 100 > 50 > run("lean")


def test_bounded(spark):
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "parquet.hadoop.vectored.io.enabled")
    sizes = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text")).mapInArrow(lambda bs: (b.select([]).append_column("n", pa.array([b.nbytes] * len(b))) for b in bs), "n long")
    most = lambda: sizes.agg(F.max("n")).first()[0]
    for k in keys:
        spark.conf.unset(k)
    assert most() > 5 * common.SMALL
    common.bounded(spark)
    assert most() < 1.2 * common.SMALL and spark.conf.get(keys[1]) == "false"
    try:
        spark.conf.set(keys[0], "1m")
        spark.conf.set(keys[1], "true")
        common.bounded(spark)  # what the session has stays
        assert most() < 1.2 * 2**20 and spark.conf.get(keys[1]) == "true"
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tree, cache = bpe.loaded(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})
    rows = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in ("ab", "aé \n", "the in\t  ons日本'sS12!?") for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_those_of_the_library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice("aA éÉ\n\t 'sS.12ΣİÅ\u030a\u0345") for _ in range(rng.randrange(50))) for _ in range(500)] + ["x<|endoftext|> y", " a", "a ", "\n", "a\n\n  b", "12½ ²a1", "A'sÀÞ×÷ßÿ", "x" * 20_000]
    texts += ["".join(rng.choice("aA éÉ\n\t sS.12½À×") for _ in range(rng.randrange(50))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens_of(public_tokenizers.path(name)).ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    for n in (1, 7, 4096):
        for top in (1, 2, 300, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.02] = 2**32 - 1
            got, at = binary.decode_block(memoryview(data := binary.encode_block(ids)), 0)
            assert (got == ids).all() and at == len(data)


def test_token_files(spark, docs, tmp_path):
    path, tokenizer = str(tmp_path / "ids"), public_tokenizers.path("word_bpe_49k.json")
    binary.write_ids(docs, path, tokenizer, 2)
    read = binary.read_ids(spark, path).orderBy("file", "start").collect()
    given = docs.collect()
    assert [r["doc_id"] for r in read] == sorted((r["doc_id"] for r in given), key=lambda d: (d is not None, d or 0))
    ids = dict.fromkeys(())
    ids = Counter((r["doc_id"], x + (2).to_bytes(4, "little")) for r, x in zip(given, tokens_of(tokenizer).ids([r["text"] for r in given])))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in read) == ids
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in read)


def test_packer_is_best_fit():
    rng = random.Random(1)
    for windows, fill in ((1, False), (4, False), (4, True)):
        got, free, want = [], [], []
        packer = packing.Packer(lambda pieces: got.append([(p[0], p[1], len(p[3]) // 4) for p in pieces]), 100, windows, fill)

        def put(k, p, free=free, want=want):
            free[k].append(p)
            if sum(x[2] for x in free[k]) == 100:
                want.append(free[k])
                free[k] = free[-1]
                free.pop()

        for d in range(300):
            n = rng.randrange(1, 260)
            packer.add(d, bytes(4 * n))
            want += [[(d, i, 100)] for i in range(0, n // 100 * 100, 100)]
            rest = [(d, n // 100 * 100, n % 100)] if n % 100 else []
            while rest:
                (i, start, m), room = rest.pop(), [100 - sum(x[2] for x in w) for w in free]
                fits = [r for r in room if r >= m]
                if fits:
                    put(room.index(min(fits)), (i, start, m))
                elif len(free) < windows:
                    free.append([])
                    put(len(free) - 1, (i, start, m))
                else:
                    k = room.index(min(room))
                    if fill:
                        part = room[k]
                        put(k, (i, start, part))
                        rest.append((i, start + part, m - part))
                    else:
                        want.append(free[k])
                        free[k] = [(i, start, m)]
        assert got == want
        if windows == 4:
            assert sum(p[2] for s in got for p in s) > 0.9 * 100 * len(got)


@pytest.mark.parametrize("windows", [1, 3, 32])
def test_packing(docs, windows):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, tokenizer, length=128, windows=windows).collect()
    given = docs.collect()
    whole = Counter((r["doc_id"], x + b"\0\0\0\0") for r, x in zip(given, tokens_of(tokenizer).ids([r["text"] for r in given])))
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sum(len(x["ids"]) // 4 for x in sequences.get(r["sequence_id"], []))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append(r)
    sizes = [sum(r["length"] for r in s) for s in sequences.values()]
    assert max(sizes) <= 128 and sum(s < 128 for s in sizes) <= 1
    assert sum(sizes) * 4 == sum(len(x) * n for (_, x), n in whole.items())
    unique = [k for k, n in whole.items() if n == 1 and k[0] is not None and k[0] != 3]
    for d, x in unique:
        assert b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])) == x


def test_kneser_ney(spark, docs, labels):
    out = kneser.judged(kneser.perplexities(docs.select("doc_id", "lang", "text"), labels, ["doc_id", "lang"]), labels).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    counts = Counter()
    trained = {r["doc_id"] for r in spark.range(len(TEXTS)).toDF("doc_id").where(~kneser.sets_thresholds()).collect()}
    for i in sorted(trained & set(range(len(ODD), len(TEXTS)))):
        b = b"\0\0\0" + text[i].encode()
        counts.update(b[j : j + 4] for j in range(len(b) - 3))
    tables = [counts]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))
    levels = []
    for t in reversed(tables):
        n = [sum(v == k for v in t.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [max(0.0, min(k - 0.05, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5)) for k in (1, 2, 3)]
        total, mass = Counter(), Counter()
        for g, v in t.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1]
        levels.append((t, d, total, mass))

    def p(g, level):
        if level < 0:
            return 1 / 256
        t, d, total, mass = levels[level]
        below = p(g[1:], level - 1)
        if g[:-1] not in total:
            return below
        v = t.get(g, 0)
        return ((v - d[min(v, 3) - 1]) if v else 0) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * below

    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            b = (text[r["doc_id"]] or "").encode()
            if not b:
                assert r["perplexity"] is None and not r["kept"]
                continue
            x = b"\0\0\0" + b
            want = math.exp(-sum(math.log(p(x[i : i + 4], 3)) for i in range(len(b))) / len(b))
            assert r["perplexity"] == pytest.approx(want, rel=1e-6)
    # probabilities of all bytes after a context sum to 1
    assert sum(p(b"the" + bytes([i]), 3) for i in range(256)) == pytest.approx(1)
    kept = kneser.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)


def test_unseen_bytes_have_probability_at_any_size(spark):
    code = lambda b: int.from_bytes(b, "big")
    rows = [(code(b"aaa" + bytes([i])), 4) for i in range(65, 85)] + [(code(b"bbb" + bytes([i])), i - 64) for i in (65, 66, 67)]
    wanted = spark.createDataFrame([(code(b"aaaz"),), (code(b"aaaA"),)], "code long")
    p = [r["p"] for r in kneser.probabilities(spark.createDataFrame(rows, "code long, n long"), wanted).collect()]
    assert len(p) == 2 and all(0 < x < 1 for x in p)


def test_thresholds_withstand_odd_documents(spark):
    ids = [r["doc_id"] for r in spark.range(3000).toDF("doc_id").where(kneser.sets_thresholds()).limit(305).collect()]
    assert len(ids) == 305
    rows = [(d, "en", 10, 5.0 + i % 100 / 100) for i, d in enumerate(ids[:300])] + [(d, "es", 10, 5.5) for d in ids[300:304]]
    rows[7], odd = (ids[7], "en", 10, 40.0), (ids[304], "es", 10, 30.0)  # one odd trusted document of each language
    fresh = [(10_000 + i, lang, 10, p) for i, (lang, p) in enumerate((x, p) for x in ("en", "es", "fr", None) for p in (4.5, 5.5, 8.0, 20.0))]
    scored = spark.createDataFrame([*rows, odd, *fresh], "doc_id long, lang string, n_bytes long, perplexity double")
    out = kneser.judged(scored, spark.createDataFrame([(d, 1) for d in ids], "doc_id long, quality int")).collect()
    assert len(out) == len(scored.collect())
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert [kept[d] for d, *_ in fresh] == [True, True, False, False] * 4
    assert all(kept[d] for d, _, _, p in rows if p < 6)


def test_places_by_dot_product():
    rng = np.random.default_rng(3)
    share = rng.random((200, 3)) / 100
    share[150:, 1:] = share[150:, :1]  # items as large in each dimension
    share[20] = share[7]
    weights = np.array([1.0, 0.25, 0.25])
    left = [[1 / 8] * 3 for _ in range(8)]
    want = [0] * 200
    for i in sorted(range(200), key=lambda i: -max(share[i])):
        fit = [sum(w * x * r for w, x, r in zip(weights, share[i], room)) for room in left]
        want[i] = max(range(8), key=lambda s: (fit[s], -s))
        left[want[i]] = [r - x for r, x in zip(left[want[i]], share[i])]
    assert sharding.place(share, np.full((8, 3), 1 / 8), weights).tolist() == want


@pytest.mark.parametrize("heavy", [sharding.HEAVY, 20])
def test_shards(spark, docs, heavy):
    rows = [(i, "t%d" % (i % 400) * (1 + i % 9)) for i in range(3000)] + [(5000 + i, "hot text") for i in range(1500)]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        out = sharding.vector_shards(df, heavy=heavy, section=150).collect()
        assert len(out) == df.count() and {r["shard"] for r in out} <= set(range(8))
        for s in range(8):
            own = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
            assert [r["slot"] for r in own] == list(range(len(own)))
            ids = [r["doc_id"] for r in own]
            assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    sizes, counts = Counter(), Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    for n in (sizes, counts):
        assert max(n.values()) - min(n.values()) < (0.02 if n is sizes else 0.1) * sum(n.values()) / 8
    text, placed = dict(rows), {}
    for r in out:
        placed.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    # only the group with a third of all rows, which no shard has room for, is split
    assert all(len(s) == 1 for t, s in placed.items() if t != "hot text") and len(placed["hot text"]) > 1


def test_collisions_find_near_pairs_and_drop_others():
    rng = np.random.default_rng(4)
    for dim in (32, 64, 384):
        x, y, z = rng.standard_normal((3, 2000, dim))
        x, y, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y, z))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        w, least = vectors.window(0.95), vectors.calibrate(0.95)
        px, py, pz = (vectors.projections(v) for v in (x, y, z))
        near, far = (np.abs(px - p) <= w for p in (py, pz))
        assert 0.6 < near.mean() < 0.75 and far.mean() < 0.25  # a window drops most random pairs
        assert least > 20 and (near.sum(axis=0) >= least).mean() > 0.998 and (far.sum(axis=0) >= least).mean() < 0.001  # and the count nearly all
        assert (vectors.collisions(px[:, :50], py[:, :40], w) == (np.abs(px[:, :50, None] - py[:, None, :40]) <= w).sum(axis=0)).all()
        a, b = vectors.strongest(x), vectors.strongest(y)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.99


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((260, 24))
    near = [b + 0.12 * rng.standard_normal(24) for b in base[:60] for _ in range(3)] + [base[0] + 0.1 * rng.standard_normal(24) for _ in range(120)]
    x = [*base, *near, base[3], base[3] * 1e200, base[4] * 1e-200]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    out = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    u = np.array([v / np.abs(v).max() for v in x])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    assert link.sum() > 15_000
    want = link.sum(axis=1) - 1
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    for i in range(1000, 1000 + len(odd)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert out[None]["component_id"] is None and out[None]["kept"]


def test_empty_tables(spark, docs, labels, tmp_path):
    none, no_labels = docs.limit(0), labels.limit(0)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    binary.write_ids(none, str(tmp_path / "none"), tokenizer, 2)
    results = [
        quality.quality_rules(none, no_labels), toxicity.toxicity(none, toxicity.train(none, no_labels)), neardup.near_duplicates(none), packing.pack(none, tokenizer), sharding.vector_shards(none),
        bpe.digests(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), binary.read_ids(spark, str(tmp_path / "none")), kneser.quality_filter(none, no_labels),
        urls.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")), vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [df.count() for df in results] == [0] * len(results)


@pytest.mark.parametrize("name", ["op4_near_duplicates", "op10_near_vectors"])
def test_queries_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = entry.queries()[name](spark, sf), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(found.fetchall())


def test_pipeline_stages(spark, docs, labels, tmp_path):
    from corpus_pipeline import STAGES, run

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, key = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda r: (r["doc_id"], r["text"])
    for n, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        before, after = Counter(map(key, now.collect())), Counter(map(key, spark.read.parquet(f"{tmp_path}/{n}").collect()))
        assert not after - before
        if name == "toxicity":
            model = toxicity.train(now, labels)
            flagged = toxicity.toxicity(now, model).where("predicted = 1").count()
            assert sum(before.values()) - sum(after.values()) == flagged
        if name == "quality classifier":
            assert after and all(t for _, t in after)
        if name == "near-dedup":
            sets = [frozenset(shingles(t, 5)) for _, t in after.elements()]
            assert len(set(sets)) == len(sets)
            assert {frozenset(shingles(t, 5)) for _, t in before} >= set(sets)
        now = spark.read.parquet(f"{tmp_path}/{n}")
    library = tokens_of(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(x) // 4 + 1) for r, x in zip(now.collect(), library.ids([r["text"] for r in now.collect()])))
    for pieces in (STAGES[-1][1](spark, now, str(tmp_path)), run(spark, str(tmp_path))):
        rows = pieces.collect()
        assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
        assert sum(r["length"] for r in rows) == sum(n * times for (_, n), times in want.items())


def test_very_long_texts(spark, labels):
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) for _ in range(20_000))
    rows = [(0, long, "en"), (1, long + " end", "en"), (2, "y" * 200_000, "en"), (3, "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["component_id"] for r in neardup.near_duplicates(df).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert [r["n_words"] for r in quality.quality_rules(df, labels).orderBy("doc_id").collect()] == [20_000, 20_001, 1, 1]
    assert sharding.vector_shards(df).count() == 4
    ids = tokens_of(public_tokenizers.path("byte_bpe_50k.json")).ids([t for _, t, _ in rows])
    packed = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in packed) == sum(len(x) // 4 + 1 for x in ids)


def test_hot_keys_are_spread(spark):
    from barnacle.llm.common import heavy_keys, least_hashed, spread_join

    many = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k")
    one = many.select("k").distinct().selectExpr("k", "k * 2 AS v")
    heavy = heavy_keys(many, ["k"], 6000)
    assert [tuple(r) for r in heavy.collect()] == [(-1, 4)]
    out = spread_join(many, one, ["k"], heavy, "id")
    assert Counter(tuple(r) for r in out.select("id", "k", "v").collect()) == Counter((r["id"], r["k"], 2 * r["k"]) for r in many.collect())
    want = [r["id"] for r in many.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r["id"] for r in least_hashed(many, "id", 50).collect()] == want and least_hashed(many, "id", 9000).count() == 6000
