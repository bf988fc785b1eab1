import gzip
import io

import pytest

from barnacle.operators.counters import count_single
from barnacle.operators.matrix import matrix_of_single
from barnacle.operators.counters import count_combo, count_random
from barnacle.sources.fastq import Inflated, compressed, opened, parse, plain, read_fastq, read_fastq_pairs, write_fastq
from barnacle.streaming.counts import stream_counts, total


def records(text):
    return list(parse(io.BytesIO(text.encode())))


def test_records():
    assert records("") == []
    assert records("@a x\nAC\nGT\n+a\n@@\n@@\n@b\nA\n+\nI") == [("a", "ACGT"), ("b", "A")]
    assert records("@a\n\n+\n\n@b\nA\n+\nI\n") == [("a", ""), ("b", "A")]
    assert records("@a\nAC\r\n+\nII\r\n") == [("a", "AC\r")]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("a\nA\n+\nI\n", r"read name should start with '@' \(starting line 1\)"),
        ("@a\nA\n+\nI\n\n", r"read name should start with '@' \(starting line 5\)"),
        ("@a\nAC\n+\nIII\n", r"non-equal lengths for quality and sequence strings \(starting line 1\)"),
        ("@a\nAC\n+\nI", r"non-equal lengths for quality and sequence strings"),
        ("@a\nAC\n", "premature end of the file"),
        ("@a", "premature end of the file at line 1"),
    ],
)
def test_errors(text, message):
    with pytest.raises(ValueError, match=message):
        records(text)


def test_buffers_and_streams(tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 40 + 1)}\n+\n{'IIII' * (i % 40 + 1)}\n" for i in range(3000)).encode()
    want = list(parse(io.BytesIO(text)))
    for data, mode in ((text, None), (compressed(text), None), (compressed(text, "zlib"), None), (compressed(text, "deflate"), "deflate"), (compressed(text, "zlib"), "auto"), (compressed(text), "gzip")):
        assert list(parse(plain(data, mode))) == want
        assert list(parse(plain(io.BytesIO(data), mode))) == want
    # members one after another, as block-wise compressors write them
    assert list(parse(plain(compressed(text[:-4000]) + compressed(text[-4000:])))) == want
    assert io.BufferedReader(Inflated(io.BytesIO(compressed(text)), block=7)).read() == text
    with pytest.raises(ValueError, match="premature end of the compressed stream"):
        plain(compressed(text)[:-20]).read()
    (tmp_path / "reads.bin").write_bytes(compressed(text, "zlib"))
    assert list(parse(opened(f"file://{tmp_path}/reads.bin"))) == list(parse(opened(str(tmp_path / "reads.bin")))) == want
    with pytest.raises(ValueError, match="failed to open file"):
        opened(f"file://{tmp_path}/none")


def test_tables_are_in_order(spark):
    reads = spark.createDataFrame([(s,) for s in ("ACGTGGAATTTGCA", "ACGTCCAAGGTGCA", "ACGTGGAAGGTGCA")] * 2, "seq string")
    table = count_combo(reads, "ACGTNNAANNTGCA", [["GG", "CC"], ["TT", "GG"]]).table.collect()
    assert [(r["i0"], r["i1"]) for r in table] == [(0, 0), (0, 1), (1, 1)]
    assert [r["sequences"] for r in count_random(reads, "ACGTNNAANNTGCA").table.collect()] == ["CC", "GG"]


def test_source(spark, tmp_path):
    text = b"@r1\nACGTGGTGCA\n+\n@@@@@@@@@@\n@r2\nTTTT\n+\nIIII\n"
    (tmp_path / "plain.gz").write_bytes(text)
    (tmp_path / "packed.txt").write_bytes(gzip.compress(text))
    for name in ("plain.gz", "packed.txt"):
        rows = read_fastq(spark, str(tmp_path / name)).orderBy("read_id").collect()
        assert [(r["name"], r["seq"]) for r in rows] == [("r1", "ACGTGGTGCA"), ("r2", "TTTT")]
    assert read_fastq(spark, f"{tmp_path}/p*").count() == 4
    m = matrix_of_single(spark, [str(tmp_path / "plain.gz"), str(tmp_path / "packed.txt")], ["GG", "AA"], template="ACGTNNTGCA")
    assert {tuple(r) for r in m.col_data.select("sample", "nreads", "nmapped").collect()} == {("plain.gz", 2, 1), ("packed.txt", 2, 1)}
    pair = read_fastq_pairs(spark, str(tmp_path / "plain.gz"), str(tmp_path / "packed.txt")).where("read_id = 0").first()
    assert pair["seq1"] == pair["seq2"] == "ACGTGGTGCA"
    (tmp_path / "short").write_bytes(b"@r1\nA\n+\nI\n")
    with pytest.raises(Exception, match="different number of reads"):
        read_fastq_pairs(spark, str(tmp_path / "plain.gz"), str(tmp_path / "short")).collect()
    with pytest.raises(Exception, match="failed to open file"):
        read_fastq(spark, str(tmp_path / "none")).collect()
    out = str(tmp_path / "out")
    write_fastq(read_fastq(spark, str(tmp_path / "plain.gz")), out, "gzip")
    assert {r["seq"] for r in read_fastq(spark, f"{out}/part-*").collect()} == {"ACGTGGTGCA", "TTTT"}


def test_stream(spark, tmp_path):
    reads = spark.createDataFrame([("ACGTGGTGCA",), ("ACGTGGTGCA",), ("T",)], "seq string")
    reads.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_counts(stream, lambda df: count_single(df, ["GG", "AA"], template="ACGTNNTGCA"), f"{tmp_path}/sums", f"{tmp_path}/ck").awaitTermination()
    assert {(r["idx"], r["counts"]) for r in total(spark, f"{tmp_path}/sums", ["idx"]).collect()} == {(0, 2), (1, 0)}
