"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Trusted documents are those with labels.quality = 1, all of them. One in APART of these, by a hash of the id, sets the thresholds
and the rest train the model, for text that a model has seen has a lower perplexity than text like it. The training documents' n-grams are counted in each task and summed in Spark, and
the tables of all orders, with contexts and discounts, follow from the highest order's counts by aggregation. Documents
travel in chunks of CHUNK bytes of text at most. A chunk asks for its distinct n-grams; these are joined to the sharded tables
order by order, and the probabilities return to the chunk, where each document's perplexity is summed. So neither the
model nor a chunk's n-grams are ever held whole by the driver or broadcast, and what moves is bounded by the input.

Before the join with the labels, documents pass a bitmap of BITS bits of the trusted ids, so that few other texts are shuffled.
A document is kept if its perplexity lies between the LOW and HIGH quantiles of the threshold documents of its language, which are
drawn towards those of all threshold documents with the weight of PRIOR documents, so that a few odd ones of a small language don't set a
bound; those of all count alone where its language has none. The lower bound is divided by BELOW, for the documents that the model has seen lie lower, and the
upper one multiplied by ABOVE. Text is taken as UTF-8 whole, without changes.

Null and empty texts have no perplexity and aren't kept. A null language is one like others. Without trusted documents all that
have text are kept. Rows with equal or null doc_ids stay separate rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, stored, table

ORDER, CHUNK, SLICE, BITS, APART = 4, 24_000_000, 500_000, 1 << 23, 5
LOW, HIGH, BELOW, ABOVE, PRIOR = 0.01, 0.98, 1.25, 1.05, 100


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code that ends at each byte of the texts, each padded in front with zeros, and the bytes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    pad = b"\0" * (order - 1)
    x = np.frombuffer(b"".join(p for r in raw for p in (pad, r)), np.uint8)
    kind = np.uint32 if order <= 4 else np.uint64
    codes = np.zeros(max(0, len(x) - order + 1), kind)
    for i in range(order):
        codes |= x[i : i + len(codes)].astype(kind) << kind(8 * (order - 1 - i))
    inside = np.ones(len(x), bool)
    starts = np.cumsum(sizes + order - 1) - sizes
    for i in range(1, order):
        inside[starts - i] = False
    return codes[inside[order - 1 :]], sizes


def slices(texts: pa.Array, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows from lo to hi with SLICE bytes of text at most, or of one text."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts.slice(lo, hi - lo)), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < hi - lo:
        end = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, "right")) - 1)
        yield lo + at, lo + end
        at = end


def _counted(order: int) -> Callable:
    """Counts of the n-grams of a task's texts, summed before they leave it as far as memory allows."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(c) for c in zip(*held))
        code, at = np.unique(code, return_inverse=True)
        return code, np.bincount(at, n).astype(np.int64)

    def batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for lo, hi in slices(b["text"], 0, len(b)):
                held.append(np.unique(grams(b["text"].slice(lo, hi - lo).to_pylist(), order)[0], return_counts=True))
                if sum(len(c) for c, _ in held) > 2_000_000:
                    held = [merged(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield batch(*held[0])
                        held = []
        if held:
            yield batch(*merged(held))

    return partition


def _bitmap(ids: DataFrame) -> bytes:
    """BITS bits, set at the hashes of ids (doc_id)."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(out)


def _passing(bits: bytes) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.frombuffer(bits, np.uint8)
        for b in batches:
            at = b["at"].to_numpy()
            yield b.filter(pa.array((table_[at // 8] >> (at % 8) & 1).astype(bool)))

    return partition


def trusted_counts(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """code and n of the n-grams of the docs whose doc_id trusted has."""
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)).alias("at"), "text")
    passing = hashed.mapInArrow(lean(_passing(_bitmap(trusted))), hashed.schema).drop("at")
    # a merge join at every size: a broadcast of the ids would grow with the labels
    return passing.join(trusted.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(lean(_counted(order)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Those of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4.

    At least 0.05: without a discount a context leaves unseen bytes no probability, and one of 0 spoils the sums of a chunk's texts.
    """
    n = [x or 0 for x in counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5)) for k in (1, 2, 3)]


def probabilities(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """p, the interpolated probability of the last byte after the others, of the n-grams in wanted (code, distinct)."""
    tables = [counts]
    for k in range(order - 1, 0, -1):  # how many different bytes stand before each shorter n-gram
        tables.append(cut(tables[-1].groupBy(F.col("code").bitwiseAND((1 << (8 * k)) - 1).alias("code")).agg(F.count("*").alias("n"))))
    below = None
    for k, counted in enumerate(reversed(tables), 1):
        d = _discounts(counted)
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = counted.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("mass"))
        asked = wanted.select(F.col("code").bitwiseAND((1 << (8 * k)) - 1).alias("code")).distinct() if k < order else wanted
        found = asked.join(counted, "code", "left").withColumn("context", F.shiftright("code", 8)).join(context, "context", "left")
        own = F.when(F.col("n").isNotNull(), (F.col("n") - discount) / F.col("total")).otherwise(0.0)
        rest = F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0))
        if below is None:
            found = found.withColumn("q", F.lit(1 / 256))
        else:
            found = found.join(below.select(F.col("code").alias("short"), F.col("p").alias("q")), F.col("code").bitwiseAND((1 << (8 * (k - 1))) - 1) == F.col("short"))
        below = cut(found.select("code", (own + rest * F.col("q")).alias("p")))
    return below


def _pack(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


MESSAGE = "chunk long, kind int, code long, p double, payload binary"


def _chunks(at: int, payload: bool, order: int) -> Callable:
    """The rows of each chunk, packed, or the distinct n-grams of their texts (column at).

    The last column is a hash of the file split that a row was read from, with which a chunk's number begins, so that both uses
    number chunks alike; chunks that get the same number just share their n-grams.
    """

    def wanted(chunk: int, known: list[np.ndarray]) -> pa.RecordBatch:
        code = np.unique(np.concatenate(known))
        return pa.record_batch([pa.array(np.full(len(code), chunk)), pa.array(code.astype(np.int64))], ["chunk", "code"])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk, size, known = None, 0, 0, []
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(b)] if len(b) else []
            for start, end in zip(edges, edges[1:]):
                for lo, hi in slices(b.column(at), start, end):
                    part = b.slice(lo, hi - lo)
                    if keys[lo] != split or size >= CHUNK:
                        if known:
                            yield wanted(chunk, known)
                        chunk = int(keys[lo]) // 2 if keys[lo] != split else chunk + 1
                        split, size, known = keys[lo], 0, []
                    texts = part.column(at)
                    if payload:
                        rows = _pack(pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1]))
                        yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([rows], pa.binary())], ["chunk", "kind", "code", "p", "payload"])
                    else:
                        known.append(np.unique(grams(texts.to_pylist(), order)[0]))
                    size += pc.sum(pc.binary_length(texts)).as_py() or 0
        if known:
            yield wanted(chunk, known)

    return partition


def _scored(at: int, keep: list[int], names: list[str], order: int) -> Callable:
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, code, logp, ready = None, [], [], None
        for b in batches:
            chunks, kinds = b["chunk"].to_numpy(), b["kind"].to_numpy()
            edges = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(b)] if len(b) else []
            for lo, hi in zip(edges, edges[1:]):
                if chunks[lo] != now:
                    now, code, logp, ready = chunks[lo], [], [], None
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:  # sorted before the chunk's documents, by code
                    code.append(part["code"].to_numpy())
                    logp.append(np.log(part["p"].to_numpy()))
                    continue
                if ready is None:
                    ready = (np.concatenate(code).astype(np.uint32 if order <= 4 else np.uint64), np.concatenate(logp)) if code else (np.zeros(0, np.uint32), np.zeros(0))
                    code, logp = [], []
                for packed in part["payload"]:
                    rows = pa.ipc.open_stream(packed.as_py()).read_all().combine_chunks().to_batches()
                    for r in rows:
                        yield score(r, *ready)

    def score(r: pa.RecordBatch, code: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
        codes, sizes = grams(r.column(at).to_pylist(), order)
        place = np.searchsorted(code, codes)
        if len(codes) and (len(code) == 0 or (code[np.minimum(place, len(code) - 1)] != codes).any()):
            raise RuntimeError("a chunk's n-grams differ from those it asked for: its input isn't repeatable")
        total = np.concatenate(([0.0], np.cumsum(logp[place])))
        end = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            value = np.exp((total[end - sizes] - total[end]) / np.maximum(sizes, 1))
        return pa.RecordBatch.from_arrays([*(r.column(i) for i in keep), pa.array(sizes), pa.array(value, mask=sizes == 0)], names)

    return partition


def sets_thresholds(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(APART)) == 0


def perplexities(docs: DataFrame, labels: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """The columns in keep of docs (doc_id, text and others), with n_bytes and perplexity; order: bytes in an n-gram, 7 at most.

    docs must give the same rows from the same file splits each time; what isn't read from files is stored first.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be from 1 to 7")
    if not docs.inputFiles():
        docs = stored(docs)
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    counts = cut(trusted_counts(docs, trusted.where(~sets_thresholds()), order))
    at = docs.columns.index("text")
    placed = docs.withColumn("split_of_row", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    asked = stored(placed.mapInArrow(lean(_chunks(at, False, order)), "chunk long, code long"))
    p = probabilities(counts, asked.select("code").distinct(), order)
    reply = asked.join(p, "code").select("chunk", F.lit(0).alias("kind"), "code", "p", F.lit(None).cast("binary").alias("payload"))
    both = reply.unionByName(placed.mapInArrow(lean(_chunks(at, True, order)), MESSAGE)).repartition("chunk").sortWithinPartitions("chunk", "kind", "code")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "n_bytes", "perplexity"]
    return both.mapInArrow(lean(_scored(at, [docs.columns.index(c) for c in keep], names, order)), f"{fields}, n_bytes long, perplexity double")


def judged(scored: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """scored (doc_id, lang, n_bytes, perplexity and others) with least, most and kept."""
    trusted = labels.where("quality = 1").where(sets_thresholds()).select("doc_id").distinct()
    known = scored.where("perplexity is not null").join(trusted, "doc_id", "left_semi")
    q = lambda x: F.percentile_approx("perplexity", x, 10000)
    by = known.groupBy(F.col("lang").alias("of")).agg(q(low).alias("least"), q(high).alias("most"), (F.count("*") / (F.count("*") + PRIOR)).alias("own"))
    every = known.agg(q(low).alias("least_all"), q(high).alias("most_all"))
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(every)).drop("of")  # every: one row
    drawn = lambda c: F.coalesce(F.pow(c, "own") * F.pow(f"{c}_all", 1 - F.col("own")), f"{c}_all")
    out = out.withColumn("least", drawn("least") / BELOW).withColumn("most", drawn("most") * ABOVE).drop("own", "least_all", "most_all")
    inside = F.coalesce((F.col("perplexity") >= F.col("least")) & (F.col("perplexity") <= F.col("most")), F.lit(True))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & inside)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumnsRenamed({n: c for n, c in zip(names, docs.columns) if c in ("doc_id", "text", "lang")})
    scored = stored(perplexities(inner, labels, inner.columns))
    return judged(scored, labels).where("kept").select(*inner.columns).toDF(*docs.columns)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    return judged(cut(perplexities(docs, labels, ["doc_id", "lang"])), labels)


QUERIES = {"op8_kneser_ney": op8_kneser_ney}
ORACLES: dict[str, str] = {}
