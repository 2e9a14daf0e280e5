"""Document fingerprints of improbable features: windows of bytes whose entropy is rare in the corpus, in chained Bloom
filters, compared by their normalised overlap of bits.

The entropy of every window of 64 bytes is one of 1001 grades. How often each grade occurs in the whole corpus ranks the
windows: a window that is the rarest of its neighbourhood often enough is a feature. Features are hashed into filters of
2048 bits, a new one after each 160.
"""

from __future__ import annotations

import hashlib
from binascii import a2b_base64, b2a_base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches
from .textbatch import lanes, lean, mix, ranges, slices, sliding, text_bytes

# Sizes of the digest.
WIDTH, SPAN, VOTES = 64, 64, 16
GRADES, WEAK = 1000, 100
BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
# End of fixed values.

BLOCK = 1 << 15
SLICE = 1 << 20
#: Text of one range of documents in order, unless there are MOST_RANGES of them.
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000

_SCALE = 100_000
_COUNTS = np.arange(WIDTH + 1, dtype=np.float64)
#: c * log2(c), and what one more of a byte adds to the sum of it over a window.
_TERMS = np.rint(_SCALE * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_GAIN = np.diff(_TERMS)


def grades(raw: np.ndarray) -> np.ndarray:
    """The entropy of each window of WIDTH bytes, by its start: 0 for one byte repeated, GRADES for all different.

    A byte that enters or leaves a window changes the sum of c * log2(c) by its number of equals in it. Those numbers are
    counted by comparing the bytes with themselves, shifted, block by block.
    """
    n = len(raw)
    if n < WIDTH:
        return np.empty(0, np.int64)
    entering, leaving = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        for k in range(1, WIDTH):
            low = max(a, k)
            if low < b:
                equal = (raw[low:b] == raw[low - k : b - k]).view(np.uint8)
                entering[low:b] += equal
                leaving[low - k : b - k] += equal
    change = _GAIN[entering[WIDTH - 1 :]]
    change[0] = _GAIN[entering[:WIDTH]].sum()
    change[1:] -= _GAIN[leaving[: n - WIDTH]]
    whole = _TERMS[WIDTH]
    return (whole - np.cumsum(change)) * GRADES // whole


def windows_of(at: np.ndarray) -> np.ndarray:
    """How many windows each text has; at: where texts begin, and the last ends."""
    return np.maximum(np.diff(at) - WIDTH + 1, 0)


def histogram(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of the texts by grade."""
    found = grades(raw)
    return np.bincount(found[ranges(at[:-1], windows_of(at))], minlength=GRADES + 1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Of each grade, its place from the rarest on; grades under WEAK, which little but repetition has, come last."""
    grade = np.arange(len(counts))
    order = np.lexsort((grade, counts, grade < WEAK))
    out = np.empty(len(counts), np.int64)
    out[order] = grade
    return out


def features(raw: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the 64-bit hash of each feature, in order.

    A window gets a vote of each SPAN windows among which it is the first of the least rank, and is a feature with VOTES
    votes, or all of a short text. A text without one, or of under WIDTH bytes, is a feature itself; an empty one has none.
    """
    size, windows = np.diff(at), windows_of(at)
    place = ranges(at[:-1], windows)
    owner = np.repeat(np.arange(len(size)), windows)
    # The windows of all texts, one after another; a vote is taken at each that has SPAN windows of its own text from it on.
    first = np.concatenate(([0], np.cumsum(windows)))
    n = len(place)
    key = (rank[grades(raw)[place]] << 40) | np.arange(n)
    votes = np.zeros(n, np.int64)
    spans = np.maximum(windows - SPAN + 1, np.minimum(windows, 1))
    if n >= SPAN:
        least = sliding(key, SPAN) & ((1 << 40) - 1)
        long = np.flatnonzero(windows >= SPAN)
        votes += np.bincount(least[ranges(first[long], spans[long])], minlength=n)
    short = np.flatnonzero((windows > 0) & (windows < SPAN))
    if len(short):
        runs = ranges(first[short], windows[short])
        heads = np.concatenate(([0], np.cumsum(windows[short])[:-1]))
        votes[np.minimum.reduceat(key[runs], heads) & ((1 << 40) - 1)] += 1
    chosen = votes >= np.minimum(VOTES, spans)[owner]
    own, starts = owner[chosen], place[chosen]
    eight = lanes(raw)
    h = np.full(len(starts), WIDTH, np.uint64)
    for k in range(0, WIDTH, 8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + eight[starts + k])
    lacking = np.flatnonzero((size > 0) & (np.bincount(own, minlength=len(size)) == 0))
    if len(lacking):
        whole = [int.from_bytes(hashlib.blake2b(raw[at[j] : at[j + 1]].tobytes(), digest_size=8).digest(), "little") for j in lacking.tolist()]
        own, h = np.concatenate((own, lacking)), np.concatenate((h, np.array(whole, np.uint64)))
    by = np.lexsort((np.arange(len(own)), own))
    return own[by], h[by]


class Digest:
    """A chain of filters: n features, and the filters' bits, a row each."""

    __slots__ = ("n", "bits")

    def __init__(self, n: int, bits: np.ndarray):
        self.n, self.bits = n, bits

    def __str__(self) -> str:
        return f"{self.n}:{b2a_base64(np.packbits(self.bits, axis=1).tobytes(), newline=False).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        n, _, data = text.partition(":")
        packed = np.frombuffer(a2b_base64(data), np.uint8).reshape(-1, BITS // 8)
        return cls(int(n), np.unpackbits(packed, axis=1).view(bool))

    def weights(self) -> np.ndarray:
        """Features of each filter."""
        return np.minimum(FILTER_FEATURES, self.n - FILTER_FEATURES * np.arange(len(self.bits)))


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The digest of each text; a feature that a text repeats counts where it comes first."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    own, h = features(np.frombuffer(b"".join(texts), np.uint8), at, rank)
    by = np.lexsort((np.arange(len(h)), h, own))
    again = np.zeros(len(h), bool)
    again[by[1:]] = (own[by[1:]] == own[by[:-1]]) & (h[by[1:]] == h[by[:-1]])
    own, h = own[~again], h[~again]
    n = np.bincount(own, minlength=len(texts))
    filters = -(-n // FILTER_FEATURES)
    start = np.concatenate(([0], np.cumsum(filters)))
    within = np.arange(len(own)) - np.concatenate(([0], np.cumsum(n)[:-1]))[own] if len(own) else own
    row = start[own] + within // FILTER_FEATURES
    bits = np.zeros((int(start[-1]), BITS), bool)
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [Digest(int(n[j]), bits[start[j] : start[j + 1]]) for j in range(len(texts))]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: what share of the lesser digest's features the other seems to hold.

    Each filter of the lesser meets the filter of the other that it overlaps most, beyond what filters so full share by
    chance, and counts by its features. Two digests without features are alike, one is like none.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if b.n < a.n:
        a, b = b, a
    ones, others = a.bits.sum(1, dtype=np.int64), b.bits.sum(1, dtype=np.int64)
    theirs = b.bits.astype(np.float32)
    best = np.empty(len(ones))
    for x in range(0, len(ones), 256):
        part = slice(x, x + 256)
        both = a.bits[part].astype(np.float32) @ theirs.T
        chance = np.outer(ones[part], others) / BITS
        best[part] = ((both - chance) / (np.minimum.outer(ones[part], others) - chance)).max(1)
    return float(np.average(np.clip(best, 0.0, 1.0), weights=a.weights()))


def compare(a: str, b: str) -> float:
    """likeness() of two fingerprints."""
    return likeness(Digest.parse(a), Digest.parse(b))


def corpus_grades(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int, int]:
    """Windows of all texts by grade, the number of texts and their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(GRADES + 3, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                raw, at = text_bytes(part.column("_text"))
                sums[: GRADES + 1] += histogram(raw, at)
                sums[GRADES + 1 :] += part.num_rows, len(raw)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["grade", "n"])

    found = np.zeros(GRADES + 3, np.int64)
    for r in docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(lean(run), "grade int, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        found[r.grade] = r.n
    return found[: GRADES + 1], int(found[GRADES + 1]), int(found[GRADES + 2])


_FOUND = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
DONE, LAST, HEAD = 0, 1, 2


def _text_of(blob: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(blob, size, asbytes=True) if size else b""


def _results(pairs: list[tuple[bytes, bytes]], rank: np.ndarray, own: Digest | None = None) -> tuple[list[tuple], Digest]:
    """The results of each text, given the one that follows it, and the digest of the last that follows.

    In a run of documents each next text is the text of the following pair, and is digested once. own: the first's digest.
    """
    texts, edited, chars = [], [], []
    for text, following in pairs:
        whole = text.decode()
        half = len(whole) // 2
        chars.append(len(whole))
        edited.append((whole[: len(whole) - half] + following[: 4 * half].decode(errors="ignore")[:half]).encode())
        texts.append(text)
    texts.append(pairs[-1][1])
    known = [] if own is None else [own]
    made = digests([*texts[len(known) :], *edited], rank)
    mine, theirs = [*known, *made[: len(texts) - len(known)]], made[len(texts) - len(known) :]
    rows = []
    for j, n in enumerate(chars):
        rows.append((n, hashlib.sha256(edited[j]).hexdigest(), str(mine[j]), str(theirs[j]), likeness(mine[j], theirs[j]), likeness(mine[j], mine[j + 1])))
    return rows, mine[-1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if not given), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of each document.

    The edited text has its last half of code points replaced by the first of the next document, in order of the id, null
    first, then of the text's hash; the first follows the last, and an only document itself. Rows that repeat follow each
    other. A null text is empty and has no features; two such are alike, any other is like none. An empty table gives no
    rows. Texts are worked on whole: one of L bytes takes some 60 L in its task. Carried columns that are named like
    results give way to them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts, rows, size = corpus_grades(docs, text_col)
    shared = spark.sparkContext.broadcast(ranks(counts))
    columns = docs.columns if carry is None else carry
    carried = [F.col(c).alias(f"c_{c}") for c in columns]
    asked = docs.select(*carried, F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [f for f in asked.schema.fields if f.name != "_text"]
    packed_schema = T.StructType([*fields, T.StructField("_size", T.LongType()), T.StructField("_blob", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raw, at = text_bytes(batch.column("_text"))
            whole, ends = memoryview(np.ascontiguousarray(raw)), at.tolist()
            blobs = [codec.compress(whole[a:b], asbytes=True) if a < b else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(np.diff(at)), pa.array(blobs, pa.binary())], packed_schema.names)

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_RANGES, max(least, -(-size // RANGE_BYTES)))
    order = [F.col("_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    ranged = asked.mapInArrow(lean(pack), packed_schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.drop("_id", "_tie", "_row").withColumn("_part", F.spark_partition_id())
    own_fields = [f for f in ranged.schema.fields if f.name not in ("_size", "_blob", "_part")]
    out_fields = [*own_fields, *[T.StructField(n, k) for n, k in _FOUND]]
    schema = T.StructType([*out_fields, T.StructField("_part", T.IntegerType()), T.StructField("_state", T.IntegerType()), T.StructField("_size", T.LongType()), T.StructField("_blob", T.BinaryType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = own = None  # the row before, whose next is still to come: its columns, text, and digest
        for batch in batches:
            sizes, blobs, part = batch.column("_size").to_pylist(), batch.column("_blob"), batch.column("_part")
            if held is None and batch.num_rows:
                yield _open(batch.slice(0, 1), own_fields, schema, HEAD)
            start = 0
            while start < batch.num_rows:
                end, total = start, 0
                while end < batch.num_rows and (end == start or total + sizes[end] <= SLICE):
                    total += sizes[end]
                    end += 1
                texts = [_text_of(blobs[j].as_py(), sizes[j]) for j in range(start, end)]
                before = ([] if held is None else [held[1]]) + texts
                if len(before) > 1:
                    found, own = _results(list(zip(before[:-1], before[1:], strict=True)), shared.value, own)
                    group = pa.Table.from_batches(([] if held is None else [held[0]]) + [batch.slice(start, end - start)]).combine_chunks().slice(0, len(found))
                    yield _done(group, found, own_fields, schema)
                held = batch.slice(end - 1, 1), texts[-1]
                start = end
        if held is not None:
            yield _open(held[0], own_fields, schema, LAST)

    made = keep(ranged.mapInArrow(lean(stream), schema), "fingerprints")
    names = [*[f.name for f in own_fields], *[n for n, _ in _FOUND]]
    heads = made.where(F.col("_state") == HEAD).select(F.col("_part").alias("_next"), F.col("_size").alias("_next_size"), F.col("_blob").alias("_next_blob"))
    # One row for each range that has documents: MOST_RANGES, or as many as the session has shuffle partitions.
    held_parts = sorted(r[0] for r in heads.select("_next").collect())
    follows = spark.createDataFrame(list(zip(held_parts, held_parts[1:] + held_parts[:1], strict=True)), "_part int, _next int")
    open_rows = made.where(F.col("_state") == LAST).select(*[f.name for f in own_fields], "_part", "_size", "_blob")
    joined = open_rows.join(follows, "_part").join(heads, "_next").select(*[f.name for f in own_fields], "_size", "_blob", "_next_size", "_next_blob")
    closed_schema = T.StructType(out_fields)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, blob, next_size, next_blob = (batch.column(c)[k].as_py() for c in ("_size", "_blob", "_next_size", "_next_blob"))
                found, _ = _results([(_text_of(blob, size), _text_of(next_blob, next_size))], shared.value)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(k, 1) for f in own_fields], *_columns(found)], closed_schema.names)

    whole = made.where(F.col("_state") == DONE).select(*names).unionByName(joined.mapInArrow(lean(close), closed_schema))
    results = [n for n, _ in _FOUND]
    return whole.select(*[F.col(f"c_{c}").alias(c) for c in columns if c not in results], *results)


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return [pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds)]


def _done(rows: pa.Table, found: list[tuple], own_fields: list, schema: T.StructType) -> pa.RecordBatch:
    n = len(found)
    own = [rows.column(f.name).combine_chunks() if rows.column(f.name).num_chunks != 1 else rows.column(f.name).chunk(0) for f in own_fields]
    part = rows.column("_part").combine_chunks()
    part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
    return pa.RecordBatch.from_arrays([*own, *_columns(found), part, pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema.names)


def _open(row: pa.RecordBatch, own_fields: list, schema: T.StructType, state: int) -> pa.RecordBatch:
    """A row whose result is still to come, with its text."""
    empty = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([*[row.column(f.name) for f in own_fields], *empty, row.column("_part"), pa.array([state], pa.int32()), row.column("_size"), row.column("_blob")], schema.names)
