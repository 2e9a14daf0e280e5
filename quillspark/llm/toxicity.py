"""Toxicity by bags of subword embeddings under a linear softmax, trained in numpy.

A word is the bag of its character n-grams (as bytes, with marks at both ends) and itself, each hashed to a row of an
embedding table. A text is the mean of its subwords' vectors, and a linear softmax turns that into a probability.
Embeddings and softmax are fitted together, by gradient steps on labelled texts. A misspelling shares most of its
n-grams, and so its vectors, with the word it spells.

Once fitted, embedding and softmax fold into one number for each row of the table, so scoring looks numbers up and adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches
from .textbatch import ALNUM, Prefix, Words, lean, ranges, slices

ROWS = 1 << 19
DIM = 4
GRAMS = (3, 4, 5, 6, 7, 8)
#: Labelled texts of each label that training reads at most, those of the least hash of their id.
SAMPLE = 2000
#: Bytes of text of each label that training reads at most; whole texts only, in the same order.
SAMPLE_BYTES = 32 << 20
ROUNDS = 16
RATE = 12.0
BATCH = 128
#: Texts in which a row's subwords occur at least; rarer ones stay zero.
SEEN = 6
SEED = 7
_BASE = 0x8CB92BA72F3D8DD7


def subwords(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the distinct word of each; where each distinct word's rows begin; and the rows."""
    w = Words(column, ALNUM, lower=True)
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    marked = size + 2
    at = np.concatenate(([0], np.cumsum(marked)))
    text = np.full(int(at[-1]), 60, np.uint8)
    text[at[1:] - 1] = 62
    text[ranges(at[:-1] + 1, size)] = w.raw[ranges(start, size)]
    run = Prefix(text.astype(np.uint64) + np.uint64(1), _BASE)
    begins, lengths, owners = [at[:-1]], [marked], [np.arange(len(first))]
    for n in GRAMS:
        count = np.maximum(marked - n + (marked > n), 0) * (marked > n)
        begins.append(ranges(at[:-1], count))
        lengths.append(np.full(int(count.sum()), n))
        owners.append(np.repeat(np.arange(len(first)), count))
    begin, length, owner = (np.concatenate(x) for x in (begins, lengths, owners))
    order = np.argsort(owner, kind="stable")
    rows = (run.runs(begin[order], begin[order] + length[order]) % np.uint64(ROWS)).astype(np.int64)
    return w, which, np.searchsorted(owner[order], np.arange(len(first) + 1)), rows


class Model:
    """What scoring needs: a number for each row of the table, and the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def logits(self, column: pa.Array) -> np.ndarray:
        """Of each text; the bias for a text without words."""
        w, which, first, rows = subwords(column)
        value = np.concatenate(([0.0], np.cumsum(self.table[rows].astype(np.float64))))
        total, count = value[first[1:]] - value[first[:-1]], np.diff(first)
        owner = w.owner()
        bag = np.bincount(owner, count[which], len(column))
        return np.bincount(owner, total[which], len(column)) / np.maximum(1, bag) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -30, 30)))


def _bags(texts: list[str], block: int = 64):
    """Per block of texts: the text, row and share of each distinct row in each text's bag."""
    for a in range(0, len(texts), block):
        w, which, first, rows = subwords(pa.array(texts[a : a + block], pa.large_string()))
        sizes = np.diff(first)
        keys = np.repeat(w.owner(), sizes[which]) * ROWS + rows[ranges(first[which], sizes[which])]
        keys, n = np.unique(keys, return_counts=True)
        owner = keys // ROWS
        yield (owner + a).astype(np.int32), (keys % ROWS).astype(np.int32), (n / np.bincount(owner, n, block)[owner]).astype(np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Fits embeddings (ROWS x DIM) and a softmax over two classes; the same input gives the same model.

    Both classes weigh the same in all. Steps follow the gradient, with momentum, at a length set for the table as a
    whole, so rows move as far as they bear on the labels, and rows of chance words stay near zero.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(ROWS, np.float32), float(np.log(share / (1 - share))))
    seen = np.zeros(ROWS, np.int32)
    for _, r, _ in _bags(texts):
        np.add.at(seen, r, 1)
    kept = [tuple(x[seen[r] >= SEEN] for x in (o, r, s)) for o, r, s in _bags(texts)]
    owner, row, share = (np.concatenate([x[k] for x in kept]) for k in range(3))
    del kept
    at = np.searchsorted(owner, np.arange(len(y) + 1))
    embedding = rng.normal(0, 0.01, (ROWS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    speed = [np.zeros_like(x) for x in (embedding, softmax, bias)]
    full = np.flatnonzero(np.diff(at))
    for turn in range(rounds):
        rate = RATE * (1 - turn / rounds)
        for part in np.array_split(rng.permutation(full), max(1, len(full) // BATCH)):
            n = np.diff(at)[part]
            mine = ranges(at[part], n)
            r, x = row[mine], share[mine][:, None]
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            mean = np.add.reduceat(embedding[r] * x, begin, axis=0)
            z = mean @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            spread = np.repeat(p @ softmax.T, n, axis=0) * x
            slopes = np.stack([np.bincount(r, spread[:, k], ROWS) for k in range(DIM)], 1).astype(np.float32), mean.T @ p, p.sum(0)
            for v, parameter, slope, most in zip(speed, (embedding, softmax, bias), slopes, (1.0, 0.02, 0.05), strict=True):
                v *= 0.9
                v += slope
                parameter -= rate * most * v / (np.linalg.norm(v) + 1e-6) * min(1.0, float(np.abs(p).sum()) * 4)
    return Model((embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, text and label of the rows to learn from: those whose crc32 of the id, as text, is not 1 modulo 3.

    Of more than `sample` rows of a label the ones of the least hash count, and of these as many as have sample_bytes of
    text together, so the sample is bounded and the same in every run. Labels without an id or a value are left out; of
    labels that repeat an id the highest counts, and of texts that share an id the one of the least hash.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    known = known.groupBy(id_col).agg(F.max("toxic").cast("int").alias("label"))
    few = known.where("label = 1").orderBy(F.xxhash64(id_col), id_col).limit(sample).union(known.where("label = 0").orderBy(F.xxhash64(id_col), id_col).limit(sample))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most 2 * sample small rows, whatever the input; rows that repeat an id are made one before they are shuffled.
    found = texts.join(F.broadcast(few), id_col).withColumn("h", F.xxhash64("text")).where(F.octet_length("text") <= sample_bytes)
    one = keep(found.groupBy(id_col, "label").agg(F.min(F.struct("h", "text")).alias("t")).select(F.col(id_col).alias("id"), "label", "t.text"), "labelled")
    # Sizes of at most 2 * sample rows.
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = one.select("id", "label", F.octet_length("text").alias("size")).withColumn("upto", F.sum("size").over(order))
    return one.join(sized.where(F.col("upto") <= sample_bytes).select("id"), "id", "left_semi").select("id", "text", "label")


def fit(rows: DataFrame) -> Model:
    """Trains in one task on an executor, as the sample is bounded; the model comes back as bytes."""

    def run(batches):
        seen = [x for batch in batches for x in batch.to_pylist()]
        seen.sort(key=lambda r: (str(r["id"]), r["text"]))
        model = train([r["text"] for r in seen], [r["label"] for r in seen])
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["model", "bias"])

    found = rows.repartition(1).mapInArrow(lean(run), "model binary, bias double").first()
    if found is None:
        return train([], [])
    return Model(np.frombuffer(found.model, np.float32), found.bias)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), held_out, score and predicted.

    held_out: the id is one that labels are never learned from. score: probability that label 1 holds; a null or empty
    text gets that of no evidence. predicted: 1 from the threshold on. A null id is not held out. Repeated rows score
    alike. Without labels of both kinds the score is their share. Columns of docs that clash with the results' names are
    replaced; an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("held_out", "score", "predicted")]
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, id_col, text_col, sample)))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    named = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                columns = [*part.drop_columns(["text"]).columns, pa.array(model.value.scores(part.column("text")), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "held_out", "score"])

    fields = [docs.schema[c] for c in carry] + [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return named.mapInArrow(lean(run), T.StructType(fields)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
