"""Answers: contexts, prompts, a pluggable generator, and the whole path from question to response."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.files import kept

from . import guardrails
from .blocks import hashed_dimensions
from .latency import Timings
from .retrieve import TOP_K, Index, retrieve


def readable(docs: DataFrame) -> DataFrame:
    """doc_id, title and text of what is read once it is found: a passage's context, where it has one; ids stand for titles that are not there."""
    title = F.col("title") if "title" in docs.columns else F.col("doc_id").cast("string")
    return docs.select("doc_id", title.alias("title"), F.col("context" if "context" in docs.columns else "text").alias("text"))


def contexts(hits: DataFrame, docs: DataFrame, cite: str = "doc_id") -> DataFrame:
    """qid, contexts and ids (of hits, or of their parents) in order of rank. Texts join only the few hits that are left."""
    found = hits.select("qid", "rank", "doc_id", F.col(cite).alias("cited")).join(readable(docs).select("doc_id", "text"), "doc_id")
    rows = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "cited"))).alias("k"))
    return rows.select("qid", F.col("k.text").alias("contexts"), F.col("k.cited").alias("ids"))


def prompts(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid and prompt: numbered passages, then the question. docs: doc_id, title, text; queries: item_id, text."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] doc_id="), F.col("doc_id").cast("string"), F.lit(" | "), F.col("title"), F.lit("\n"), F.col("text"))
    rows = hits.join(docs.select("doc_id", "title", "text"), "doc_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("k"))
    asked = queries.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return rows.join(asked, "qid").select("qid", F.concat(F.lit("CONTEXT PASSAGES\n"), F.array_join("k.block", "\n\n"), F.lit("\n\nQUESTION\n"), F.col("question")).alias("prompt"))


def first_passage(prompt: str) -> dict:
    """The default generator, without a network: the first passage."""
    body = prompt.split("\n\nQUESTION\n")[0].split("\n", 2)
    return {"answerable": True, "answer": body[2].split("\n\n[2]")[0] if len(body) > 2 else ""}


def retried(call: Callable[[str], dict | str], retryable: Callable[[Exception], bool], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """The call with growing, jittered pauses of 5 s at most between attempts; it never raises. raw is what the call gave, as JSON."""

    def run(prompt: str) -> dict:
        for n in range(attempts):
            try:
                made = call(prompt)
                return {"ok": True, "raw": made} if isinstance(made, str) else {"ok": True, **made, "raw": json.dumps(made)}
            except Exception as error:  # noqa: BLE001  any failure of a generator becomes a row
                if n + 1 == attempts or not retryable(error):
                    return {"ok": False, "answerable": False, "answer": "", "error": str(error)[:160]}
            pause(min(2**n + random.random() * 0.4, 5.0))
        return {"ok": False, "answerable": False, "answer": "", "error": "no attempts"}

    return run


class Bucket:
    """A token bucket: so many calls at once at most, refilled at a rate; acquire waits, but never past its deadline."""

    def __init__(self, per_minute: float, burst: float | None = None, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep):
        self.rate, self.burst = per_minute / 60.0, max(1.0, per_minute if burst is None else burst)
        self.clock, self.pause = clock, pause
        self.held, self.at = self.burst, clock()
        self.lock = threading.Lock()

    def _take(self) -> float:
        """0 if a token was taken, else how long the next one takes to come."""
        with self.lock:
            now = self.clock()
            self.held, self.at = min(self.burst, self.held + (now - self.at) * self.rate), now
            if self.held < 1:
                return (1 - self.held) / self.rate
            self.held -= 1
            return 0.0

    def acquire(self, deadline: float = 10.0) -> bool:
        """Whether a token was had within `deadline` seconds; gives up at once where waiting cannot help."""
        until = self.clock() + deadline
        while (wait := self._take()) > 0:
            if self.clock() + wait > until:
                return False
            self.pause(min(wait, 0.25))
        return True


def paced(call: Callable[[str], dict], per_minute: float, tasks: int, deadline: float = 10.0, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """The call at no more than its task's share of a rate, bursts included; raises TimeoutError past the deadline."""
    bucket = Bucket(per_minute / tasks, None, clock, pause)

    def run(prompt: str) -> dict:
        if not bucket.acquire(deadline):
            raise TimeoutError("rate limit: no call was free before the deadline")
        return call(prompt)

    return run


#: What a generator has to answer: a JSON object of these fields and kinds; the first is required, others have defaults.
FIELDS = {"answerable": ("BOOLEAN",), "answer": ("STRING",), "cited_doc_ids": ("ARRAY<STRING>", "ARRAY<VOID>"), "confidence": ("BIGINT", "DOUBLE", "DECIMAL")}


def decoded(raw: Column) -> Column:
    """ok, answerable, answer, cited_doc_ids and confidence of a generator's output.

    It is read as a whole, so prose before or after an object, or two of them, make it invalid, and so does a field of
    another kind, a missing `answerable`, or a confidence outside of 0 to 1. Invalid output is not ok, and has nothing else.
    """
    # A reader of JSON stops after the first value; as one of two elements, the output must end where it does.
    pair = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"<end>"]')))
    ends = (F.try_variant_get(pair, "$[1]", "string") == "<end>") & F.try_variant_get(pair, "$[2]", "variant").isNull()
    v = F.when(ends, F.try_variant_get(pair, "$[0]", "variant"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(field(name, "variant"))

    def sound(name: str) -> Column:
        kind = F.regexp_replace(kind_of(name), r"\(.*\)", "")
        return F.coalesce(kind.isin(*FIELDS[name]), F.lit(name != "answerable"))

    among = F.coalesce(field("confidence", "double").between(0, 1), F.lit(True))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & among
    for name in FIELDS:
        ok = ok & sound(name)
    values = [field("answerable", "boolean"), F.trim(F.coalesce(field("answer", "string"), F.lit(""))), F.coalesce(field("cited_doc_ids", "array<string>"), F.array().cast("array<string>")), F.coalesce(field("confidence", "double"), F.lit(0.0))]
    return F.struct(ok.alias("ok"), *[F.when(ok, x).alias(name) for name, x in zip(FIELDS, values, strict=True)])


def generate(asked: DataFrame, generator: Callable[[str], dict | str], retryable: Callable[[Exception], bool] = lambda e: True) -> DataFrame:
    """qid, ok, answerable, answer, cited_doc_ids, confidence and error of each prompt, by any callable.

    The callable gives a dictionary or JSON text. Tasks only call it; what it gave is decoded against FIELDS in the JVM,
    row by row, so output of another shape becomes a row that is not ok, and ends nothing.
    """
    call = retried(generator, retryable)

    def run(batches):
        for batch in batches:
            made = [call(p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array([r.get("raw") for r in made], pa.string()), pa.array([r.get("error") for r in made], pa.string())], ["qid", "raw", "error"])

    raw = asked.mapInArrow(run, T.StructType([asked.schema["qid"], *T.StructType.fromDDL("raw string, error string")]))
    rows = raw.withColumn("d", decoded(F.col("raw")))
    error = F.when(F.col("error").isNull() & ~F.col("d.ok"), F.concat(F.lit("not of the schema: "), F.substring("raw", 1, 140))).otherwise(F.col("error"))
    none = F.array().cast("array<string>")
    values = [F.coalesce("d.answerable", F.lit(False)).alias("answerable"), F.coalesce("d.answer", F.lit("")).alias("answer"), F.coalesce("d.cited_doc_ids", none).alias("cited_doc_ids"), F.coalesce("d.confidence", F.lit(0.0)).alias("confidence")]
    return rows.select("qid", F.col("d.ok").alias("ok"), *values, error.alias("error"))


def hashing_embedder(prefix: str = "", dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder of words by hash; queries may be told apart by a prefix. Only distinct words are hashed.

    Only a text without a word has no direction.
    """

    def embed(texts: list[str]) -> np.ndarray:
        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([prefix + x for x in texts], pa.large_string())))
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        at, sign = hashed_dimensions(coded.dictionary.to_pylist(), dim)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # A text that begins or ends with space has an empty word there.
        sign = np.where(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False), 0.0, sign) if len(at) else sign
        rows = np.repeat(np.arange(len(texts)), sizes)
        out = np.bincount(rows * dim + at[codes], sign[codes], len(texts) * dim).reshape(len(texts), dim)
        # Words whose signs cancel out are counted without: a text of any word has a direction.
        lost = ~out.any(1)
        return np.where(lost[:, None], np.bincount(rows * dim + at[codes], np.abs(sign[codes]), len(texts) * dim).reshape(len(texts), dim), out) if lost.any() else out

    return embed


def memoised(cases: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cases joined to what `answer` makes of their distinct keys: each is worked on once, however often it is asked."""
    return cases.join(answer(cases.select(key).distinct()), key)


def ask(docs: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = TOP_K, threshold: float = guardrails.MIN_SCORE, generator: Callable[[str], dict] | None = None, index: Index | None = None, cite: str = "doc_id", timings: Timings | None = None, read: DataFrame | None = None) -> DataFrame:
    """qid, mode, answered, refusal_reason, answer and citations of every query; with an index of docs, they are not
    indexed again.

    docs: doc_id, text and parent, or passages(), which are found by their text, read by their context and cited by their
    parent (cite="parent"). Ids may be of any type. read: doc_id, text and perhaps title of the hits' parents, which are then
    what is read and cited: passages of many chunks a document need not hold its text each. With timings each stage is run and written before the next, and its
    milliseconds are kept: gate, retrieval, contexts, generation (with a generator) and grounding.

    The free gate on scope comes before retrieval; contexts join only the hits of queries that are left.
    """
    asked = queries.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    stage, held = (nullcontext, lambda df, name: df) if timings is None else (timings.stage, kept)
    with stage("gate"):
        inside = held(queries.where(guardrails.scope(F.col("text")) == "in_scope"), "inside")
    with stage("retrieval"):
        hits, results = (held(x, "found") for x in retrieve(index or docs, inside, mode, k))
    if read is not None:
        hits, docs = hits.withColumn("doc_id", F.col("parent")), read
    with stage("contexts"):
        texts = held(contexts(hits, docs, cite), "contexts")
    rows = asked.join(results, "qid", "left").join(texts, "qid", "left").withColumn("n_hits", F.coalesce(F.size("ids"), F.lit(0))).withColumn("top_context", F.get("contexts", F.lit(0)))
    if generator is None:
        generated = F.lit(None).cast("struct<ok:boolean,answerable:boolean,answer:string,grounded:boolean>")
    else:
        with stage("generation"):
            made = held(generate(prompts(hits, readable(docs), inside), generator), "generated")
        rows = rows.join(made.drop("error", "cited_doc_ids", "confidence").withColumnsRenamed({"answer": "g_answer"}), "qid", "left")
        reason = guardrails.grounded(F.coalesce("g_answer", F.lit("")), F.coalesce("contexts", F.array().cast("array<string>")))["reason"]
        generated = F.struct("ok", "answerable", F.col("g_answer").alias("answer"), (reason != "ungrounded_specifics").alias("grounded"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("generated", generated).withColumns({"term_hits": F.coalesce("term_hits", zero), "gate_score": F.coalesce("gate_score", F.lit(0.0))})
    out = guardrails.decide(rows, threshold)
    none = F.array().cast(docs.select(F.array(cite).alias("x")).schema["x"].dataType)
    cited = F.when(F.col("refusal_reason").isin("no_corpus_vocabulary") | F.col("ids").isNull(), none).otherwise(F.col("ids"))
    with stage("grounding"):
        return held(out.select("qid", "mode", "answered", "refusal_reason", "answer", cited.alias("citations")), "answers")
