"""Spelling variants: words one edit apart, found by merging the light subtrees of an errata trie.

The trie of all words is never built whole. A node is a prefix; its heavy child is the character that most of its words
go on with, all others are light, and so is the end of a word. A word has at most log2(words) light edges on its path.
Only there is it merged into the rest of the node, smaller into larger: with the character after the node skipped,
replaced by the heavy one or by a wildcard, or with the heavy one put in front. Whichever edge two words part at, one
of them is light, so terminals that coincide (an equality join, and groups under the wildcard) are all pairs one edit
apart, each found once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches
from .textbatch import lean, mix

# Runs of letters, and the parameters that the query uses.
RUN = r"[A-Za-zÀ-ÿ]"
EVERY, LEAST_CHARS, LEAST_COUNT, RATIO = 199, 6, 5, 5
# End of fixed values.

#: So many nodes, those with most words, are broadcast; the others have few words each and are joined.
TOP_NODES = 4096
WILD = "\u0000"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of every run of letters of at least least_chars code points that occurs at least least_count times.

    A to Z are lower-cased. A run whose CRC-32, of the id, a colon and the run, is a multiple of `every` loses one of its
    code points, the one at that number modulo its length. Counts are summed up by task before they are shuffled.
    """
    run = F.regexp_extract_all(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word, every node on its path (a hash of the prefix) and the code point that follows it, 0 at the end.

    The hash is a running sum of mixed (code point, place) pairs, so a word costs its length. Nodes that share a hash
    would share a heavy child, which any node may have: that changes what is merged where, and not which pairs are found.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            words = batch.column("word").slice(a, 4096).to_pylist()
            sizes = np.array([len(w) for w in words], np.int64)
            codes = np.frombuffer("".join(f"{w}{WILD}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
            place = np.arange(len(codes)) - np.repeat(starts, sizes + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((codes << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)))))
            node = sums[:-1] - np.repeat(sums[starts], sizes + 1)
            ids = pa.array(np.repeat(batch.column("wid").slice(a, 4096).to_numpy(), sizes + 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(node.view(np.int64)), pa.array(place, pa.int32()), pa.array(codes.astype(np.int32))], ["wid", "node", "place", "next"])


def light_edges(words: DataFrame) -> DataFrame:
    """wid, and edges: (place, heavy) of each light edge on the word's path; heavy is the code point of the heavy child.

    words: wid, word. A node of one child has no light edge. Nodes with most words, the root among them, are broadcast.
    """
    edges = words.select("wid", "word").mapInArrow(lean(_edges), "wid long, node long, place int, next int")
    children = edges.groupBy("node", "next").agg(F.count("*").alias("n"))
    # The end of a word is a light edge always; of several heaviest characters the least one is heavy.
    order = F.struct((F.col("next") > 0).cast("int").alias("goes_on"), F.col("n").alias("n"), (-F.col("next")).alias("code"))
    nodes = children.groupBy("node").agg(F.max(order).alias("best"), F.count("*").alias("children"), F.sum("n").alias("size"))
    nodes = keep(nodes.where((F.col("children") > 1) & (F.col("best.goes_on") == 1)).select("node", (-F.col("best.code")).alias("heavy"), "size"), "branching-nodes")
    top = nodes.orderBy(F.col("size").desc(), "node").limit(TOP_NODES).select("node", "heavy")
    rest = nodes.select("node", "heavy").join(F.broadcast(top.select("node")), "node", "left_anti")
    marked = edges.join(F.broadcast(top.withColumnRenamed("heavy", "top")), "node", "left")
    light = F.col("next") != F.col("heavy")
    near = marked.where(F.col("top").isNotNull()).select("wid", "place", "next", F.col("top").alias("heavy")).where(light)
    far = marked.where(F.col("top").isNull()).join(rest, "node").select("wid", "place", "next", "heavy").where(light)
    return near.union(far).groupBy("wid").agg(F.collect_list(F.struct("place", "heavy")).alias("edges"))


def _merges(words: DataFrame) -> DataFrame:
    """word, n, key and found of every merge: a word of the same key differs by one replaced character (kind r), and a word
    equal to found by one that is skipped (s) or put in (i); kind h looks for the heavy word of the key."""
    placed = words.join(light_edges(words), "wid").select("word", "n", F.explode("edges").alias("e"))
    place, heavy = F.col("e.place"), F.chr(F.col("e.heavy"))
    before, here, after = F.substring("word", F.lit(1), place), F.substring("word", place + 1, F.lit(1)), F.substring("word", place + 2, F.length("word"))
    key = F.concat(before, F.lit(WILD), after)
    none = F.lit(None).cast("string")

    def one(kind: str, when: Column, key: Column, found: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), found.alias("found")))

    goes_on = place < F.length("word")
    kinds = F.array(
        one("r", goes_on, key, none),
        one("h", goes_on, key, F.concat(before, heavy, after)),
        one("s", goes_on & (F.substring("word", place + 2, F.lit(1)) != here), none, F.concat(before, after)),
        one("i", F.lit(True), none, F.concat(before, heavy, here, after)),
    )
    return placed.select("word", "n", F.explode(F.array_compact(kinds)).alias("m")).select("word", "n", "m.*")


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, members) of words that differ by one replaced character, and (word, n, other, other_n) of those that differ by
    one more or less, both ways round.

    words: wid, word, n. members hold -n and word, those of largest n first; a key has no more members than there are letters, so
    its pairs need not be listed.
    """
    merges = keep(_merges(words), "merges")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    looked = merges.where(F.col("kind") != "r").join(known, F.col("found") == F.col("other"))
    looked = keep(looked.select("word", "n", "kind", "key", "other", "other_n"), "coinciding")
    light = merges.where("kind = 'r'").select("key", "word", "n")
    heavy = looked.where("kind = 'h'").select("key", F.col("other").alias("word"), F.col("other_n").alias("n"))
    groups = light.union(heavy).groupBy("key").agg(F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("minus"), "word"))).alias("members")).where(F.size("members") > 1)
    one = looked.where("kind <> 'h'").select("word", "n", "other", "other_n")
    both = one.union(one.select(F.col("other"), F.col("other_n"), F.col("word"), F.col("n")))
    return groups, both


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of words (word, n).

    A word's form is the near word of largest n, ties to the least in code-point order, if that is at least ratio times
    the word's own; root follows forms to the last. A null word gives no row; words must differ from each other. An
    empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    small_batches(words.sparkSession)
    words = keep(words.where("word IS NOT NULL").select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "vocabulary")
    groups, both = near_words(words)
    of_group = groups.select("members", F.size("members").alias("size"), F.posexplode("members").alias("at", "m"))
    best = F.when(F.col("at") == 0, F.element_at("members", 2)).otherwise(F.element_at("members", 1))
    seen = of_group.select(F.col("m.word").alias("word"), (F.col("size") - 1).alias("near"), best.alias("best"))
    seen = seen.union(both.select("word", F.lit(1), F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))))
    summed = seen.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    formed = words.join(summed, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    formed = keep(formed, "forms")
    roots = last_forms(formed.where("form IS NOT NULL").select("word", F.col("form").alias("to")), formed.agg(F.max("n")).first()[0] or 1, ratio)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(links: DataFrame, largest: int, ratio: int) -> DataFrame:
    """links (word, to) with `to` moved to the last of its chain, by doubling.

    Each step of a chain multiplies n by ratio at least, so a chain is no longer than the logarithm of the largest n.
    """
    steps = max(1, math.ceil(math.log(largest, ratio)))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("_w"), F.col("to").alias("_to"))
        links = keep(links.join(on, F.col("to") == F.col("_w"), "left").select("word", F.coalesce("_to", "to").alias("to")), f"roots-{k}")
    return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of the vocabulary() of docs; see variants().

    A null or empty text has no words; a null id counts as the text 'null'; rows that repeat count again. Only the id and
    the text are read, so further columns of any name are no matter. Texts are read whole: a run of L letters takes L rows
    of 24 bytes, and a few copies of itself for each light edge. A table without words gives no rows.
    """
    return variants(vocabulary(docs, id_col, text_col, every, least_chars, least_count), ratio)


def normalise(docs: DataFrame, forms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each run of letters in `forms` (word, root) replaced by its root, in column `normalised`; null stays null.

    Runs that are known words come out in lower case. Words are joined by word, and hot words are few after a document's
    own are made distinct; the text is rewritten from its distinct words' roots.
    """
    keyed = docs.withColumn("_row", F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)))
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = keyed.select("_row", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(f"{RUN}+"), F.lit(0)))).alias("word")).distinct()
    moved = forms.where(F.col("root") != F.col("word")).select("word", "root")
    maps = held.join(moved, "word").groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("word", "root"))).alias("_roots"))
    # Runs and what lies between them alternate; every other piece is looked up.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}+|[^A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))
    piece_low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    put = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at("_roots", piece_low(x)), x)), "")
    return keyed.join(maps, "_row", "left").withColumn("normalised", F.when(F.col("_roots").isNull(), F.col(text_col)).otherwise(put)).drop("_row", "_roots")
