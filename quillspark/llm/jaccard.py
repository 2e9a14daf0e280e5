"""N-gram Jaccard join: tiles of sets of like size that share a rare shingle, filtered by bitmaps, verified exactly.

A document's set holds its distinct shingles of SHINGLE words. Documents of one set form a class, named by 128 bits of
its content, and classes are what is joined. If two sets are similar enough, then in any fixed order of all shingles
their prefixes share one. A tile is what shares a prefix shingle within a band of sizes: bands are so wide that a set can
only be similar to sets of its own and the neighbouring bands, so it stands in the tile of its band and, as a guest, in
that of the next. How far into a set the shared shingle stands bounds the overlap too.

The order puts shingles last that many documents hold, so what copies of one text have in common comes after what each
has alone. Which these are is found by counting a sample of all shingles, drawn by their hash, and taking the whole set
of a document that holds a frequent one; where they come from is only a matter of speed.

Each class has a bitmap of four bits and more a shingle, and one folded from it to BITS bits: the parity of its shingles
by hashed position. Where two bitmaps differ, the sets do, so the count of such bits bounds their overlap from above.
Pairs that pass the narrow and then the wide ones are verified on the sorted arrays.

A tile of many near copies must not become all its pairs. Each class of a tile is first only paired with the tile's
head, the class with the least of its own before the shared shingle, and what these pairs link is merged. While tiles
hold many pairs of different components, and it links enough of them, this is repeated with a new head from outside of a
tile's largest component. What is left is joined, pairs of different components only, large tiles in blocks. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, keep_alone
from .components import components
from .repeats import POOL, Wanted, among, identified, repeated_hashes, second_pass
from .textbatch import NONSPACE, Words, digest, grams, lean, mix, release, slices

SHINGLE = 5
PERCENT = 80
LONGS = 8
BITS = 64 * LONGS
NARROW = [f"b{k}" for k in range(LONGS)]
#: A shingle of the sample is frequent in so many documents; so many shingles of documents that hold one come last.
FREQUENT = 16
COMMON = 500_000
#: Pairs of one tile that are compared in one block, pairs of a task, and bytes that it gets, about.
BLOCK, PAIRS, TASK = 20_000, 100_000, 32 << 20
#: Rounds of new heads at most, pairs a row that are few enough to join, one link in how many pairs of a round calls for
#: another, and classes of one tile that meet in one task. All links are found whatever these are.
ROUNDS, FEW, YIELD, MEET = 4, 4, 10, 512
#: Documents that go, of some 40 bytes each, that are broadcast at most.
BROADCAST = 1_000_000
MARKS = ["n_shingles", "component_id", "is_first", "n_rows"]
#: A component of more than one row in so many is joined apart.
HOT = 10_000


def sizes_of_bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band; sets of a band cannot be similar to sets beyond the next."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return np.array(out, np.int64)


def sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; one of the whole text, if it has fewer words; none without words."""
    w = Words(column, NONSPACE, lower=True)
    h = w.hashes()
    g = mix(grams(h, shingle) ^ np.uint64(0x5BD1E995))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(g[a : b - shingle + 1]))
        else:
            out.append(mix(grams(h[a:b], b - a) ^ np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def class_of(members: np.ndarray) -> bytes:
    """What names a set: 128 bits of the hash of its sorted shingles."""
    return digest(members.tobytes())


def parity(members: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The bitmap: per hashed position, whether an odd number of members falls on it. Four bits and more a member."""
    bits = bits or max(BITS, 4 << (len(members) - 1).bit_length())
    odd = np.bincount((mix(members ^ np.uint64(0x2545F491)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bitmap: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap of the same set at fewer bits: positions are the low bits of a hash, so halves fold onto each other."""
    while len(bitmap) > longs:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


class Order:
    """The order of shingles: rare ones by hash, then common ones by count and hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.counts = shingles[by], counts[by]

    def prefix(self, members: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        n = prefix_length(len(members), percent)
        if not len(self.shingles):
            return members[:n]
        at = np.minimum(np.searchsorted(self.shingles, members), len(self.shingles) - 1)
        common = self.shingles[at] == members
        rare = members[~common]
        if len(rare) >= n:
            return rare[:n]
        left, count = members[common], self.counts[at[common]]
        return np.concatenate((rare, left[np.lexsort((left, count))[: n - len(rare)]]))


def _sampled(members: np.ndarray) -> np.ndarray:
    """Some six of a set's shingles, chosen by hash alone, so sets of like size that share some choose alike."""
    rate = max(0, len(members).bit_length() - 3)
    return members[(members & np.uint64((1 << rate) - 1)) == 0]


def _described(batches):
    """Rows (id, tie, key, n, class) of documents, and (key, n, shingle) of their sampled shingles."""
    for batch in batches:
        for part in slices(batch, "text"):
            found = sets(part.column("text"))
            sizes = np.array([len(s) for s in found], np.int64)
            names = pa.array([class_of(s) for s in found], pa.binary())
            sample = [_sampled(s) for s in found]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in sample])
            many, key = len(rows), part.column("key")
            picked = pa.array(np.concatenate([*sample, np.empty(0, np.uint64)]).view(np.int64))
            fields = ["id", "tie", "key", "n", "class", "shingle"]
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), key, pa.array(sizes), names, none], fields)
            nulls = [pa.nulls(many, part.schema.field("id").type), pa.nulls(many, pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, key.take(pa.array(rows)), pa.array(sizes[rows]), pa.nulls(many, pa.binary()), picked], fields)


def _common(described: DataFrame, slim: DataFrame) -> Order:
    """The shingles that come last: those of documents that hold a frequent one, COMMON of them at most.

    Beyond that, only what is more frequent counts; a longer list would only be faster.
    """
    counted = described.where("shingle is not null").groupBy("shingle").agg(F.count("*").alias("many"), F.min("key").alias("key"))
    counted = counted.where(F.col("many") >= FREQUENT).groupBy("key").agg(F.max("many").alias("many"))
    sizes = described.where("shingle is null").groupBy("key").agg(F.first("n").alias("n"))
    heads, least = keep(counted.join(sizes, "key"), "frequent"), 1
    while (heads.where(F.col("many") >= least).agg(F.sum("n")).first()[0] or 0) > COMMON:
        least *= 2
    heads = heads.where(F.col("many") >= least)
    count = {r.key: r.many for r in heads.toLocalIterator()}

    def describe(found: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.repeat(batch.column("key").to_numpy(), [len(s) for s in found])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["key", "shingle"])

    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("key", "shingle")])
    rows = second_pass(slim, heads.select(F.col("key").alias("hash")), _keys, _of_classes(describe), schema).toArrow()
    shingles = rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    counts = np.array([count[k] for k in rows.column("key").to_pylist()], np.int64)
    by = np.lexsort((-counts, shingles))
    _, first = np.unique(shingles[by], return_index=True)
    return Order(shingles[by][first], counts[by][first])


def _entries(found: list[np.ndarray], order: Order, edges: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Tile, set, place of the shared shingle in it, and whether the tile is of its own band, for each set's prefix."""
    heads = [order.prefix(s, percent) if len(s) else s for s in found]
    long = np.array([len(x) for x in heads], np.int64)
    rows = np.repeat(np.arange(len(found)), long)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(long) - long, long)
    values = np.concatenate([*heads, np.empty(0, np.uint64)])
    n = np.array([len(s) for s in found], np.int64)[rows]
    band = np.searchsorted(edges, n, "right") - 1
    # A guest must be able to have the overlap that the least size of the next band asks for.
    guest = (100 + percent) * (n - at) >= percent * (n + edges[np.minimum(band + 1, len(edges) - 1)])
    tile = [mix(values ^ mix(band.astype(np.uint64))), mix(values ^ mix((band + 1).astype(np.uint64)))[guest]]
    home = np.concatenate((np.ones(len(rows), bool), np.zeros(int(guest.sum()), bool)))
    return np.concatenate(tile), np.concatenate((rows, rows[guest])), np.concatenate((at, at[guest])), home


def _tiles(order, copies, percent: int):
    """copies: the sorted keys of documents that have no tiles, as another one of their class has them."""
    edges = sizes_of_bands(percent)

    def emit(batch: pa.RecordBatch, wanted: Wanted | None = None) -> Iterator[pa.RecordBatch]:
        begin = 0
        mine = np.flatnonzero(~among(copies.value, batch.column("key").to_numpy()))
        for part in slices(batch.take(pa.array(mine)), "text"):
            found = sets(part.column("text"))
            tile, rows, at, home = _entries(found, order.value, edges, percent)
            if wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(mine[rows + begin])], ["hash", "row"])
                begin += part.num_rows
                continue
            held = wanted(tile, mine[rows + begin])
            begin += part.num_rows
            tile, rows, at, home = tile[held], rows[held], at[held], home[held]
            names: list[bytes | None] = [None] * len(found)
            for i in np.unique(rows).tolist():
                names[i] = class_of(found[i])
            n = np.array([len(s) for s in found], np.int64)[rows]
            columns = [pa.array(tile.view(np.int64)), pa.array(names, pa.binary()).take(pa.array(rows)), pa.array(n), pa.array(at), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "class", "n", "at", "home"])

    return emit


def _copies(described: DataFrame, classes: DataFrame) -> np.ndarray:
    """The sorted keys of documents that stand for no class: without them a tile holds a class once. More than POOL of them
    stay among the others, which only is slower."""
    others = keep(described.where("n > 0").select("key").join(classes, "key", "left_anti").distinct(), "copies")
    if others.count() > POOL:
        return np.empty(0, np.int64)
    return np.sort(others.toArrow().column("key").to_numpy().astype(np.int64))


def _keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.arange(batch.num_rows))], ["hash", "row"])


def _of_classes(describe):
    """describe(sets, batch) of the documents whose keys are wanted; no others are read."""

    def emit(batch: pa.RecordBatch, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        mine = wanted(batch.column("key").to_numpy(), np.arange(batch.num_rows))
        for part in slices(batch.filter(pa.array(mine)), "text"):
            yield describe(sets(part.column("text")), part)

    return emit


def _names(found: list[np.ndarray]) -> pa.Array:
    return pa.array([class_of(s) for s in found], pa.binary())


def _bitmaps(found: list[np.ndarray], _: pa.RecordBatch) -> pa.RecordBatch:
    wide = [parity(s) for s in found]
    narrow = np.stack([fold(x, LONGS) for x in wide]).view(np.int64) if wide else np.empty((0, LONGS), np.int64)
    columns = [_names(found), *[pa.array(narrow[:, k]) for k in range(LONGS)], pa.array([x.tobytes() for x in wide], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["class", *NARROW, "wide"])


def _arrays(found: list[np.ndarray], _: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_names(found), pa.array([s.tobytes() for s in found], pa.binary())], ["class", "members"])


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sizes and the places of the shared shingle allow a link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * left >= percent * (n + m)) & (F.col(f"{a}.home") | F.col(f"{b}.home"))


def _overlap(a: str, b: str, percent: int) -> Column:
    """Whether the narrow bitmaps let the overlap reach what a link needs."""
    differ = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))).cast("long") for k in NARROW), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _near(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether the wide bitmaps let the overlap reach what a link needs."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    longs = min(len(p), len(q))
    differ = int(np.bitwise_count(fold(p, longs) ^ fold(q, longs)).sum())
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _linked(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether the sets themselves are similar enough."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    same = int((q[at] == p).sum())
    return 100 * same >= percent * (n + m - same)


PAIR = T.StructType([T.StructField("tile", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType())])


def _compared(pairs: DataFrame, values: DataFrame, each: int, test, percent: int, name: str) -> DataFrame:
    """The pairs (tile, a, b, n, m) that pass a test of their classes' values (class, value), of `each` bytes a shingle.

    Pairs of a tile stay together, so a class's value travels once for many pairs. A tile of more than BLOCK pairs is
    cut into blocks of classes against blocks; tasks get about TASK bytes, or PAIRS pairs.
    """
    many = pairs.groupBy("tile").agg(F.ceil(F.sqrt(F.count("*") / BLOCK)).alias("blocks"))
    cell = [F.pmod(F.xxhash64(x), F.col("blocks")) for x in "ab"]
    placed = pairs.join(many, "tile").withColumn("place", F.xxhash64("tile", *cell))
    total = pairs.agg(F.sum(F.col("n") + F.col("m")).alias("size"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(total["size"] or 0) * each // TASK), -(-total["rows"] // PAIRS))
    placed = placed.select(F.pmod("place", F.lit(parts)).alias("part"), "tile", "a", "b", "n", "m")
    needed = placed.select(F.col("part").alias("of"), F.col("a").alias("class")).union(placed.select("part", "b")).distinct()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value = dict(zip(right["class"].to_pylist(), right["value"].to_pylist(), strict=True))
        kept = [test(n, m, value[a], value[b], percent) for a, b, n, m in zip(*(left[c].to_pylist() for c in ("a", "b", "n", "m")), strict=True)]
        out = left.drop_columns(["part"]).filter(pa.array(kept, pa.bool_()))
        del value
        release()
        return out

    by = placed.groupBy("part").cogroup(needed.join(values, "class").select("of", "class", "value").groupBy("of"))
    return keep(by.applyInArrow(run, PAIR), name)


def _described_classes(slim: DataFrame, classes: DataFrame, wanted: DataFrame, describe, schema: T.StructType, name: str) -> DataFrame:
    """What describe() makes of the sets of the wanted classes, by one document of each."""
    keys = keep(classes.join(wanted, "class", "left_semi").select(F.col("key").alias("hash")), f"{name}-keys")
    made = keep(second_pass(slim, keys, _keys, _of_classes(describe), schema), name)
    # Only rows that repeat id and text describe a class more than once.
    return made if made.count() == keys.count() else keep(made.dropDuplicates(["class"]), name)


def _turned(met: DataFrame) -> DataFrame:
    """Pairs (tile, a, b, n, m) of distinct classes, a the lesser, from rows p and q of tiles."""
    turned = F.col("p.class") > F.col("q.class")
    n, m = (F.when(turned, F.col(f"{x}.n")).otherwise(F.col(f"{y}.n")) for x, y in ("qp", "pq"))
    pairs = met.select(F.col("p.tile").alias("tile"), F.least("p.class", "q.class").alias("a"), F.greatest("p.class", "q.class").alias("b"), n.alias("n"), m.alias("m"))
    return keep(pairs.groupBy("a", "b").agg(*[F.min(x).alias(x) for x in ("tile", "n", "m")]), "pairs")


def _links(slim: DataFrame, classes: DataFrame, maps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough: first by wide bitmaps, then by the sorted arrays."""
    near = _compared(pairs, maps.select("class", F.col("wide").alias("value")), 1, _near, percent, "near")
    nodes = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    schema = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("members", T.BinaryType())])
    found = _described_classes(slim, classes, nodes, _arrays, schema, "members")
    return _compared(near, found.select("class", F.col("members").alias("value")), 8, _linked, percent, "linked").select("a", "b")


def _star(tiles: DataFrame, heads: DataFrame | None, percent: int) -> DataFrame:
    """Each class of a tile with the tile's head, a column of tiles or of heads (tile, head)."""
    rows = tiles if heads is None else tiles.join(heads, "tile")
    own = [c for c in tiles.columns if c != "head"]
    met = rows.select(F.struct(*own).alias("p"), F.struct("tile", "head.*").alias("q"))
    apart = F.col("p.class") != F.col("q.class")
    if "root" in own:
        apart &= F.col("p.root") != F.col("q.root")
    return _turned(met.where(apart & _fits("p", "q", percent)))


def _met(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs of a tile whose components differ; a tile of more than MEET classes is met block by block.

    Classes outside of a tile's largest component meet all others; those within it are not made to meet each other.
    """
    blocks = open_.groupBy("tile").agg(F.ceil(F.count("*") / MEET).alias("blocks"))
    placed = open_.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    apart = placed.where(~F.col("main")).withColumn("other", F.explode(every)).withColumnRenamed("block", "mine")
    others = placed.withColumn("mine", F.explode(every)).withColumnRenamed("block", "other")
    same = [F.col(f"p.{x}") == F.col(f"q.{x}") for x in ("tile", "mine", "other")]
    once = (F.col("p.root") != F.col("q.root")) & (F.col("q.main") | (F.col("p.root") < F.col("q.root")))
    return apart.alias("p").join(others.alias("q"), same[0] & same[1] & same[2] & once & _fits("p", "q", percent) & _overlap("p", "q", percent))


def _open(tiles: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Rows of tiles that hold several components, with their root; a new head of each; and pairs a row."""
    placed = tiles.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    placed = keep(placed, "placed")
    by = placed.groupBy("tile", "root").agg(F.count("*").alias("k"), F.min(F.struct("at", "n", "class", "home")).alias("head"))
    main = by.groupBy("tile").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("roots")).where("roots > 1")
    main = keep(main, "open-tiles")
    heads = by.join(main, "tile").where(F.col("root") != F.col("main.root")).groupBy("tile").agg(F.min(F.struct("head", "root")).alias("least"))
    heads = heads.select("tile", F.struct("least.head.*", F.col("least.root").alias("root")).alias("head"))
    row = main.agg(F.sum("all").alias("rows"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs")).first()
    largest = main.select("tile", F.col("main.root").alias("largest"))
    return placed.join(largest, "tile").withColumn("main", F.col("root") == F.col("largest")).drop("largest"), heads, (row["pairs"] or 0) / max(1, row["rows"] or 0)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), n_shingles, component_id, is_first and n_rows.

    component_id: the least id (nulls last) among the documents that links reach; a document's own without links. A null
    or empty text has no shingles and no links. is_first marks one row of each component: of its least id, and then of
    the text of the least hash; rows that repeat id and text are all marked, and n_rows says how many they are. Equal sets
    are linked, whatever their order of words. Columns of docs that clash with the results' names are replaced; an empty
    table gives no rows. Shingles are 64 bits of hash each; a set of one text is held whole, in some 40 bytes a word.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in MARKS]
    named = identified(docs, id_col, text_col, carry)
    single = keep_alone(lambda: _marked(named, percent), "marked")
    if carry == [id_col]:
        return single.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).select(F.col("_id").alias(id_col), *MARKS)
    joined = named.join(single, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in carry], *MARKS)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component of link(): that of its least id, then of the text of the least hash, then the least row.

    Up to BROADCAST documents that go are broadcast, so that no text is shuffled; more of them meet the texts in a join.
    """
    named = identified(docs, id_col, text_col, docs.columns)
    single = keep_alone(lambda: _marked(named, percent), "marked")

    def rows_of(which: Column, how: str) -> DataFrame:
        some = single.where(which).select("_id", "_tie")
        some = F.broadcast(some) if some.count() <= BROADCAST else some
        return named.join(some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), how)

    many, columns = F.col("n_rows") > 1, [F.col(f"c_{c}").alias(c) for c in docs.columns]
    plain = rows_of(~F.col("is_first") | many, "left_anti").select(*columns)
    if not single.where("is_first and n_rows > 1").take(1):
        return plain
    again = rows_of(F.col("is_first") & many, "left_semi").groupBy("id", "tie").agg(F.min(F.struct(*columns)).alias("row"))
    return plain.union(again.select("row.*"))


def _marked(named: DataFrame, percent: int) -> DataFrame:
    """_id, _tie and MARKS of each distinct (id, tie) of identified documents."""
    slim = named.select("id", "tie", "text", F.xxhash64("id", "tie").alias("key"))
    spark = named.sparkSession
    long = lambda x: T.StructField(x, T.LongType())
    name = T.StructField("class", T.BinaryType())
    fields = [T.StructField("id", slim.schema["id"].dataType), long("tie"), long("key"), long("n"), name, long("shingle")]
    described = keep(slim.mapInArrow(lean(_described), T.StructType(fields)), "described")
    order = spark.sparkContext.broadcast(_common(described, slim))
    described = described.where("shingle is null")
    classes = keep(described.where("n > 0").groupBy("class").agg(F.min("key").alias("key")), "classes")

    emit = _tiles(order, spark.sparkContext.broadcast(_copies(described, classes)), percent)
    shared = repeated_hashes(slim, emit, "shingles")
    schema = T.StructType([long("tile"), name, long("n"), long("at"), T.StructField("home", T.BooleanType())])
    tiles = keep(second_pass(slim, shared, emit, emit, schema), "tiles")
    # Only tiles of several classes stay: most others are those of copies of one.
    one = F.struct("at", "n", "class", "home")
    ends = [F.min(one).alias("head"), F.min("class").alias("low"), F.max("class").alias("high"), F.max("home").alias("any"), F.min("n").alias("least")]
    heads = keep(tiles.groupBy("tile").agg(*ends).where("low < high and any").select("tile", "head", "least"), "heads")
    # A class that has too much of its own even for the tile's least set has no link by this tile.
    room = (100 + percent) * (F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("least"))
    tiles = tiles.join(heads, "tile").where(room).groupBy("tile", "class").agg(*[F.first(x).alias(x) for x in ("n", "at", "home", "head")])
    tiles = keep(tiles, "shared-tiles")
    pairs = _star(tiles, None, percent)
    # All have met the head; what stays open holds two others or more.
    many = tiles.where(F.col("class") != F.col("head.class")).groupBy("tile").agg(F.count("*").alias("many")).where("many > 1").select("tile")
    tiles = keep(tiles.drop("head").join(many, "tile", "left_semi"), "open-tiles")
    nodes = tiles.select("class").union(pairs.select("a")).union(pairs.select("b")).distinct()
    schema = T.StructType([name, *[long(x) for x in NARROW], T.StructField("wide", T.BinaryType())])
    maps = _described_classes(slim, classes, nodes, _bitmaps, schema, "bitmaps")
    links = _links(slim, classes, maps, pairs, percent)
    found, roots = links, keep(components(links), "roots")
    open_, heads, each = _open(tiles, roots)
    for _ in range(ROUNDS):
        if each <= FEW or YIELD * links.count() < pairs.count():
            break
        pairs = _star(open_, heads, percent)
        links = _links(slim, classes, maps, pairs, percent)
        found = found.union(links)
        roots = keep(components(found), "roots")
        open_, heads, each = _open(tiles, roots)
    links = _links(slim, classes, maps, _turned(_met(keep(open_.join(maps.drop("wide"), "class"), "open"), percent)), percent)
    roots = keep(components(found.union(links)), "roots") if links.take(1) else roots

    # Without a component of its own key, an empty text would meet all other empty ones in one task.
    alone = F.concat(F.lit("-"), F.xxhash64("id", "tie").cast("string")).cast("binary")
    rooted = described.join(roots, F.col("class") == F.col("node"), "left").select("id", "tie", "n", F.when(F.col("n") > 0, F.coalesce("root", "class")).otherwise(alone).alias("root"))
    rooted = keep(rooted, "rooted")
    # A component is summed up before it is shuffled. Those of more than one row in HOT, which are HOT at most, are
    # broadcast, and their rows go on by a key of their own.
    ends = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "tie")).alias("least")
    least = keep(rooted.where("n > 0").groupBy(F.col("root").alias("_root")).agg(ends, F.count("*").alias("many")), "least")
    hot = F.col("many") * HOT > rooted.count()
    large = least.where(hot).select(F.col("_root").alias("_large"), F.col("least").alias("of_large"))
    out = rooted.join(F.broadcast(large), F.col("root") == F.col("_large"), "left")
    out = out.withColumn("root", F.when(F.col("_large").isNull(), F.col("root")).otherwise(alone)).join(least.where(~hot), F.col("root") == F.col("_root"), "left")
    out = out.withColumn("least", F.coalesce("of_large", "least"))
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("tie") == F.col("least.tie"))
    some = F.col("n") > 0
    out = out.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("n").alias("n_shingles"), F.when(some, F.col("least.id")).otherwise(F.col("id")).alias("component_id"), F.when(some, first).otherwise(F.lit(True)).alias("is_first"))
    return out.groupBy("_id", "_tie").agg(*[F.first(x).alias(x) for x in MARKS[:3]], F.count("*").alias("n_rows"))
