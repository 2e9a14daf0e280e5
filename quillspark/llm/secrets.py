"""Secret scans with DataFrame functions only.

Keyword assignments, access keys and hex strings are found by pattern. To these the scan adds what looks random: over
each candidate, a run of one character class, a window slides, and the Shannon entropy of its characters is kept up from
the counts of the character that enters and the one that leaves. The counts are kept too, five bits for each character
in seven numbers, so a step costs the same whatever the window's width. Windows above the class's threshold that
overlap make a span, unless a pattern already covers it. An allow-list explains whole candidates, such as UUIDs, and
windows that hold a sample; what stands beside a sample is judged by its own windows.

Positions come from the lengths of what lies between matches, as split and extraction find the same matches. Entropy is
kept as the sum of count * log2(count) in whole millionths, so it has no rounding to drift.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Characters in a sliding window.
WIDTH = 20
#: Candidate runs and the entropy, in bits a character, from which a window is suspect.
CLASSES = {"hex_entropy": (r"[0-9A-Fa-f]{20,}", 3.0), "text_entropy": (r"[A-Za-z0-9+/_=-]{20,}", 3.8)}
#: Candidates that are no secrets: without a digit or without letters, UUIDs, words with a number.
ALLOWED = r"^[^0-9]*$|^[0-9+/_=-]*$|^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^[A-Za-z+/_=-]+[0-9]{1,4}$"
#: Windows that hold one of these are no secrets: alphabets and samples. No two of them can overlap.
SAMPLES = r"EXAMPLE|example|abcdefgh|ABCDEFGH|0123456789"
KINDS = ["assign", "access", "hex", *CLASSES]
#: Counts of characters, from the first that a class has on, are packed EACH to a long, in BITS bits.
FIRST_CHAR, LAST_CHAR, BITS, EACH = ord("+"), ord("z"), 5, 12
PACKS = (LAST_CHAR - FIRST_CHAR) // EACH + 1
#: So many numbers are added up in one go.
STRETCH = 64
#: count * log2(count) for 0..WIDTH, in millionths.
WEIGHTS = [0, *(round(c * log2(c) * 1_000_000) for c in range(1, WIDTH + 1))]


def most(threshold: float) -> int:
    """The largest sum of WEIGHTS that a window of at least this entropy has."""
    return int(WIDTH * (log2(WIDTH) - threshold) * 1_000_000)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(numbers: Column) -> Column:
    """For each number, the sum of those before it.

    Sums are taken over stretches, and then over their totals, as appending to one list copies it each time.
    """

    def run(xs: Column, value) -> Column:
        def add(a: Column, x: Column) -> Column:
            return F.struct((a["sum"] + value(x)).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out"))

        return F.aggregate(xs, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), add)

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / STRETCH).cast("int")), lambda k: run(F.slice(numbers, k * STRETCH + 1, F.lit(STRETCH)), lambda x: x))

    def joined(parts: Column) -> Column:
        return _let(run(parts, lambda x: x["sum"])["out"], lambda offsets: F.flatten(F.transform(parts, lambda p, k: F.transform(p["out"], lambda x: x + F.get(offsets, k)))))

    return F.when(F.size(numbers) > 0, _let(stretches, joined)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (exclusive) in code points, and a group, of each leftmost match; empty without one."""
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(F.transform(all_, lambda x: F.length(x)).alias("m"), value.alias("v"), F.slice(gaps, F.lit(1), F.size(all_)).alias("g"))

    def placed(steps: Column) -> Column:
        starts = _before(F.transform(steps, lambda x: x["g"] + x["m"]))
        return _let(starts, lambda before: F.transform(steps, lambda x, i: F.struct((F.get(before, i) + x["g"]).alias("start"), (F.get(before, i) + x["g"] + x["m"]).alias("end"), x["v"].alias("value"))))

    return F.when(text.rlike(pattern), _let(steps, placed)).otherwise(_none())


def _suspect(candidate: Column, limit: int) -> Column:
    """(first, last) start of each stretch of overlapping windows whose weight is at most limit and that hold no sample."""
    weight = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    zero = F.lit(0).cast("long")
    codes = F.transform(F.split(candidate, "(?<=.)(?=.)"), lambda c: F.ascii(c) - FIRST_CHAR)

    def change(c: Column, i: Column, sign: int) -> Column:
        """What a character does to the counts: which number, how far up, and one there."""
        place = BITS * F.pmod(c, F.lit(EACH))
        return F.struct(F.floor(c / EACH).cast("int").alias("pack"), place.alias("at"), F.lit(sign).alias("sign"), i.alias("i"))

    def events(codes: Column) -> Column:
        i = F.sequence(F.lit(0), F.size(codes) - 1)
        both = F.transform(i, lambda i: F.array(change(F.get(codes, i - WIDTH), i, -1), change(F.get(codes, i), i, 1)))
        return F.filter(F.flatten(both), lambda x: x["pack"].isNotNull())

    def scan(samples: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            pack = F.lit(0).cast("long")
            for k in range(PACKS):
                pack = F.when(x["pack"] == k, a[f"c{k}"]).otherwise(pack)
            # F.shiftright takes a fixed number of places only.
            count = F.call_function("shiftright", pack, x["at"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
            s = a["s"] + F.get(weight, count + x["sign"]) - F.get(weight, count)
            one = F.call_function("shiftleft", F.lit(1).cast("long"), x["at"]) * x["sign"]
            start = x["i"] - (WIDTH - 1)
            sample = F.exists(samples, lambda m: (m["start"] >= start) & (m["end"] <= start + WIDTH))
            hit = (x["sign"] == 1) & (start >= 0) & (s <= limit) & ~sample
            new = hit & (a["last"].isNull() | (start - a["last"] >= WIDTH))
            done = F.when(new & a["last"].isNotNull(), F.array_append(a["out"], F.struct(a["first"].alias("first"), a["last"].alias("last")))).otherwise(a["out"])
            counts = [F.when(x["pack"] == k, a[f"c{k}"] + one).otherwise(a[f"c{k}"]).alias(f"c{k}") for k in range(PACKS)]
            return F.struct(s.alias("s"), F.when(new, start).otherwise(a["first"]).alias("first"), F.when(hit, start).otherwise(a["last"]).alias("last"), done.alias("out"), *counts)

        none = F.lit(None).cast("int")
        empty = F.array().cast("array<struct<first:int,last:int>>")
        start = F.struct(zero.alias("s"), none.alias("first"), none.alias("last"), empty.alias("out"), *[zero.alias(f"c{k}") for k in range(PACKS)])

        def finish(a: Column) -> Column:
            return F.when(a["last"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(a["first"].alias("first"), a["last"].alias("last"))))

        return F.aggregate(_let(codes, events), start, step, finish)

    return _let(_matches(candidate, SAMPLES), scan)


def _windows(candidates: Column, limit: int) -> Column:
    """start, end and value of the candidates' suspect stretches."""

    def spans(x: Column) -> Column:
        return F.transform(_suspect(x["value"], limit), lambda w: F.struct((x["start"] + w["first"]).alias("start"), (x["start"] + w["last"] + WIDTH).alias("end"), F.substring(x["value"], w["first"] + 1, w["last"] + WIDTH - w["first"]).alias("value")))

    return F.flatten(F.transform(candidates, spans))


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given) and secrets.

    secrets: array of (start, kind_no, end, kind, value), ascending; start and end in code points, end exclusive, kind_no
    the place of the kind in KINDS. value is what may be secret: of an assignment, the part after the sign. Assignments
    need 6 characters of it, access keys 20 characters. A null or empty text has none; repeated rows are each scanned;
    columns of docs named as a result are replaced; an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "secrets"]
    out = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def tagged(found: Column, kind: str) -> Column:
        n = KINDS.index(kind)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

    t = F.col("t")
    assign = F.filter(_matches(t, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    access = F.filter(_matches(t, ACCESS), lambda x: x["end"] - x["start"] >= 20)
    out = out.withColumn("base", F.concat(tagged(assign, "assign"), tagged(access, "access"), tagged(_matches(t, HEX), "hex")))
    for kind, (pattern, threshold) in CLASSES.items():
        maybe = F.filter(_matches(t, pattern), lambda x: ~x["value"].rlike(ALLOWED))
        if kind == "text_entropy":
            maybe = F.filter(maybe, lambda x: ~x["value"].rlike("^[0-9A-Fa-f]*$"))
        out = out.withColumn(f"m_{kind}", maybe)
        out = out.withColumn(f"h_{kind}", _windows(F.col(f"m_{kind}"), most(threshold)))
        spans = F.col(f"h_{kind}")
        spans = F.filter(spans, lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
        out = out.withColumn(f"s_{kind}", tagged(spans, kind))
    found = F.sort_array(F.concat("base", *[f"s_{k}" for k in CLASSES]))
    return out.select(*[F.col(f"c_{c}").alias(c) for c in carry], found.alias("secrets"))


def digest(secrets: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, with each span of scan() replaced by its kind in brackets; overlapping spans are one, of the first's kind.

    A null text stays null; what has no span stays as it is; repeated rows are each redacted.
    """
    out = scan(docs, text_col)

    def add(a: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= a["at"], F.concat(F.substring(F.col(text_col), a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    def rest(a: Column) -> Column:
        return F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(text_col)))

    clean = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, rest)
    return out.withColumn(text_col, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text_col))).drop("secrets")
