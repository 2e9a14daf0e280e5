"""Text functions as Columns: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
SPACE = r"[\s\x1c-\x1f\x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NUMBER = r"\b\d[\d,.:]*\b"
MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
MONEY = r"(?i)[$₹€£]\s?\d[\d,.]*|\b\d+\s?(k|lakh|crore|usd|inr|rupees?)\b"
URL = r"https?://\S+|\b[\w.-]+@[\w.-]+\.\w+\b"
HEDGE = r"(?i)\b(i (don't|do not) (have|know)|not (in|available|covered|specified|stated)|no information|cannot (find|answer|confirm)|unable to)\b"
EMPTY_STATE = r"(?i)\b(nothing\s+(pinned|posted|scheduled|here)\s+yet|no\s+(notices|updates|announcements|entries|posts)\b|coming\s+soon|stay\s+tuned|to\s+be\s+announced)\b"
BOILERPLATE = r"(?i)^(check hype|apply|sound|←\s*[\w ]{1,20}|tap to reveal|less noise\. more signal)$"
COUNTERS = ["Registrations", "Bounties", "Past Editions"]
DATE = r"(?i)(20\d\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
COUNTER_ZERO = r"\$?0k\+|\b0\+"
IMPERATIVE = [
    r"(?i)^\s*(write|compose|draft)\s+(me\s+)?(a|an|some)\b",
    r"(?i)^\s*(book|order|buy|reserve)\s+(me\s+)?(a|an|my)\b",
    r"(?i)^\s*(translate|summarize|rewrite|refactor)\s+",
    r"(?i)^\s*(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above)\b",
    r"(?i)^\s*(pretend|act as|roleplay|you are now)\b",
]
# End of fixed values.


def unicode(pattern: str) -> str:
    """The pattern with word boundaries and classes of all scripts, whatever the Java version."""
    return f"(?U){pattern}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def clean(text: Column) -> Column:
    """Drops zero-width spaces, makes any run of whitespace one space, and strips."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u200b"), F.lit("")), SPACE, " "))


def stem(word: Column) -> Column:
    """Cuts the first of ing, es and s that leaves more than two letters."""
    out = word
    for suffix in reversed(("ing", "es", "s")):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) > n + 2), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Stems of the runs of ASCII letters and digits, lower-cased; duplicates stay, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), stem)


def sentences(text: Column) -> Column:
    """Cut after ., ! or ? before whitespace and at line ends; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as a list."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def checkable(text: Column) -> Column:
    """The set of specifics in a text: numbers, amounts, addresses, and months by three letters; longer than one."""
    lowered = F.concat(*[F.transform(found(text, unicode(p)), lambda x: F.lower(strip(x))) for p in (NUMBER, MONEY, URL)])
    months = F.transform(found(text, unicode(MONTH)), lambda x: F.lower(F.substring(x, 1, 3)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(lowered, months), lambda x: F.length(x) > 1)))


def like_counter(text: Column, markers: list[str] = COUNTERS) -> Column:
    """Whether a text names one of the counters; a site's own are given as markers."""
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(F.lower(text), m))


def boilerplate(text: Column, pattern: str = BOILERPLATE) -> Column:
    """Whether all of a text is a known phrase; a site's own are given as a pattern."""
    return text.rlike(unicode(pattern))


def header(title: Column, section: Column) -> Column:
    """section and title, or the title alone where it names the section."""
    t, s = strip(title), strip(F.coalesce(section, F.lit("")))
    return F.when((s != "") & ~F.contains(F.lower(t), F.lower(s)), F.concat(s, F.lit(" — "), t)).otherwise(t)


def prefixed(head: Column, child: Column) -> Column:
    """The child under its header, unless it holds it."""
    return F.when(F.contains(F.lower(child), F.lower(head)), child).otherwise(F.concat(head, F.lit(": "), child))


def pack(units: Column, size: int) -> Column:
    """Joins neighbouring units while the result has at most size characters; no unit is ever split."""
    none = F.array().cast("array<string>")

    def add(a: Column, u: Column) -> Column:
        joined = F.when(a["cur"] == "", u).otherwise(F.concat(a["cur"], F.lit(" "), u))
        over = (a["cur"] != "") & (F.length(joined) > size)
        return F.struct(F.when(over, F.array_append(a["out"], a["cur"])).otherwise(a["out"]).alias("out"), F.when(over, u).otherwise(joined).alias("cur"))

    return F.aggregate(units, F.struct(none.alias("out"), F.lit("").alias("cur")), add, lambda a: F.when(a["cur"] != "", F.array_append(a["out"], a["cur"])).otherwise(a["out"]))


def tails(pieces: Column, overlap: int) -> Column:
    """Of each piece but the first, the end of the one before, from its first whole word on; the first has none."""

    def one(_: Column, i: Column) -> Column:
        tail = F.right(F.get(pieces, i - 1), F.lit(overlap))
        whole = F.when(F.contains(tail, F.lit(" ")), F.substring(tail, F.instr(tail, " ") + 1, F.length(tail))).otherwise(tail)
        return F.when(i > 0, whole)

    return F.transform(pieces, one)


def overlapped(pieces: Column, overlap: int) -> Column:
    """Each piece but the first, after the tail of the one before."""
    return F.transform(F.arrays_zip(pieces.alias("p"), tails(pieces, overlap).alias("t")), lambda x: F.when(x["t"].isNull(), x["p"]).otherwise(strip(F.concat(x["t"], F.lit(" "), x["p"]))))


def numbered(prefix: str, doc: Column, i: Column) -> Column:
    return F.format_string(f"{prefix}::%s::%02d", doc.cast("string"), i.cast("int"))


def slug(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
