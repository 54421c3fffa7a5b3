"""Secret scans, with DataFrame functions only.

Three kinds are patterns: assignments, access keys and long hex strings. Method for the rest: candidate strings (runs
of at least LEAST characters of the base64 alphabets with a digit and a letter) get the Shannon entropy of each
window of WINDOW characters. The counts of the window are kept from step to step, as is the sum of c log c: a step
adds one character and takes one away. A candidate is a secret if its best window reaches the threshold of its
character class, unless it is on the allow-list or overlaps a span of the patterns.

Spans are places in code points, the end exclusive. Matches lie between marks that regexp_replace sets; the mark's
own code point is first exchanged for another in the text, which moves nothing. Null and empty texts have no spans;
texts are scanned whole, whatever their length; rows may repeat. An empty table gives an empty one; columns that are not
kept are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = r"(AKIA[A-Z0-9]{16,})", r"([0-9a-f]{24,})"
LEAST, WINDOW = 20, 20
#: Bits of a character's count, which is at most WINDOW, and counts in a whole number.
BITS, PACKED = 5, 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = rf"((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{LEAST},}})"
#: (name, pattern of the whole candidate, bits of entropy in a window from which it is a secret); the first that fits.
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.0), ("one case", "^([0-9a-z]+|[0-9A-Z]+)$", 3.6), ("any", "^.*$", 3.9))
#: Candidates that are no secrets: UUIDs, placeholders, dates and versions, alphabets, paths and words joined by hyphens or underscores.
ALLOW = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|dummy|placeholder|changeme|xxxx|0123456789|1234567890|abcdefgh|^[0-9/_-]+$|^([a-z]{2,}|[0-9]{1,4})([/_-]([a-z]{2,}|[0-9]{1,4}))+$"
MARK, INSTEAD = "\ue000", "\ue001"
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _spans(parts: Column, kind: int, counts) -> Column:
    """Spans of the odd parts for which counts(part) holds; parts lie between marks."""
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("k"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        hit = (acc["k"] % 2 == 1) & counts(part)
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), F.when(hit, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # Most texts have no match, and so one part.
    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def _parts(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$1{MARK}"), MARK, -1)


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def entropy(text: Column) -> Column:
    """The largest Shannon entropy, in bits, of WINDOW characters in a row; 0 for fewer. Characters outside ALPHABET
    count as one. The counts of the window lie in a few whole numbers, of BITS bits for each character; a step changes
    two of them, and the sum of c log c by what these two add to it."""
    letter = lambda c: F.instr(F.lit(ALPHABET), c)
    place = lambda k: F.struct((F.call_function("div", k, F.lit(PACKED))).cast("int").alias("word"), (k % PACKED * BITS).cast("int").alias("shift"))
    places = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: place(letter(c)))
    words = F.array_repeat(F.lit(0).cast("bigint"), -(-(len(ALPHABET) + 1) // PACKED))
    start = F.struct(words.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"), places.alias("places"))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p["shift"])
    held = lambda counts, p: F.call_function("shiftright", F.get(counts, p["word"]), p["shift"]).bitwiseAND(F.lit((1 << BITS) - 1))

    def step(acc: Column, new: Column) -> Column:
        full = acc["n"] >= WINDOW
        old = F.when(full, F.get(acc["places"], acc["n"] - WINDOW))
        here = lambda p, i: F.when(p["word"] == i, one(p)).otherwise(F.lit(0).cast("bigint"))
        moved = F.transform(acc["counts"], lambda c, i: c + here(new, i) - here(old, i))
        a, b = held(acc["counts"], new), held(acc["counts"], old)
        same = full & (old == new)
        change = F.when(same, 0.0).otherwise(_c_log_c(a + 1) - _c_log_c(a) + F.when(full, _c_log_c(b - 1) - _c_log_c(b)).otherwise(0.0))
        total = acc["sum"] + change
        bits = F.when(acc["n"] + 1 >= WINDOW, F.log2(F.lit(float(WINDOW))) - total / WINDOW).otherwise(0.0)
        return F.struct(moved.alias("counts"), total.alias("sum"), (acc["n"] + 1).alias("n"), F.greatest(acc["best"], bits).alias("best"), acc["places"].alias("places"))

    return F.aggregate(places, start, step, lambda acc: acc["best"])


def is_secret(candidate: Column) -> Column:
    least = None
    for _, pattern, bits in CLASSES:
        fits = candidate.rlike(pattern)
        least = F.when(fits, bits) if least is None else least.when(fits, bits)
    return ~candidate.rlike(ALLOW) & (entropy(candidate) >= least)


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, base and spans: arrays of (start, kind, end) in that order, kind from 1 as in KINDS; base has those of
    the patterns alone."""
    value = lambda part: F.char_length(F.regexp_extract(part, ASSIGN, 2)) >= 6
    always = lambda part: F.lit(True)
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*keep, F.when(F.contains(t, F.lit(MARK)), F.translate(t, MARK, INSTEAD)).otherwise(t).alias("__t"))
    found = found.withColumns({"__1": _parts(F.col("__t"), ASSIGN), "__2": F.when(F.contains("__t", F.lit("AKIA")), _parts(F.col("__t"), ACCESS)), "__3": _parts(F.col("__t"), HEX), "__4": _parts(F.col("__t"), CANDIDATE)})
    none = F.array().cast(f"array<{SPAN}>")
    base = F.array_sort(F.concat(_spans(F.col("__1"), 1, value), F.coalesce(_spans(F.col("__2"), 2, always), none), _spans(F.col("__3"), 3, always)))
    found = found.select(*keep, "__4", base.alias("base"))
    clear = F.filter(_spans(F.col("__4"), 4, is_secret), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.select(*keep, "base", F.when(F.size("__4") > 1, F.array_sort(F.concat("base", clear))).otherwise(F.col("base")).alias("spans"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, instead: str = "[REDACTED]") -> Column:
    """The text with each stretch that spans cover, overlaps being one, replaced."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.array_append(acc["out"], F.concat(gap, F.lit(instead)))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
