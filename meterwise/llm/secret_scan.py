"""Secret scan: fixed patterns, and strings whose sliding-window entropy is that of a random key.

DataFrame functions only; every row is judged by itself, so nothing is shuffled and a lost task is just run again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256  # array elements, or windows, that one fold handles
SCALE = 1 << 20  # entropy sums are whole numbers of this part of a bit
ZERO = 48  # a count of n is the character of this code plus n


def either(word: str) -> str:
    """A pattern for ``word`` in which a letter stands for both its cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Pattern:
    """A kind of secret: ``regex`` and, where set, the least number of characters of its group 1."""

    kind: str
    regex: str
    least: int = 0


@dataclass(frozen=True)
class EntropyClass:
    """A character class: runs of ``alphabet`` are judged by the windows of ``window`` characters inside them."""

    kind: str
    alphabet: str
    window: int
    bits: float  # least Shannon entropy of a window, in bits a character


# Fixed values.  The first AKIA of a run of [A-Z0-9] reaches furthest, and runs of hexadecimal digits are maximal, so
# their least lengths may stand in the patterns; a short assignment still hides what begins inside it.
PATTERNS = (
    Pattern("assign", "(?:" + "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
            + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Pattern("access", "AKIA[A-Z0-9]{16,}"),
    Pattern("hex", "[0-9a-f]{24,}"),
)
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    EntropyClass("entropy_base36", "0-9a-z", 24, 3.7),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_-", 28, 4.0),
)
MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]"  # words, numbers and names joined by signs have no letter beside a digit
# A candidate with one of these in it is no secret: listed alphabets, placeholders, UUIDs, integrity digests ...
ALLOW = ("0123456789", "(?:abcdefghij|ABCDEFGHIJ)", either("example"), either("placeholder"),
         "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", "^sha(?:1|256|384|512)-")
ALLOW_AFTER = "(?:sha(?:1|224|256|384|512)|md5)[:=]$"  # ... nor is one right after such a label
LABEL = 8  # characters before a candidate that are looked at


def weights(window: int) -> list[int]:
    """Entry c: c * log2(c) in parts of ``SCALE``; a window's entropy is log2(window) less their mean."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def most(c: EntropyClass) -> int:
    """The largest sum of weights with which a window still has ``c.bits`` bits a character."""
    return math.floor((math.log2(c.window) - c.bits) * c.window * SCALE)


def _blocks(n: Column) -> Column:
    """0, 1, ... for every ``BLOCK`` of n >= 1 things."""
    return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))


def _fold_ends(lengths: Column) -> Column:
    """Running sums of a short array, after a leading 0."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))


def _running(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The arrays ``names`` replaced by their running sums: within blocks, then over the blocks' totals, so that an
    array of n elements takes work of n * BLOCK and not n * n."""
    def within(name):
        return F.when(F.size(name) > 0, F.transform(_blocks(F.size(name)), lambda b: _fold_ends(F.slice(name, b * BLOCK + 1, F.lit(BLOCK)))))

    def before(name):
        return F.when(F.size(name) > 0, _fold_ends(F.transform(f"{name}_in", lambda block: F.element_at(block, -1))))

    def sums(name):
        shifted = F.transform(f"{name}_in", lambda block, i: F.transform(F.slice(block, F.lit(2), F.lit(BLOCK)), lambda n: n + F.element_at(f"{name}_at", i + 1)))
        return F.coalesce(F.flatten(shifted), F.array().cast("array<bigint>"))

    rows = rows.withColumns({f"{n}_in": within(n) for n in names})
    rows = rows.withColumns({f"{n}_at": before(n) for n in names})
    return rows.withColumns({n: sums(n) for n in names}).drop(*[f"{n}_{x}" for n in names for x in ("in", "at")])


def _matches(rows: DataFrame, regexes: dict[str, str]) -> DataFrame:
    """``rows`` (with ``text``) and a column for each kind: all matches, as structs of start, end, label and string.

    What stands between the matches comes from a split by the same pattern; the running sums of both lengths are the
    places, in code points.  ``label`` is the end of the text before the match.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,string:string>>")

    def gaps(kind):
        return F.slice(f"{kind}_gaps", F.lit(1), F.size(kind))

    def steps(kind):
        both = F.zip_with(gaps(kind), kind, lambda gap, m: F.char_length(gap).cast("long") + F.char_length(m))
        return F.when(F.size(kind) > 0, both).otherwise(F.array().cast("array<bigint>"))

    def found(kind):
        zipped = F.arrays_zip(F.col(f"{kind}_ends").alias("e"), F.col(kind).alias("m"), gaps(kind).alias("g"))
        spans = F.transform(zipped, lambda x: F.struct((x["e"] - F.char_length(x["m"])).alias("start"), x["e"].alias("end"), F.right(x["g"], F.lit(LABEL)).alias("label"), x["m"].alias("string")))
        return F.when(F.size(kind) > 0, spans).otherwise(none)

    rows = rows.withColumns({k: F.regexp_extract_all("text", F.lit(regex), F.lit(0)) for k, regex in regexes.items()})
    rows = rows.withColumns({f"{k}_gaps": F.when(F.size(k) > 0, F.split("text", regex, -1)) for k, regex in regexes.items()})
    rows = _running(rows.withColumns({f"{k}_ends": steps(k) for k in regexes}), [f"{k}_ends" for k in regexes])
    return rows.withColumns({k: found(k) for k in regexes}).drop(*[f"{k}_{x}" for k in regexes for x in ("gaps", "ends")])


def least_weight(string: Column, window: int) -> Column:
    """The least sum of weights over all windows of an ASCII ``string``, which is its most random window.

    The window moves one character at a time: the counts of the character that leaves and of the one that enters
    change by one, and the sum by the difference of two weights.  Counts are kept in a string with one place for each
    character code.  Runs of ``BLOCK`` windows are folded one by one, so long strings take time in proportion.
    """
    table = F.array(*[F.lit(w).cast("long") for w in weights(window)])
    empty = F.struct(F.lit(chr(ZERO) * 128).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("held"), F.lit(None).cast("long").alias("least"))

    def step(state, event):
        place, change = F.abs(event), F.signum(event).cast("int")
        count = F.ascii(F.substring(state["counts"], place, F.lit(1))) - ZERO
        total = state["sum"] + F.element_at(table, count + change + 1) - F.element_at(table, count + 1)
        held = state["held"] + change
        return F.struct(F.overlay(state["counts"], F.char(count + change + ZERO), place, F.lit(1)).alias("counts"), total.alias("sum"), held.alias("held"),
                        F.when(held == window, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

    def block(b):
        part = F.substring(string, b * BLOCK + 1, F.lit(BLOCK + window - 1))
        codes = F.transform(F.split(part, ""), lambda c: F.ascii(c) + 1)
        events = lambda codes: F.flatten(F.transform(codes, lambda c, i: F.when(i < window, F.array(c)).otherwise(F.array(-F.get(codes, i - window), c))))
        return F.aggregate(F.element_at(F.transform(F.array(codes), events), 1), empty, step, lambda state: state["least"])

    return F.array_min(F.transform(_blocks(F.char_length(string) - window + 1), block))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: Sequence[Pattern] = PATTERNS,
                 classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``(doc_id, text, secrets)``, one row for each row of ``docs``.

    ``secrets`` is an array of ``(start, kind_no, end, kind)`` by start and then kind, in code points, ends
    exclusive: all matches of ``patterns`` (leftmost, not overlapping within a kind, then those with too short a group
    dropped), and every candidate of ``classes`` in which some window reaches the class's entropy.  Candidates are
    whole runs of the class's alphabet, at least a window long, with a letter beside a digit; those that ``allow`` or
    a digest's label names are suppressed.  Suppression never touches what a pattern found.  A string may be reported
    under several kinds.

    A null or empty text has no secrets.  Null ids, repeated rows and ties are rows like any other; an empty table
    gives no rows.  Whole texts are read; other columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = _matches(rows, {p.kind: p.regex for p in patterns} | {c.kind: f"[{c.alphabet}]{{{c.window},}}" for c in classes})
    rows = rows.withColumns({p.kind: _long_enough(p) for p in patterns if p.least} | {c.kind: _random(c, allow) for c in classes})
    spans = [_spans(no, x.kind) for no, x in enumerate([*patterns, *classes])]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("secrets"))


def _long_enough(p: Pattern) -> Column:
    return F.filter(p.kind, lambda m: F.char_length(F.regexp_extract(m["string"], f"^(?:{p.regex})", 1)) >= p.least)


def _random(c: EntropyClass, allow: Sequence[str]) -> Column:
    """Candidates that nothing suppresses and that have a window of ``c.bits``."""
    def open_(m):
        listed = m["string"].rlike("|".join(allow)) if allow else F.lit(False)
        return m["string"].rlike(MIXED) & ~m["label"].rlike(ALLOW_AFTER) & ~listed

    return F.filter(F.filter(c.kind, open_), lambda m: least_weight(m["string"], c.window) <= most(c))


def _spans(no: int, kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"], F.lit(no).alias("kind_no"), m["end"], F.lit(kind).alias("kind")))


def digest(secrets: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``(doc_id, text, secrets)`` with every reported span, overlapping ones as one, replaced by ``mark``."""
    rows = scan_secrets(docs, id_col, text_col, **options)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring("text", (state["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["start"] - state["at"]).cast("int")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["end"] <= state["at"], state["out"]).when(s["start"] < state["at"], state["out"])
                        .otherwise(F.concat(state["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate("secrets", start, step, lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.char_length("text"))))
    return rows.select("doc_id", clean.alias("text"), "secrets")
