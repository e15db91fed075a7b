"""Personal data by patterns, and further identifiers by bootstrapped contexts. Built-in functions only.

1. Four kinds of spans are found by their form (`email`, `ip`, `card`, `phone`). Matches come from regexp_extract_all, their places
   from the lengths of what split leaves between them.
2. These are the seeds. Candidates are what has the shape of a kind without its exact form, outside of seeds: groups of digits joined by
   spaces, brackets, dots or hyphens, and tokens of letters and digits outside of those, for ip, card and phone; addresses with "at" and "dot" in
   brackets or words for email. Every occurrence has lexical patterns: the word before it and the two words before it, however
   far back and whatever stands there.
3. The graph of patterns and instances is scored ROUNDS times. A pattern's precision for a kind is the mean confidence of its
   distinct instances (seeds: 1 for their own kind, 0 for others); an unseen instance has the mean precision of its
   other patterns for the kinds of its shape, 0 for others. A pattern is trusted with a precision of PRECISION and SUPPORT distinct seeds or more. Scores are
   sums per key that combine before the shuffle.
4. Candidates behind a trusted pattern of their shape are reported as `found_<kind>`.

Patterns are written so that each character is looked at a bounded number of times, however long a run is. One text's spans are
gathered within its row.

Cases: a null or empty text has no spans; equal starts are ordered by kind as listed in KINDS; overlapping spans of different
kinds all stay; repeated rows give equal results, and repeated values are one instance; a candidate behind patterns of several kinds
takes the most precise, ties the first kind; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.storage import kept

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"found_{k}" for k in BASE))
ROUNDS = 3
PRECISION = 0.8
SUPPORT = 5

# \G: a match may begin where the one before has ended, within a run of the same characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9]*+(?:[0-9][^\s0-9]*+){4,}+(?!\S)"
# Digits in groups. A match never fails once its first digit is found, so no digit is looked at twice.
GROUPED = r"(?<![A-Za-z0-9])\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+"
_AT, _DOT = (r"\s{0,2}+[\[({<]\s?+" + word + r"\s?+[\])}>]\s{0,2}+" for word in ("at", "dot"))
_NAME = r"[A-Za-z0-9-]++"
SPELLED = (
    r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
    rf"(?:{_AT}{_NAME}(?:(?:{_DOT}|\s{{1,2}}+dot\s{{1,2}}+|\.){_NAME})++|\s{{1,2}}+at\s{{1,2}}+{_NAME}(?:\s{{1,2}}+dot\s{{1,2}}+{_NAME})++)"
)
LEAST_DIGITS, MOST_DIGITS = 7, 19
# The kinds that each shape of candidates can be.
SHAPES = {"grouped": ("ip", "card", "phone"), "token": ("ip", "card", "phone"), "spelled": ("email",)}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

SPAN = "struct<kind: string, start: bigint, end: bigint>"
PLACE = "struct<start: bigint, end: bigint, value: string, left: array<string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    turned = F.reverse(_digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(turned)),
        lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


# kind: pattern, which texts can hold it at all, and which matches count
RULES = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": (CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda m: (F.length(_digits(m)) <= 19) & _luhn(m)),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15)),
    "grouped": (GROUPED, lambda t: t.rlike("[0-9]"), lambda m: F.length(_digits(m)).between(LEAST_DIGITS, MOST_DIGITS)),
    "token": (TOKEN, lambda t: t.rlike(r"[0-9]\S*[0-9]"), lambda m: F.lit(True)),
    "spelled": (SPELLED, lambda t: t.rlike(r"(?i)(?:[\[({<]\s?|\s)at(?:\s?[\])}>]|\s)"), lambda m: F.lit(True)),
}


def _last_words(text: Column) -> Column:
    """The last two stretches without white space, the later one last."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


def _places(matches: str, gaps: str, counts) -> Column:
    """start, end, value and the last two words before every match that counts."""

    def step(a: Column, i: Column) -> Column:
        value, gap = F.get(matches, i), F.get(gaps, i)
        start = a["at"] + F.length(gap)
        end = start + F.length(value)
        # `tail` ends where the match before has ended; a word may go on from there.
        before = F.concat(a["tail"], gap)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"), _last_words(F.lower(before)).alias("left")))
        tail = F.array_join(_last_words(F.concat(before, value)), " ")
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(counts(value), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    empty = F.array().cast(f"array<{PLACE}>")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"), empty.alias("out"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first, step, lambda a: a["out"])
    return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, found).otherwise(empty)


def located(texts: DataFrame) -> DataFrame:
    """_row and carried, and for every kind and every shape of candidates an array of places in _text."""
    text = F.col("_text")
    rows = texts
    for kind, (pattern, possible, _) in RULES.items():
        rows = rows.withColumns(
            {
                f"_{kind}_m": F.when(possible(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
                f"_{kind}_g": F.when(possible(text), F.split(text, pattern, -1)),
            }
        )
    return rows.select("_row", "carried", *[_places(f"_{k}_m", f"_{k}_g", rule[2]).alias(f"_{k}") for k, rule in RULES.items()])


def _of_kind(places: str, kind: Column, *fields: str) -> Column:
    """The places of an array as structs that begin with a kind."""
    return F.transform(places, lambda x: F.struct(kind.alias("kind"), *[x[f].alias(f) for f in fields]))


def _outside(places: Column, taken: str) -> Column:
    """The places that meet none of `taken`."""
    return F.filter(places, lambda x: ~F.exists(taken, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row per seed and candidate: row, kind (null for candidates), shape (null for seeds), start, end, value and pattern."""
    fields = ("start", "end", "value", "left")
    rows = rows.withColumn("_seeds", F.concat(*[_of_kind(f"_{k}", F.lit(k), *fields) for k in BASE]))
    rows = rows.withColumns({f"_{shape}": _outside(F.col(f"_{shape}"), "_seeds") for shape in SHAPES})
    # A token inside of grouped digits is a part of them.
    rows = rows.withColumn("_token", _outside(F.col("_token"), "_grouped"))
    shaped = lambda places, shape: F.transform(places, lambda x: F.struct(F.lit(shape).cast("string").alias("shape"), x.alias("x")))
    candidates = [shaped(_of_kind(f"_{shape}", F.lit(None).cast("string"), *fields), shape) for shape in SHAPES]
    pattern = "transform(sequence(1, size(left)), k -> concat_ws(' ', slice(left, -k, k)))"
    return (
        rows.select("_row", F.explode(F.concat(shaped("_seeds", None), *candidates)).alias("y"))
        .select("_row", "y.shape", "y.x.*")
        .where("size(left) > 0")
        .select("_row", "kind", "shape", "start", "end", F.lower("value").alias("value"), F.explode(F.expr(pattern)).alias("pattern"))
    )


def _fits(shape: str, kind: str) -> Column:
    """Whether an occurrence of this shape can be of the kind."""
    return F.col(shape).isin(*[s for s, kinds in SHAPES.items() if kind in kinds])


def trusted_patterns(occurrences: DataFrame) -> DataFrame:
    """pattern, kind and precision of the patterns that single out a kind, after ROUNDS rounds over the graph."""
    # One edge for a pattern and an instance; an instance that is a seed somewhere is one everywhere.
    edges = occurrences.groupBy("pattern", "value").agg(
        *[F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in BASE],
        F.max(F.col("kind").isNotNull()).alias("seed"),
        *[F.max(F.coalesce(_fits("shape", k), F.lit(False))).alias(f"can_{k}") for k in BASE],
    )
    edges = kept(edges, "edges")
    confidence = edges
    for _ in range(ROUNDS):
        scores = confidence.groupBy("pattern").agg(
            *[F.avg(k).alias(f"p_{k}") for k in BASE],
            *[F.count(F.when(F.col("seed") & (F.col(k) > 0), 1)).alias(f"s_{k}") for k in BASE],
        )
        scores = kept(scores, "patterns")
        # To a pattern, an unseen instance is worth what its other patterns say, so no pattern proves itself.
        unseen = edges.where("not seed").select("pattern", "value", "seed", *[f"can_{k}" for k in BASE]).join(scores.hint("merge"), "pattern")
        sums = unseen.groupBy("value").agg(F.count("*").alias("n"), *[F.sum(f"p_{k}").alias(f"t_{k}") for k in BASE])
        others = [
            F.when((F.col("n") > 1) & F.col(f"can_{k}"), (F.col(f"t_{k}") - F.col(f"p_{k}")) / (F.col("n") - 1)).otherwise(0.0).alias(k)
            for k in BASE
        ]
        heard = unseen.join(sums.hint("merge"), "value").select("pattern", "value", "seed", *others)
        confidence = edges.where("seed").select("pattern", "value", "seed", *BASE).unionByName(heard)
    choices = F.array(*[F.struct(F.col(f"p_{k}").alias("precision"), F.col(f"s_{k}").alias("support"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(BASE)])
    best = F.array_max(F.filter(choices, lambda c: (c["precision"] >= PRECISION) & (c["support"] >= SUPPORT)).cast(
        "array<struct<precision: double, support: bigint, order: int, kind: string>>"
    ))
    return scores.withColumn("best", best).where("best is not null").select("pattern", "best.kind", "best.precision")


def spans(texts: DataFrame, text_column: str, carried: Sequence[str]) -> DataFrame:
    """carried (a struct of the columns named), and spans (array of kind, start, end in code points; end exclusive) by
    start, then kind."""
    held = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("carried")
    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(text_column).alias("_text"), held)
    rows = kept(located(numbered), "located")
    occurrences = kept(_occurrences(rows), "occurrences")
    trusted = kept(trusted_patterns(occurrences), "trusted")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(BASE) for x in (k, -i)])
    found = (
        occurrences.where("kind is null")
        .select("_row", "start", "end", "pattern", "shape")
        .join(trusted, "pattern")
        .where(reduce(Column.__or__, [(F.col("kind") == k) & _fits("shape", k) for k in BASE]))
        .groupBy("_row", "start", "end")
        .agg(F.max(F.struct("precision", order[F.col("kind")].alias("order"), "kind")).alias("best"))
        .groupBy("_row")
        .agg(F.collect_list(F.struct(F.concat(F.lit("found_"), "best.kind").alias("kind"), "start", "end")).alias("found"))
    )
    found = kept(found, "found")
    listed = F.array(*[F.lit(k) for k in KINDS])
    base = [_of_kind(f"_{k}", F.lit(k), "start", "end") for k in BASE]
    every = F.concat(*base, F.coalesce("found", F.array().cast(f"array<{SPAN}>")))
    keyed = F.transform(
        every, lambda x: F.struct(x["start"].alias("start"), F.array_position(listed, x["kind"]).alias("place"), x["kind"].alias("kind"), x["end"].alias("end"))
    )
    ordered = F.transform(
        F.sort_array(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return rows.join(found, "_row", "left").select("carried", ordered.alias("spans"))


def redacted(text: str, spans_: str) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    t = F.col(text)

    def step(a: Column, x: Column) -> Column:
        inside = x["start"] < a["at"]
        piece = F.concat(
            a["out"], F.substring(t, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")
        )
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"), F.when(inside, a["out"]).otherwise(piece).alias("out")
        )

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t)))
    return F.when(F.size(spans_) > 0, F.aggregate(spans_, first, step, rest)).otherwise(t)
