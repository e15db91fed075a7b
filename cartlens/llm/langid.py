"""Language of texts by fusing several kinds of evidence.

1. Text: a naive Bayes model over hashed byte trigrams. It is fitted on the whole texts of all labelled rows and scores whole texts. The
   counts of a language weigh as those of SAMPLE of its rows, so that SMOOTHING means the same in tables of every size. Trigrams
   overlap, so the log likelihood counts TEMPER times. A flat model, `und`, stands for text that is like none of the languages.
2. Host priors: languages by text are counted over all rows for each host, for its domain and in all; a host's
   distribution is smoothed towards its domain's and that towards the global one, with STRENGTH rows.
3. Declared markup language and address suffix: P(value | language), counted over all rows in the same way.

log posterior = log host prior + log P(declared) + log P(suffix) + TEMPER * log likelihood. Each kind may be absent, also in some of the
rows only: P(value | language) is among rows that have a value.
A text of some length decides alone, and its confidence is 1 whatever else is known; `margin` stays open to all kinds: it is the log posterior of the
best language less that of the next one.

Counts of values go to all tasks while they are small; else those of values that more than one row in OFTEN has do, and rows meet the
others by value, so no value brings many rows to one task.

Cases: a text without letters (null and empty ones too) is `und` unless a declared value or suffix that texts with letters have too decides; a null
host, declared value or suffix is no evidence; ties go to the language that is first in alphabetical order; repeated rows count as often as they occur; without
labelled rows every text is `und`; more than MAX_LANGUAGES labels are an error; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cartlens.llm.storage import bound_batches, kept
from cartlens.llm.text import _LOWER, CHUNK, slices, utf8

# Rows of a language that all its rows together weigh as. More rows make its counts more exact, not heavier; none is left out.
SAMPLE = 600
# The model is sent to every task, BUCKETS * 4 bytes for a language. More languages are an error; none is left out.
MAX_LANGUAGES = 512
BUCKETS = 1 << 16
TEMPER = 0.3
SMOOTHING = 0.05
STRENGTH = 20.0
UND = "und"
UND_PRIOR = 1e-4
# Counts of one kind of evidence are sent to every task up to this many bytes, beyond that those of values that more than one row in OFTEN has.
SENT_BYTES = 8_000_000
OFTEN = 1000


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte, and which of them lie inside one text."""
    low = _LOWER[data].astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    if len(data) > 2:
        code[:-2] = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761) >> np.uint32(16)
    inside = np.ones(len(data), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[at >= offsets[:-1]]] = False
    return code, inside


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def _counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigrams of all texts by bucket. At most CHUNK bytes are worked on at once, with the two behind them that trigrams reach into."""
    found = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK + 2]
        code, inside = _trigrams(part, np.clip(offsets - start, 0, len(part)))
        found += np.bincount(code[inside], minlength=BUCKETS)
    return found


def fit(labelled: DataFrame, id_column: str, text_column: str, label_column: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities for each bucket, from all labelled rows. More than MAX_LANGUAGES are an error."""
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label")).where("label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their model is too large to send to every task")
    if not counts:
        return [UND], np.full((1, BUCKETS), -math.log(BUCKETS), np.float32)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for label in pc.unique(batch.column("label")).to_pylist():
                of = batch.filter(pc.equal(batch.column("label"), label))
                for part in slices([of], "text"):
                    held[label] = held.get(label, 0) + _counted(*utf8(part.column("text")))
        for label, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], ["label", "bucket", "n"]
            )

    held = rows.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(held["label"].unique())
    table = np.full((len(languages) + 1, BUCKETS), SMOOTHING)
    for k, language in enumerate(languages):
        of = held[held["label"] == language]
        table[k, of["bucket"].to_numpy()] += of["n"].to_numpy() * min(1.0, SAMPLE / counts[language])
    table[-1] = 1.0
    return [*languages, UND], np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(text: str | Column, model: np.ndarray) -> Column:
    """TEMPER * log likelihood of the whole text for each row of the model; null for texts without letters.

    The model travels with the tasks; it has at most (MAX_LANGUAGES + 1) * BUCKETS * 4 bytes = 134 MB."""

    def score(column: pa.Array) -> pa.Array:
        parts, none = [], []
        sizes = np.diff(utf8(column)[1])
        ends = np.cumsum(sizes)
        start = 0
        while start < len(column):
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            data, offsets = utf8(column.slice(start, end - start))
            code, inside = _trigrams(data, offsets)
            found = np.zeros((len(model), end - start), np.float64)
            full = np.flatnonzero(np.diff(offsets) > 0)
            letters = np.zeros(end - start, bool)
            if len(full):
                for k, row in enumerate(model):
                    found[k, full] = np.add.reduceat(np.where(inside, row[code], np.float32(0)), offsets[full], dtype=np.float64)
                letters[full] = np.logical_or.reduceat(_LETTER[data], offsets[full])
            parts.append((found * TEMPER).T.ravel())
            none.append(~letters)
            start = end
        flat = np.concatenate(parts) if parts else np.zeros(0)
        mask = np.concatenate(none) if none else np.zeros(0, bool)
        n = len(column)
        keep = np.repeat(~mask, len(model))
        lengths = np.where(mask, 0, len(model))
        if not n:
            return pa.array([], pa.list_(pa.float64()))
        places = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        return pa.ListArray.from_arrays(places, pa.array(flat[keep]), mask=pa.array(mask))

    return arrow_udf(score, "array<double>")(text)


def identify(
    rows: DataFrame,
    id_column: str,
    text_column: str,
    languages: list[str],
    model: np.ndarray,
    host: Column | None = None,
    domain: Column | None = None,
    declared: Column | None = None,
    suffix: Column | None = None,
) -> DataFrame:
    """id, language, confidence (its posterior), margin (the best log posterior less the next; null for texts without letters that are `und`),
    text_language (by the text alone) and rejected of every row."""
    n = len(languages)
    if n == 1:
        und = F.lit(UND)
        return rows.select(
            F.col(id_column).alias("id"),
            und.alias("language"),
            F.lit(1.0).alias("confidence"),
            F.lit(None).cast("double").alias("margin"),
            und.alias("text_language"),
            F.lit(True).alias("rejected"),
        )
    evidence = {"host": host, "domain": domain, "declared": declared, "suffix": suffix}
    given = [name for name, c in evidence.items() if c is not None]
    scored = kept(
        rows.select(
            F.col(id_column).alias("id"),
            *[evidence[name].cast("string").alias(name) for name in given],
            likelihoods(F.col(text_column), model).alias("fit"),
        )
        .withColumn("by_text", F.expr("if(fit is null, null, array_position(fit, array_max(fit)) - 1)").cast("int"))
        .withColumn("number", F.monotonically_increasing_id()),
        "scored",
    )
    # Counts over all rows, by language of the text alone; und is no language of a host.
    counted = scored.groupBy("by_text").agg(F.count("*").alias("rows"), *[F.count(name).alias(name) for name in given]).collect()
    totals = {r["by_text"]: r.asDict() for r in counted}
    known = [totals.get(k, {}) for k in range(n - 1)]
    whole = sum(t.get("rows", 0) for t in known)
    world = [(t.get("rows", 0) + 1) / (whole + n - 1) for t in known]

    # For each value of each kind of evidence, rows by language; null if texts tell none of them.
    sizes: dict[str, int] = {}
    if given:
        values = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")) for name in given])).alias("x")
        by_language = F.array(*[F.col(f"c{k}").cast("double") for k in range(n - 1)], F.lit(0.0))
        tallies = kept(
            scored.select("by_text", values)
            .where("x.value is not null")
            .groupBy(F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))
            .agg(F.count("*").alias("rows"), *[F.count(F.when(F.col("by_text") == k, 1)).alias(f"c{k}") for k in range(n - 1)])
            .select("kind", "value", "rows", F.when(F.array_max(by_language) > 0, by_language).alias("n")),
            "tallies",
        )
        sizes = {r["kind"]: r["size"] for r in tallies.groupBy("kind").agg(F.sum(F.octet_length("value") + 8 * n + 32).alias("size")).collect()}

    def beside(found: DataFrame, kind: str) -> DataFrame:
        """The rows with the counts of their value of a kind."""
        counts = tallies.where(F.col("kind") == kind)
        if sizes.get(kind, 0) <= SENT_BYTES:
            return found.join(F.broadcast(counts.select(F.col("value").alias(kind), F.col("n").alias(f"{kind}_n"))), kind, "left")
        often = F.col("rows") * OFTEN > sum(t["rows"] for t in totals.values())
        sent = counts.where(often).select(F.col("value").alias(kind), F.struct("n").alias("sent"))
        rest = counts.where(~often).select("value", F.lit(-1).cast("bigint").alias("place"), F.col("n").alias("rest"))
        found = found.join(F.broadcast(sent), kind, "left").withColumn("value", F.when(F.col("sent").isNull(), F.col(kind)))
        # Rows that look for nothing are dealt out by their number.
        found = found.withColumn("place", F.when(F.col("value").isNull(), F.col("number")).otherwise(F.lit(-1)))
        return found.join(rest, ["value", "place"], "left").withColumn(f"{kind}_n", F.coalesce("sent.n", "rest")).drop("value", "place", "sent", "rest")

    base = F.array(*[F.lit(float(p)) for p in world], F.lit(UND_PRIOR))

    def smoothed(counts: str, above: Column) -> Column:
        held = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        mixed = F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (held + STRENGTH))
        return F.when(F.col(counts).isNull(), above).otherwise(mixed)

    found = scored
    prior = base
    if domain is not None:
        found = beside(found, "domain")
        prior = smoothed("domain_n", prior)
    if host is not None:
        found = beside(found, "host")
        prior = smoothed("host_n", prior)
    logs = F.transform(prior, lambda p: F.log(F.greatest(p, F.lit(UND_PRIOR / 100))))
    for name in ("declared", "suffix"):
        if evidence[name] is None:
            continue
        found = beside(found, name)
        having = F.array(*[F.lit(float(t.get(name, 0))) for t in known], F.lit(0.0))
        ratio = F.zip_with(f"{name}_n", having, lambda c, t: F.log((c + 1.0) / (t + 50.0)))
        logs = F.zip_with(logs, F.when(F.col(f"{name}_n").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(ratio), lambda a, b: a + b)
    fit = F.coalesce("fit", F.array_repeat(F.lit(0.0), n))
    names = F.array(*[F.lit(x) for x in languages])
    silent = F.col("fit").isNull()
    for name in ("declared", "suffix"):
        if name in given:
            silent = silent & F.col(f"{name}_n").isNull()
    return (
        found.withColumn("post", F.zip_with(logs, fit, lambda a, b: a + b))
        .withColumn("top", F.array_max("post"))
        .withColumn("place", F.expr("cast(array_position(post, top) - 1 as int)"))
        .withColumn("certain", 1 / F.expr("aggregate(post, 0D, (a, x) -> a + exp(x - top))"))
        .select(
            "id",
            F.when(silent, UND).otherwise(names[F.col("place")]).alias("language"),
            F.col("certain").alias("confidence"),
            F.when(~silent, F.col("top") - F.sort_array("post", asc=False)[1]).alias("margin"),
            F.when(F.col("by_text").isNull(), UND).otherwise(names[F.col("by_text")]).alias("text_language"),
        )
        .withColumn("rejected", F.col("language") == UND)
    )


def host_evidence(source: Column) -> dict[str, Column]:
    """Host, domain and address suffix by a column that names where rows come from; a name that is no dotted host name is a host only."""
    low = F.lower(source)
    dotted = low.rlike(r"^[a-z0-9_-][a-z0-9._-]*\.[a-z][a-z0-9-]{1,62}$")
    return {
        "host": F.when(dotted, low).otherwise(source),
        "domain": F.when(dotted, F.substring_index(low, ".", -2)),
        "suffix": F.when(dotted, F.substring_index(low, ".", -1)),
    }


def page_evidence() -> dict[str, Column]:
    """Host, domain, declared language and address suffix of rows with `url` and `html`."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    host = F.when(host != "", host)
    # The tags one after another, then the last such attribute of each, so that neither step reads a page more than once.
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<html([^>]*+)"), F.lit(1))
    attributes = F.transform(tags, lambda tag: F.regexp_extract(tag, r"(?is)^.*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    declared = F.lower(F.get(F.filter(attributes, lambda x: x != ""), F.lit(0)))
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    top = F.substring_index(host, ".", -1)
    return {
        "host": host,
        "domain": F.substring_index(host, ".", -2),
        "declared": declared,
        "suffix": F.when(path != "", F.concat(top, F.lit("/"), path)).otherwise(top),
    }


def page_text() -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(plain, r"&[a-zA-Z0-9#]+;", " ")
