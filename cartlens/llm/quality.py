"""Document quality from a linear-chain conditional random field over lines.

Every line with something other than white space is labelled good or bad. Its features are shares of character classes, word
statistics and repetition of its own, and the same of the lines before and after. The field is fitted on whole documents of a
bounded sample (about SAMPLE documents of each label, of at most SAMPLE_LINES lines each); a line's label is its document's.
Marginals come from forward and backward products of 2 x 2 matrices, taken by doubling for all documents of a slice
at once, so a text of a million lines takes twenty steps. The score of a document is the mean marginal of "good", weighted with the
bytes of the lines.

Rows are scored independently inside the tasks that read them: no shuffle.

Cases: a text without any such line (null, empty, white space) has the share of good documents among the labelled ones as
score; labels that are null, or not 0 or 1, teach nothing, of repeated labels the smallest counts; with labels of one kind only, or
none, every score is that share (0.5 without labels); repeated rows get equal scores; an empty table gives an empty one;
other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cartlens.llm.storage import bound_batches
from cartlens.llm.text import _LOWER, CHUNK, range_hashes, utf8, words

SAMPLE = 700
SAMPLE_LINES = 400
GOOD_AT = 0.7
STEPS = 250
RIDGE = 1e-3
RATE = 0.08

LOWER, UPPER, DIGIT, BLANK, STOP, SIGN, WIDE, INNER = range(8)
_KIND = np.full(256, SIGN, np.int64)
_KIND[97:123] = LOWER
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[[9, 11, 12, 13, 32]] = BLANK
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = STOP
_KIND[0xC0:] = WIDE
_KIND[0x80:0xC0] = INNER
_BREAK = 10


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that are not blank, their bytes, and the places where the lines of each text begin and end."""
    n = len(offsets) - 1
    begin = np.zeros(len(data), bool)
    begin[1:] = data[:-1] == _BREAK
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros((0, 1)), np.zeros(0), np.zeros(n + 1, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    line = np.repeat(np.arange(len(starts)), sizes)
    kinds = _KIND[data]
    kinds[data == _BREAK] = BLANK
    counts = np.bincount(line * 8 + kinds, minlength=len(starts) * 8).reshape(-1, 8).astype(np.float64)
    seen = counts[:, [LOWER, UPPER, DIGIT, STOP, SIGN, WIDE]].sum(axis=1)

    low = _LOWER[data]
    w_start, w_end, _ = words(low, offsets)
    w_line = line[w_start]
    hashes = range_hashes(low, w_start, w_end)
    length = (w_end - w_start).astype(np.float64)
    m = np.bincount(w_line, minlength=len(starts)).astype(np.float64)
    some = np.maximum(m, 1)
    per = lambda values: np.bincount(w_line, values, len(starts)) / some
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (w_line[1:] == w_line[:-1])).astype(np.float64) if len(hashes) else np.zeros(0)
    codes, _ = pd.factorize(hashes + w_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    fresh = np.zeros(len(hashes))
    fresh[np.unique(codes, return_index=True)[1]] = 1.0

    text = np.searchsorted(offsets, starts, "right") - 1
    whole, _ = pd.factorize(range_hashes(low, starts, starts + sizes) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    copy = np.ones(len(starts))
    copy[np.unique(whole, return_index=True)[1]] = 0.0

    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, WIDE], 1)
    total = np.maximum(seen, 1)
    last = data[np.maximum(starts + sizes - 1 - (data[starts + sizes - 1] == _BREAK), starts)]
    own = np.stack(
        [
            counts[:, SIGN] / total,
            counts[:, UPPER] / letters,
            counts[:, DIGIT] / total,
            counts[:, STOP] / total,
            counts[:, BLANK] / np.maximum(sizes, 1),
            np.minimum(per(length), 30) / 10,
            per((length <= 3).astype(np.float64)),
            per((length >= 14).astype(np.float64)),
            per(again),
            1 - per(fresh),
            copy,
            np.log1p(m) / 5,
            (m <= 2).astype(np.float64),
            np.isin(last, [46, 63, 58, 59]).astype(np.float64),
        ],
        axis=1,
    )
    kept = seen > 0
    own, sizes, text = own[kept], sizes[kept], text[kept]
    places = np.searchsorted(text, np.arange(n + 1))
    # Features of the neighbouring lines; a missing neighbour has zeros and a mark.
    first = np.zeros(len(own), bool)
    first[places[:-1][places[:-1] < places[1:]]] = True
    final = np.append(first[1:], True) if len(own) else first
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[final] = 0
    return np.hstack([own, before, after, first[:, None], final[:, None]]), sizes.astype(np.float64), places


def _scan(matrices: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Product of each matrix with all before it in its chain, up to a factor; `place` counts from 0 in each chain."""
    found = matrices
    step, longest = 1, int(place.max()) + 1 if len(place) else 0
    while step < longest:
        at = np.flatnonzero(place >= step)
        product = np.matmul(found[at - step], found[at])
        product /= product.max(axis=(1, 2), keepdims=True)
        found = found.copy()
        found[at] = product
        step *= 2
    return found


def marginals(unary: np.ndarray, pairs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each step from label to label.

    `unary` is the log odds of good from a line's own features, `pairs` the 2 x 2 log weights of steps."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    sizes = np.diff(places)
    place = np.arange(n) - np.repeat(places[:-1], sizes)
    left = np.repeat(sizes, sizes) - 1 - place
    emit = np.exp(np.stack([np.minimum(0, -unary), np.minimum(0, unary)], axis=1))
    weights = np.exp(pairs - pairs.max())
    step = weights[None] * emit[:, None, :]
    start = place == 0
    step[start] = emit[start][:, None, :]
    alpha = _scan(step, place)[:, 0, :]
    alpha = alpha / alpha.sum(axis=1, keepdims=True)
    # Backwards over transposed matrices: the one of line t stands for the step from t to t + 1.
    ahead = np.empty_like(step)
    ahead[:-1] = step[1:].transpose(0, 2, 1)
    ahead[left == 0] = np.eye(2)
    last = left == 0
    ahead[last] = 0.5
    beta = _scan(ahead[::-1], left[::-1])[::-1][:, 0, :]
    beta = beta / beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(~start)
    joint = alpha[inner - 1][:, :, None] * weights[None] * (emit[inner] * beta[inner])[:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return both[:, 1], joint.sum(axis=0)


@dataclass
class Field:
    """A fitted field: the share of good documents, how features are scaled, their weights, and the weights of steps.
    Without weights the share is all that is known."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    pairs: np.ndarray | None = None

    def good(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, its bytes, and the places of the texts' lines."""
        features, sizes, places = line_features(data, offsets)
        if not len(sizes):
            return sizes, sizes, places
        unary = np.clip((features - self.mean) / self.scale @ self.weights + self.bias, -30, 30)
        return marginals(unary, self.pairs, places)[0], sizes, places


def fit_lines(features: np.ndarray, labels: np.ndarray, places: np.ndarray, share: float) -> Field:
    """Fit by gradient ascent (Adam) on the likelihood of all lines' labels."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = (features - mean) / scale
    y = labels.astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[places[:-1][places[:-1] < places[1:]]] = False
    at = np.flatnonzero(inner)
    steps = np.zeros((2, 2))
    np.add.at(steps, (labels[at - 1], labels[at]), 1.0)
    theta = np.zeros(x.shape[1] + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        weights, bias, pairs = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        good, expected = marginals(np.clip(x @ weights + bias, -30, 30), pairs, places)
        slope = np.concatenate([x.T @ (y - good), [(y - good).sum()], (steps - expected).ravel()]) / len(y) - RIDGE * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(share, mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def fit(texts: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> Field:
    """The field for `labels` (id and label 0 or 1) of `texts`."""
    bound_batches(texts.sparkSession)
    known = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Field(share)
    part = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, SAMPLE / v))])
    hashed = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    # About 2 * SAMPLE rows, whatever the table holds.
    sample = known.where(hashed < part[F.col("label")])
    rows = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "id")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                features, _, places = line_features(*utf8(batch.column("text").slice(k, 1)))
                if 0 < len(features) <= SAMPLE_LINES:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(k, 1), batch.column("label").slice(k, 1), pa.array([features.astype("<f4").tobytes()])],
                        ["id", "label", "features"],
                    )

    kind = dict(texts.dtypes)[id_column]
    held = rows.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, features binary").toPandas()
    held = held.sort_values(["id", "label"], kind="stable")
    width = 14 * 3 + 2
    blocks = [np.frombuffer(x, "<f4").reshape(-1, width).astype(np.float64) for x in held["features"]]
    if held["label"].nunique() < 2:
        return Field(share)
    sizes = np.array([len(b) for b in blocks])
    return fit_lines(np.vstack(blocks), np.repeat(held["label"].to_numpy(), sizes), np.append(0, np.cumsum(sizes)), share)


def score(text: str | Column, field: Field) -> Column:
    """The quality of each whole text, between 0 and 1."""

    if field.weights is None:
        return F.lit(float(field.share))

    def run(column: pa.Array) -> pa.Array:
        sizes = np.diff(utf8(column)[1])
        ends, found, start = np.cumsum(sizes), [], 0
        while start < len(column):
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            good, weight, places = field.good(*utf8(column.slice(start, end - start)))
            scores = np.full(end - start, field.share)
            full = np.flatnonzero(places[:-1] < places[1:])
            if len(full):
                top, all_ = (np.add.reduceat(x, places[full]) for x in (good * weight, weight))
                # The last digits depend on what else is in the slice.
                scores[full] = np.clip(np.round(top / all_, 9), 0, 1)
            found.append(scores)
            start = end
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return arrow_udf(run, "double")(text)
