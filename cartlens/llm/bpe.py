"""Byte-level BPE encoding and decoding with a trie of distinct words.

A text is cut into words as the vocabulary's pattern does. Of the distinct words of a slice of texts, those not
yet known go into a trie (sorted words with the length of the prefix that each shares with the one before). The trie
is walked depth first; every node keeps one number: the last token of the encoding of the prefix that ends there.
A prefix ends in token t exactly if the prefix without t ends in a token after which t is stable, so a shared prefix is worked
out once and a word's ids are read backwards from its last node. Known words are forgotten all at once when
they take too much memory, so a task needs the same memory whatever it reads.

Rows are independent: no shuffle, and a lost task is simply run again.

Cases: a null or empty text has no ids; the special token's string in a text becomes its id, as the tokenizers library
does; repeated rows and ties give equal results; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartlens.llm.storage import bound_batches
from cartlens.llm.text import ragged, range_hashes, slices, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Words kept with their ids in one Python worker.
KNOWN_WORDS = 400_000
# Longer words are told apart by their bytes, not by the fast hash.
LONG_WORD = 64

SPACE, LETTER, NUMBER, OTHER = range(4)
# Code points with the Unicode property White_Space.
WHITE_SPACE = (
    [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = LETTER
        elif first == "N":
            kinds[code] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: str):
        described = json.loads(content)
        to_byte = _byte_characters()
        raw = lambda token: bytes(to_byte[c] for c in token)
        model = described["model"]
        self.special = {x["content"].encode(): x["id"] for x in described["added_tokens"] if x["special"]}
        ids = {raw(token): i for token, i in model["vocab"].items() if token.encode() not in self.special}
        self.ids = ids
        self.bytes = {i: token for token, i in ids.items()} | {i: token for token, i in self.special.items()}
        self._content = content
        self.lengths = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        self._stable: dict[tuple[int, int], bool] = {}
        widths = np.array(self.lengths, np.int64)
        self.token_starts = np.cumsum(widths) - widths
        self.token_widths = widths
        self.token_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(widths))), np.uint8)

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and id of every merge; like `backwards`, made when first asked for."""
        to_byte = _byte_characters()
        raw = lambda token: bytes(to_byte[c] for c in token)
        listed = json.loads(self._content)["model"]["merges"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in listed]
        return {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}

    @cached_property
    def backwards(self) -> dict:
        """Tokens by their bytes from the last to the first."""
        root: dict = {}
        for token, i in self.ids.items():
            node = root
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        return root

    def merged(self, token: bytes) -> list[int]:
        """Ids after all merges, straight from the rule; used on the bytes of two tokens."""
        parts = [self.ids[bytes([b])] for b in token]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.merges.get((parts[i], parts[i + 1]), (1 << 60,))[0])
            found = self.merges.get((parts[best], parts[best + 1]))
            if found is None:
                break
            parts[best : best + 2] = [found[1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether `right` stays a token of its own after `left`."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) > 500_000:
                self._stable.clear()
            known = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
            self._stable[left, right] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word, by one walk through the trie of the words."""
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        last: list[int] = []
        before = b""
        lengths, backwards, stable = self.lengths, self.backwards, self.stable
        for at in order:
            word = words[at]
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared, len(word)):
                node, candidates = backwards, []
                for place in range(end, -1, -1):
                    node = node.get(word[place])
                    if node is None:
                        break
                    if -1 in node:
                        candidates.append((place, node[-1]))
                for place, token in reversed(candidates):
                    if place == 0 or stable(last[place - 1], token):
                        last.append(token)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(last[end - 1])
                end -= lengths[ids[-1]]
            ids.reverse()
            found[at] = ids
            before = word
        return found

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of `ids` in UTF-8; bytes that are no text become U+FFFD."""
        raw = self.token_bytes[ragged(self.token_starts[ids], self.token_widths[ids])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the GPT-2 pattern begin, as places in `data`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes()[np.arange(128)]
    kind = np.empty(n, np.uint8)
    ascii_ = data < 0x80
    kind[ascii_] = kinds[data[ascii_]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        width = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        code = np.where(width == 2, first & 0x1F, np.where(width == 3, first & 0x0F, first & 0x07))
        for k in range(1, 4):
            more = width > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        found = _classes()[code]
        kind[lead] = found
        for k in range(1, 4):
            more = width > k
            kind[lead[more] + k] = found[more]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[texts] = True
    runs = np.flatnonzero(begin)
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[texts] = True
    first_of_text[n] = True

    ends = np.append(runs[1:], n)
    blank = (kind[runs] == SPACE) & ~first_of_text[ends]
    runs_, ends_ = runs[blank], ends[blank]
    final = ends_ - 1
    while True:
        inside = (data[final] & 0xC0) == 0x80
        if not inside.any():
            break
        final = final - inside
    begin[final] = True
    begin[ends_[data[final] == 0x20]] = False

    quote = (kind[runs] == OTHER) & (ends - runs == 1) & (data[runs] == 0x27) & begin[runs] & ~first_of_text[ends]
    places = np.flatnonzero(quote)
    places = places[kind[ends[places]] == LETTER]
    if len(places):
        after = ends[places]
        stop = ends[places + 1]
        one = data[after]
        two = np.where(after + 1 < stop, data[np.minimum(after + 1, n - 1)], 0)
        pair = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        size = np.where(pair, 2, np.isin(one, [115, 116, 109, 100]).astype(np.int64))
        after, stop, size = after[size > 0], stop[size > 0], size[size > 0]
        begin[after] = False
        rest = after + size
        begin[rest[rest < stop]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of whole texts; keeps the words it has seen up to a bound."""

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.vocabulary = vocabulary
        self.encode_words = encode_words or vocabulary.encode_words
        self.forget()

    def forget(self) -> None:
        self.places: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        special = self.vocabulary.special
        found = self.encode_words([b"" if w in special else w for w in words])
        found = [[special[w]] if w in special else ids for w, ids in zip(words, found, strict=True)]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = len(self.places)
        if at + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(at + len(sizes), np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(at + len(sizes), np.int64)])
        self.starts[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(sizes)] = sizes
        self.used += len(flat)
        self.places.update(zip(keys, range(at, at + len(keys))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 places where those of each text begin and end."""
        raw = data.tobytes()
        cuts, special_at = [offsets], []
        for token in self.vocabulary.special:
            at = raw.find(token)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token), "left"):
                    special_at.append((at, at + len(token)))
                at = raw.find(token, at + len(token))
        if special_at:
            cuts.append(np.array(special_at).ravel())
            starts = word_starts(data, np.unique(np.concatenate(cuts)))
            inside = np.zeros(len(data), bool)
            for a, b in special_at:
                inside[a + 1 : b] = True
            starts = starts[~inside[starts]]
        else:
            starts = word_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes = range_hashes(data, starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            hashes[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "big")
        codes, distinct = pd.factorize(hashes)
        if len(self.places) + len(distinct) > KNOWN_WORDS:
            self.forget()
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        keys = distinct.tolist()
        known = self.places
        new = [k for k, key in enumerate(keys) if key not in known]
        if new:
            chosen = first[new]
            spans = zip(starts[chosen].tolist(), ends[chosen].tolist())
            self._learn([keys[k] for k in new], [raw[a:b] for a, b in spans])
        rows = np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))[codes]
        sizes = self.sizes[rows]
        ids = self.ids[ragged(self.starts[rows], sizes)]
        total = np.append(0, np.cumsum(sizes))
        return ids, total[np.searchsorted(starts, offsets)]


_encoders: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content))
    return _encoders[key]


def _decimal(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def read_vocabulary(spark: SparkSession, path: str | None):
    """The vocabulary file (1.6 MB) for all executors, which get texts in batches of bounded size."""
    bound_batches(spark)
    with open(path or VOCABULARY, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(texts: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """id, ids (array of int) and decoded (the text read back from the ids) of every row."""
    content = read_vocabulary(texts.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(content.value)
        for batch in slices(batches, "text"):
            ids, places = known.encode(*utf8(batch.column("text")))
            back = [known.vocabulary.decoded(ids[a:b]).decode() for a, b in zip(places[:-1], places[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids)), pa.array(back)],
                ["id", "ids", "decoded"],
            )

    kind = dict(texts.dtypes)[id_column]
    return texts.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(
        run, f"id {kind}, ids array<int>, decoded string"
    )


def digests(texts: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids in decimal joined by commas and of the decoded text.

    The same as `encode_texts` followed by digests, without moving ids and texts back to the JVM."""
    content = read_vocabulary(texts.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(content.value)
        decimal = np.array([f"{i}," for i in range(len(known.vocabulary.lengths))], "S")
        width = np.char.str_len(decimal).astype(np.int64)
        digits = np.frombuffer(b"".join(decimal.tolist()), np.uint8)
        begins = np.cumsum(width) - width
        for batch in slices(batches, "text"):
            ids, places = known.encode(*utf8(batch.column("text")))
            sizes = width[ids]
            said = digits[ragged(begins[ids], sizes)].tobytes()
            upto = np.append(0, np.cumsum(sizes))[places]
            ids_sha, text_sha = [], []
            for k in range(batch.num_rows):
                ids_sha.append(hashlib.sha256(said[upto[k] : max(upto[k + 1] - 1, upto[k])]).hexdigest())
                back = known.vocabulary.decoded(ids[places[k] : places[k + 1]])
                text_sha.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(places)), pa.array(ids_sha), pa.array(text_sha)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(texts.dtypes)[id_column]
    return texts.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
