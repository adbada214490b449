"""Byte-pair encoding and decoding, the merges found by a segment tree over adjacent pairs.

Each piece of a word has a tree of its own. Trees of many pieces stand side by side in one array, so
that a merge of all of them takes a few numpy steps: read the roots, merge there, renew the leaves
and what lies above them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

VOCABULARY = "word_bpe_49k.json"
#: Encoded pieces in each of two generations that a worker keeps.
KEPT_PIECES = 250_000
#: Characters of a piece that is still kept.
LONG = 64
#: Leaves of the trees that are worked on side by side.
CELLS = 1 << 17
#: The rank of a pair that can't be merged.
NEVER = 1 << 30

# How the vocabulary's file cuts text into words, and Unicode's white space.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
# The same for small letters of Latin-1, by its letters and numbers.
LATIN_LETTERS, LATIN_NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
LATIN_PIECES = re.compile(rf"[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{LATIN_NUMBERS}]|[^{LATIN_LETTERS}{LATIN_NUMBERS}\t-\r \x85\xa0]+")
# Capitals of Unicode 16 and 17, which lower() does not know yet, as (first, last, distance to the small letter).
NEW_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
# Letters and numbers newer than Unicode 16, which count as neither.
NEWER = re.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
LOWER = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): "σ"}
#: Characters that cutting treats in a way of their own.
RARE = re.compile("[" + "".join(map(chr, LOWER)) + NEWER.pattern[1:])


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairTrees:
    """Segment trees over the ranks of adjacent pairs, one for each piece, as rows of one array.

    Node 1 of a row is its root, nodes 2 k and 2 k + 1 lie below k, and the leaves are the places of
    the pairs. A node holds the least of (rank, place) below it, so the roots name every piece's
    leftmost pair of the lowest rank at once; setting a place renews one node a level.
    """

    def __init__(self, keys: np.ndarray):
        """keys: pieces x places, as many places as a power of two."""
        n, self.width = keys.shape
        self.nodes = np.empty((n, 2 * self.width), keys.dtype)
        self.nodes[:, self.width :] = keys
        level = self.width
        while level > 1:
            np.minimum(self.nodes[:, level : 2 * level : 2], self.nodes[:, level + 1 : 2 * level : 2], out=self.nodes[:, level // 2 : level])
            level //= 2
        self.flat = self.nodes.reshape(-1)

    def least(self, rows: np.ndarray) -> np.ndarray:
        return self.nodes[rows, 1]

    def set(self, rows: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
        root, node = rows * (2 * self.width), places + self.width
        self.flat[root + node] = keys
        for _ in range(self.width.bit_length() - 1):
            node = node >> 1
            below = root + 2 * node
            self.flat[root + node] = np.minimum(self.flat[below], self.flat[below + 1])


class Ranks:
    """The rank of a pair of ids, for many pairs at once: an open hash table with linear probing."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        keys, ranks = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self.home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)  # one key for each free place, the others try the next one
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & (len(self.keys) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = self.home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NEVER)
        left = np.flatnonzero((found != keys) & (found >= 0))  # met another key: on to the next place
        while len(left):
            at[left] = there = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[there]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[there[hit]]
            left = left[~hit & (found >= 0)]
        return out


class Store(dict):
    """What `make` gives for texts, by number, kept in two generations of `room` texts: when the young one is full it becomes the old one, and what is asked for again is young again.

    A text that is new gets its number at once and its value when settle() makes those of all new
    ones together. Texts over LONG characters aren't kept beyond renew().
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], room: int):
        super().__init__()
        self.make, self.room, self.old, self.values, self.old_values = make, room, {}, [], []
        self.fresh: list[str] = []
        self.places: list[int] = []

    def __missing__(self, text: str) -> int:
        self[text] = k = len(self.values)
        known = self.old.get(text)
        if known is None:
            self.fresh.append(text)
            self.places.append(k)
            self.values.append(b"")
        else:
            self.values.append(self.old_values[known])
        return k

    def settle(self) -> None:
        for k, value in zip(self.places, self.make(self.fresh), strict=True):
            self.values[k] = value
        for text in self.fresh:
            if len(text) > LONG:
                del self[text]
        self.fresh, self.places = [], []

    def renew(self) -> None:
        """To be called when no number is held: a full generation makes room."""
        if len(self.values) > self.room:
            self.old, self.old_values, self.values = dict(self), self.values, []
            self.clear()


class Tokenizer:
    """Encodes and decodes as the tokenizers library does with the same file: specials in a text are matched first, then words are normalised, cut and merged."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.suffix = model["end_of_word_suffix"]
        vocabulary = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.specials.values()])
        self.tokens = [""] * size
        for token, k in (vocabulary | self.specials).items():
            self.tokens[k] = token
        merges, made = {}, []  # ids of a pair -> rank; rank -> id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocabulary[a] << 20 | vocabulary[b]] = rank
            made.append(vocabulary[a + b])
        self.made = np.array(made)
        characters = byte_characters()
        self.ranks = Ranks(merges)
        self.void = size  # stands where a symbol was merged into the one before it, and after the last one
        self.inner = np.array([vocabulary[c] for c in characters])
        self.last = np.array([vocabulary[c + self.suffix] for c in characters])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.pieces = Store(self._piece_ids, KEPT_PIECES)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers: while any pair can be merged, merge the leftmost of the lowest rank. Pieces of like length are merged side by side."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        levels = np.frexp(np.maximum(sizes - 2, 0))[1]  # a tree of 2^level places holds the pairs
        for level in np.unique(levels).tolist():
            own = np.flatnonzero(levels == level)
            step = max(1, CELLS >> level)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                for k, ids in zip(some.tolist(), self._merge_rows([pieces[k] for k in some.tolist()], sizes[some], 1 << level), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """Pieces of at most width + 1 bytes."""
        n, pad, bits = len(pieces), width + 1, width.bit_length() - 1
        octets = np.frombuffer(b"".join([p.ljust(pad, b"\0") for p in pieces]), np.uint8).reshape(n, pad)
        rows, places = np.arange(n), np.arange(pad + 1)
        ids = np.full((n, pad + 1), self.void)  # the column `pad` stands for the end on either side
        ids[:, :pad] = np.where(places[:pad] < sizes[:, None], self.inner[octets], self.void)
        ids[rows, sizes - 1] = self.last[octets[rows, sizes - 1]]
        after = np.where(places + 1 < sizes[:, None], places + 1, pad)
        before = np.where(places > 0, places - 1, pad) + np.zeros((n, 1), np.int64)
        trees = PairTrees((self.ranks.of(ids[:, :width].ravel(), ids[:, 1:pad].ravel()).reshape(n, width) << bits) + places[:width])
        never = NEVER << bits
        while len(rows):
            least = trees.least(rows)
            going = least < never
            rows, least = rows[going], least[going]
            i = least & (width - 1)
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            made = self.made[least >> bits]
            ids[rows, i], ids[rows, j] = made, self.void
            after[rows, i], before[rows, k] = k, i
            following, leading = self.ranks.of(made, ids[rows, k]), self.ranks.of(ids[rows, h], made)
            gone, led = j < width, h < width
            trees.set(np.concatenate([rows, rows[gone], rows[led]]), np.concatenate([i, j[gone], h[led]]), np.concatenate([(following << bits) + i, np.full(int(gone.sum()), never), ((leading << bits) + h)[led]]))
        alive = ids != self.void
        packed, ends = ids[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, or of specials, as little-endian 32-bit numbers."""
        return self.merge([p.encode("utf-8") for p in pieces])

    def pieces_of(self, text: str) -> Iterator[list[str] | bytes]:
        """The pieces of a text; each special between them as its id."""
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            yield self.specials[part].to_bytes(4, "little") if k % 2 else cut(part)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; a null text has none."""
        store = self.pieces
        store.renew()
        parts = [[x if isinstance(x, bytes) else array("I", map(store.__getitem__, x)) for x in self.pieces_of(t or "")] for t in texts]
        store.settle()
        value = store.values.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(value, x)) for x in own]) for own in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file has no decoder. Ids that the file doesn't have are left out."""
        tokens = self.tokens
        if ids and not 0 <= min(ids) <= max(ids) < len(tokens):
            ids = [k for k in ids if 0 <= k < len(tokens)]
        return " ".join(map(tokens.__getitem__, ids))


def cut(text: str) -> list[str]:
    """The normalised pieces of a text without specials. White space is in none of them, and neither composition nor lower case reaches across it, so a text is cut as a whole."""
    if _latin(text):
        return LATIN_PIECES.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    if not RARE.search(text):
        return PIECES.findall(text.lower())
    text = text.translate(LOWER).lower()
    # Letters that are too new count as none: a private character stands in for them while the text is cut.
    return [text[m.start() : m.end()] for m in PIECES.finditer(NEWER.sub("\ue000", text))]


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which are composed and hold nothing rare."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """doc_id and ids (array of int). Null and empty texts have no ids; repeated rows are encoded each; other columns of `df` are not read."""

    def run(x: dict) -> dict:
        own = tokenizer(file or path(VOCABULARY))
        return {"doc_id": x["doc_id"], "ids": [np.frombuffer(ids, "<u4").astype(np.int32) for ids in own.encode_all(x["text"])]}

    return map_columns(_given(df, key, text), run, f"doc_id {_kind(df, key)}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", file: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null or no ids give the empty text, null elements are left out."""

    def run(x: dict) -> dict:
        own = tokenizer(file or path(VOCABULARY))
        return {"doc_id": x["doc_id"], "text": [own.decode([k for k in t or [] if k is not None]) for t in x["ids"]]}

    return map_columns(df.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")), run, f"doc_id {_kind(df, key)}, text string")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """Encode and decode again in one pass: doc_id, ids and the SHA-256 of the decoded text. Null texts count as empty."""

    def run(x: dict) -> dict:
        own = tokenizer(file or path(VOCABULARY))
        ids = [np.frombuffer(k, "<u4").astype(np.int32) for k in own.encode_all(x["text"])]
        return {"doc_id": x["doc_id"], "ids": ids, "decoded_sha256": [hashlib.sha256(own.decode(k.tolist()).encode("utf-8")).hexdigest() for k in ids]}

    return map_columns(_given(df, key, text), run, f"doc_id {_kind(df, key)}, ids array<int>, decoded_sha256 string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """Encode and decode again in one pass: doc_id, n_tokens and the SHA-256 of ids and of the decoded text. Null texts count as empty."""

    def run(x: dict) -> dict:
        own = tokenizer(file or path(VOCABULARY))
        out: dict[str, list] = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in own.encode_all(x["text"]):
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist()).encode("utf-8")).hexdigest())
        return out

    return map_columns(_given(df, key, text), run, f"doc_id {_kind(df, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _given(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
