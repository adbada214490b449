"""Language identification with a byte convolutional network trained in numpy.

Filters of several widths run over byte embeddings, their responses are max-pooled over a window
of fixed length, and a softmax layer names the language. A text is cut into such windows from end
to end; its logits are their mean, weighted by the bytes each window holds.

A filter's response is a sum of one number for each byte and place, so for scoring the network is
folded into two tables indexed by pairs of bytes: a position costs two look-ups for all filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, held_out, map_columns, table

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Labelled rows learned from, for each language, at most about this many (never more than twice as many on average), picked by a hash of id and text. Their texts are learned from whole.
SAMPLE = 1000
#: Languages learned, the most frequent ones: the network has an output for each.
LANGUAGES = 512
#: Of so many windows one is also learned from as a piece of a few bytes, since texts can be short.
SHORT_EVERY = 4
EPOCHS, BATCH, RATE = 2, 64, 0.01
#: A filter keeps texts whose best language has this share or more.
LEAST_SCORE = 0.35
#: It also asks for this part of the share of known letter trigrams that all but a hundredth of the learned texts have: a softmax over the learned languages can't tell that a text is in none of them.
LEAST_KNOWN = 0.7
#: Runs that say nothing of a language: keys, digests, addresses.
NO_WORD = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Bytes whose trigrams are looked up at once.
SPAN = 1 << 16
#: Windows scored at once.
BLOCK = 512


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[list[np.ndarray]]  # for each width, for each place in it: EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray
    trigrams: np.ndarray  # of the letters learned from
    least_known: float  # least share of them in a text of a learned language

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the pairs of bytes at a position and two bytes on add to each filter's response."""
        own = [[self.embedding @ w for w in width] for width in self.filters]
        first, second = [], []
        for width, parts in zip(WIDTHS, own, strict=True):
            first.append(parts[0][:, None] + parts[1][None, :])
            more = np.zeros((256, 256, FILTERS), np.float32)
            if width > 2:
                more = more + parts[2][:, None]
            if width > 3:
                more = more + parts[3][None, :]
            second.append(more)
        join = lambda x: np.ascontiguousarray(np.concatenate(x, axis=2).reshape(65536, -1), np.float32)
        return join(first), join(second)

    def logits(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """windows: n x WINDOW bytes, zero-padded."""
        first, second = tables
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), BLOCK):
            own = windows[at : at + BLOCK].T.astype(np.int32)
            pairs = own[:-1] << 8 | own[1:]
            best = np.full((own.shape[1], first.shape[1]), -np.inf, np.float32)
            for place in range(WINDOW - max(WIDTHS) + 1):
                response = first.take(pairs[place], axis=0)
                response += second.take(pairs[place + 2], axis=0)
                np.maximum(best, response, out=best)
            out[at : at + BLOCK] = np.maximum(best + self.bias, 0) @ self.weights + self.offset
        return out


def windows_of(text: str) -> np.ndarray:
    """The bytes of a text, A-Z in lower case, as windows, the last one padded with zeros."""
    own = text.encode("utf-8", "surrogatepass").lower()
    n = max(1, -(-len(own) // WINDOW))
    return np.frombuffer(own.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.int32)


def trigrams_of(text: str) -> Iterator[np.ndarray]:
    """Byte trigrams around each letter, A-Z in lower case, everything that is no letter as a blank."""
    own = b" " + NO_WORD.sub(b" ", text.encode("utf-8", "surrogatepass")) + b" "
    for at in range(0, len(own) - 2, SPAN):
        x = _LETTERS[np.frombuffer(own[at : at + SPAN + 2], np.uint8)]
        yield (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[x[1:-1] != 32]


def known_share(text: str, table: np.ndarray) -> float:
    """The share of a text's trigrams that have their bit set in `table`; 1 if it has none."""
    n = known = 0
    for x in trigrams_of(text):
        n, known = n + len(x), known + int((table[x >> 3] >> (x & 7) & 1).sum())
    return known / n if n else 1.0


def trigram_table(trigrams: np.ndarray) -> np.ndarray:
    """A bit for each possible trigram: 2 MB."""
    out = np.zeros(1 << 21, np.uint8)
    np.bitwise_or.at(out, trigrams >> 3, (1 << (trigrams & 7)).astype(np.uint8))
    return out


def learned_trigrams(texts: list[str]) -> tuple[np.ndarray, float]:
    """The trigrams of all texts, and the least share of them to ask for, from how many each fourth text shares with the others."""
    distinct = lambda own: np.unique(np.concatenate([np.empty(0, np.int32), *(np.unique(g) for x in own for g in trigrams_of(x))]))
    table = trigram_table(distinct([x for i, x in enumerate(texts) if i % 4]))
    return distinct(texts), LEAST_KNOWN * float(np.quantile([known_share(x, table) for x in texts[::4]], 0.01))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], trigrams: np.ndarray, least_known: float, seed: int = 7) -> Network:
    """Adam on the cross-entropy, each language weighing the same."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = [draw(256, EMBEDDING, scale=0.5)]
    params += [draw(EMBEDDING, FILTERS, scale=0.4) for width in WIDTHS for _ in range(width)]
    params += [np.zeros(n_filters, np.float32), draw(n_filters, len(languages), scale=0.1), np.zeros(len(languages), np.float32)]
    places = [(k, i) for k, width in enumerate(WIDTHS) for i in range(width)]
    first_moment, second_moment = ([np.zeros_like(p) for p in params] for _ in range(2))
    share = np.bincount(labels, minlength=len(languages)).astype(float)
    weight = (len(labels) / len(languages) / np.maximum(share, 1))[labels]
    span, step = WINDOW - max(WIDTHS) + 1, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, y, rows = windows[own].astype(np.int64), labels[own], np.arange(len(own))
            embedding, filters, (bias, out, offset) = params[0], params[1:-3], params[-3:]
            tables = [embedding @ f for f in filters]
            responses = [np.zeros((len(own), span, FILTERS), np.float32) for _ in WIDTHS]
            for (k, i), t in zip(places, tables, strict=True):
                responses[k] += t[x[:, i : i + span]]
            tops = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([r.max(axis=1) for r in responses], axis=1) + bias
            active = np.maximum(pooled, 0)
            z = active @ out + offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            dz = (p * (weight[own] / len(own))[:, None]).astype(np.float32)
            dpooled = (dz @ out.T) * (pooled > 0)
            grads = [np.zeros_like(embedding)]
            for j, (k, i) in enumerate(places):
                d = dpooled[:, k * FILTERS : (k + 1) * FILTERS]
                dt = np.zeros((256, FILTERS), np.float32)
                np.add.at(dt, (np.take_along_axis(x, tops[k] + i, axis=1), np.arange(FILTERS)[None, :]), d)
                grads.append(embedding.T @ dt)
                grads[0] += dt @ filters[j].T
            grads += [dpooled.sum(axis=0), active.T @ dz, dz.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    found = iter(params[1:-3])
    return Network(languages, params[0], [[next(found) for _ in range(width)] for width in WIDTHS], *params[-3:], trigrams, least_known)


def samples(df: DataFrame, key: str, text: str, label: str) -> list[tuple[str, str]]:
    """(lang, text) of a sample of the labelled rows that may be learned from, about SAMPLE rows a language, in a fixed order."""
    own = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    rows = own.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(SAMPLE / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("pick")), F.lit(1 << 30)) / float(1 << 30)
    # Rows that are equal in id and text share a draw: the limit holds however many there are.
    picked = rows.withColumn("draw", draw / rate).filter("draw < 1").orderBy("draw").limit(2 * SAMPLE * len(counts))
    return sorted((r["lang"], r["text"]) for r in picked.select("lang", "text").collect() if r["text"] and not r["text"].isspace())


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network | None:
    """A network for the languages that `label` names among rows that aren't held out; None where there are none.

    All windows of the sampled texts are learned from. Rows whose text or label is null are passed
    over; a repeated row counts as often as it is drawn; other columns are not read.
    """
    rows = samples(df, key, text, label)
    languages = [lang for lang, _ in groupby(r[0] for r in rows)]
    if not languages:
        return None
    parts = [windows_of(x) for _, x in rows]
    whole = np.concatenate(parts)
    labels = np.repeat([languages.index(lang) for lang, _ in rows], [len(p) for p in parts])
    rng = np.random.default_rng(11)
    some = rng.permutation(len(whole))[::SHORT_EVERY]
    short, sizes = np.zeros((len(some), WINDOW), np.uint8), rng.integers(4, 48, len(some))
    for k, (i, n) in enumerate(zip(some.tolist(), sizes.tolist(), strict=True)):
        own = whole[i][: max(1, int(np.count_nonzero(whole[i])))]
        at = int(rng.integers(0, max(1, len(own) - n)))
        short[k, : len(own[at : at + n])] = own[at : at + n]
    return train(np.concatenate([whole, short]), np.concatenate([labels, labels[some]]), languages, *learned_trigrams([x for _, x in rows]))


def predict(df: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the softmax share of lang_pred).

    Null texts, texts without a letter, and all texts if there was nothing to learn from are `und`
    with the score 0. Texts of any length are scored whole; repeated rows are scored each; other
    columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(network)
    kind = df.schema[key].dataType.simpleString()

    def run(x: dict) -> dict:
        langs, scores = classify(x["text"], sent.value)
        return {"doc_id": x["doc_id"], "lang_pred": langs, "score": scores}

    return map_columns(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def accepted(df: DataFrame, network: Network | None, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of `df`, with all their columns, whose text is in a language the network knows: not `und`, with a score of `least_score` or more, and of letter trigrams as well known as those it was learned from."""
    sent = df.sparkSession.sparkContext.broadcast(network)

    def keep(texts: list) -> list[bool]:
        found = zip(texts, *classify(texts, sent.value), strict=True)
        return [lang != UNKNOWN and score >= least_score and known_share(t, _known(sent.value)) >= sent.value.least_known for t, lang, score in found]

    return filter_rows(df, text, keep)


_FOLDED: dict[bytes, tuple] = {}


def _folded(network: Network) -> tuple[np.ndarray, np.ndarray]:
    """The tables of the network, made once a worker."""
    name = network.weights.tobytes()
    if name not in _FOLDED:
        _FOLDED.clear()
        _FOLDED[name] = network.tables()
    return _FOLDED[name]


_KNOWN: dict[bytes, np.ndarray] = {}


def _known(network: Network) -> np.ndarray:
    """The network's trigram table, made once a worker."""
    name = network.weights.tobytes()
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = trigram_table(network.trigrams)
    return _KNOWN[name]


def _pieces(windows: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(windows), 8 * BLOCK):
        yield windows[at : at + 8 * BLOCK]


def classify(texts: list[str | None], network: Network | None) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if network else []
    if not known:
        return langs, scores
    tables = _folded(network)
    parts = [windows_of(texts[i]) for i in known]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    whole = np.concatenate(parts)
    logits = np.concatenate([network.logits(w, tables) for w in _pieces(whole)])
    held = np.full(len(whole), float(WINDOW))
    for i, start, part in zip(known, starts, parts, strict=True):
        held[start + len(part) - 1] = len(texts[i].encode("utf-8", "surrogatepass")) - WINDOW * (len(part) - 1)
    mean = np.add.reduceat(logits * held[:, None], starts) / np.add.reduceat(held, starts)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, best, share in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
        langs[i], scores[i] = network.languages[best], share
    return langs, scores


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, fit(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
