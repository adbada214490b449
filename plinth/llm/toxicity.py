"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding beside the sum of its character n-grams' embeddings, both found
by hash. Two gated recurrent units read a window of words in either direction, attention weighs
their states, and a logistic unit scores the window. A text is covered by overlapping windows from
end to end and all of them are scored; the highest counts for the text.

Labels belong to texts and not to windows, so training shares a text's gradient among its windows
by the softmax of their scores: the window that speaks most for toxicity learns most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_columns, table

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_ROWS, GRAM_ROWS, WIDTH = 1 << 14, 1 << 15, 8
GRAMS = (3, 4, 5)
#: Bytes of a word whose n-grams are made all at once; longer words take a slower way to the same result.
SHORT = 24
#: Labelled texts learned from, of each label at most about this many, picked by a hash of their id. They are learned from whole.
SAMPLE = 1500
#: Words from one window to the next in learning, as in scoring: windows go through a text end to end and overlap.
LEARNED_STRIDE = STRIDE
#: Windows whose states are held at once in learning. A text with more is gone through twice.
HELD_WINDOWS = 2048
EPOCHS, BATCH, RATE, ROW_RATE = 5, 24, 0.01, 0.15
THRESHOLD = 0.3
#: Words whose input a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 150_000
BLOCK = 1024
#: Rows of each unit's gates in the joint matrix.
GATES = [np.r_[0 : 2 * HIDDEN, 4 * HIDDEN : 5 * HIDDEN], np.r_[2 * HIDDEN : 4 * HIDDEN, 5 * HIDDEN : 6 * HIDDEN]]
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(token: str) -> str:
    """A token in lower case, without the marks around it."""
    return _EDGES.sub("", token.lower())


def tokens_of(text: str | None) -> list[str]:
    return (text or "").split()


def starts_of(n: int, stride: int = STRIDE) -> list[int]:
    """First words of the windows over n words: one every `stride`, the last one ending with the text."""
    return [*range(0, max(n - WINDOW, 0), stride), max(n - WINDOW, 0)]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, row of GRAM_ROWS) of each character n-gram, the ends of a word marked."""
    octets = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    who, rows = [], []
    short = [i for i, o in enumerate(octets) if len(o) <= SHORT]
    groups = [(np.array(short), SHORT)] if short else []
    groups += [(np.array([i]), len(o)) for i, o in enumerate(octets) if len(o) > SHORT]
    for index, width in groups:
        block = np.frombuffer(b"".join(octets[i].ljust(width, b"\0") for i in index), np.uint8).reshape(len(index), width).astype(np.uint64)
        sizes = np.array([len(octets[i]) for i in index])
        for n in GRAMS:
            if width < n:
                continue
            h = np.full((len(index), width - n + 1), n, np.uint64)
            for k in range(n):
                h = (h ^ block[:, k : width - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            real = np.arange(width - n + 1) <= (sizes - n)[:, None]
            at = np.nonzero(real)
            who.append(index[at[0]])
            rows.append((h[at] % np.uint64(GRAM_ROWS)).astype(np.int64))
    return (np.concatenate(who), np.concatenate(rows)) if who else (np.empty(0, np.int64), np.empty(0, np.int64))


def word_rows(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words], np.int64)


@dataclass
class Network:
    words: np.ndarray
    grams: np.ndarray
    inputs: np.ndarray  # 2 WIDTH x 6 HIDDEN: update, reset and candidate gates of the forward, then of the backward unit
    bias: np.ndarray
    states: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    attention: np.ndarray
    output: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Embeddings of words, and what their gradient needs."""
        rows = word_rows(words)
        who, grams = gram_rows(words)
        counts = np.bincount(who, minlength=len(words))
        scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
        sums = np.stack([np.bincount(who, self.grams[grams, d], len(words)) for d in range(WIDTH)], axis=1).astype(np.float32)
        return np.concatenate([self.words[rows], sums * scale[:, None]], axis=1), (rows, who, grams, scale)

    def project(self, words: list[str]) -> np.ndarray:
        return self.embed(words)[0] @ self.inputs + self.bias

    def block(self) -> np.ndarray:
        """Both units' recurrent weights as one 6 HIDDEN x 2 HIDDEN matrix; its rows: update and reset gates of the forward and of the backward unit, then both candidates."""
        out = np.zeros((6 * HIDDEN, 2 * HIDDEN), self.states.dtype)
        for way in range(2):
            out[GATES[way], way * HIDDEN : (way + 1) * HIDDEN] = self.states[way].T
        return out

    def logits(self, ids: np.ndarray, table: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Of windows given as rows of `table` (projected inputs), ids: WINDOW x n; mask: the same, or None if no window is padded.

        Arrays have the windows along their last axis, so that every step works on long runs of
        memory. The units move together, the backward one from the last word on.
        """
        n, u = ids.shape[1], self.block()
        h = np.zeros((2, HIDDEN, n), table.dtype)
        states = np.empty((WINDOW, 2, HIDDEN, n), table.dtype)
        trail = []
        given = np.empty((6 * HIDDEN, n), table.dtype)
        for t in range(WINDOW):
            ahead, back = table.take(ids[t], axis=0), table.take(ids[-1 - t], axis=0)
            given[: 2 * HIDDEN], given[4 * HIDDEN : 5 * HIDDEN] = ahead[:, : 2 * HIDDEN].T, ahead[:, 2 * HIDDEN : 3 * HIDDEN].T
            given[2 * HIDDEN : 4 * HIDDEN], given[5 * HIDDEN :] = back[:, 3 * HIDDEN : 5 * HIDDEN].T, back[:, 5 * HIDDEN :].T
            gates = u @ h.reshape(2 * HIDDEN, n)
            zr = gates[: 4 * HIDDEN] + given[: 4 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr.reshape(2, 2, HIDDEN, n)[:, 0], zr.reshape(2, 2, HIDDEN, n)[:, 1]
            inner = gates[4 * HIDDEN :].reshape(2, HIDDEN, n)
            c = r * inner
            c += given[4 * HIDDEN :].reshape(2, HIDDEN, n)
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if mask is not None:
                new = np.where(np.stack([mask[t], mask[-1 - t]])[:, None], new, h)
            if keep:
                trail.append((h, z, r, c, inner))
            states[t] = h = new
        scores = np.einsum("h,thn->tn", self.attention[:HIDDEN], states[:, 0]) + np.einsum("h,thn->tn", self.attention[HIDDEN:], states[::-1, 1])
        if mask is not None:
            scores = np.where(mask, scores, -1e9)
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        context = np.concatenate([np.einsum("tn,thn->hn", weights, states[:, 0]), np.einsum("tn,thn->hn", weights, states[::-1, 1])])
        return self.output @ context + self.offset[0], (states, trail, weights, context)

    def backward(self, d: np.ndarray, ids: np.ndarray, mask: np.ndarray, kept: tuple, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For the gradient d of the logits: that of the `rows` rows of the table, and those of states, attention, output and offset."""
        states, trail, weights, context = kept
        n, u = len(d), self.block()
        dcontext = (self.output[:, None] * d).reshape(2, HIDDEN, n)
        dweights = np.einsum("hn,thn->tn", dcontext[0], states[:, 0]) + np.einsum("hn,thn->tn", dcontext[1], states[::-1, 1])
        dscores = weights * (dweights - (weights * dweights).sum(axis=0))
        dattention = np.concatenate([np.einsum("tn,thn->h", dscores, states[:, 0]), np.einsum("tn,thn->h", dscores, states[::-1, 1])])
        attention = self.attention.reshape(2, HIDDEN)
        dtable, du, carried = np.zeros((rows, 6 * HIDDEN), states.dtype), np.zeros_like(u), np.zeros((2, HIDDEN, n), states.dtype)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, c, inner = trail[t]
            ways = (t, WINDOW - 1 - t)
            dnew = carried + np.stack([weights[k] * dcontext[way] + dscores[k] * attention[way][:, None] for way, k in enumerate(ways)])
            real = np.stack([mask[k] for k in ways])[:, None]
            passed, dnew = np.where(real, 0, dnew), np.where(real, dnew, 0)
            dc = dnew * (1 - z) * (1 - c * c)
            dzr = np.stack([dnew * (h - c) * z * (1 - z), dc * inner * r * (1 - r)], axis=1).reshape(4 * HIDDEN, n)
            dgates = np.concatenate([dzr, (dc * r).reshape(2 * HIDDEN, n)])
            dgiven = np.concatenate([dzr, dc.reshape(2 * HIDDEN, n)])
            for way, k in enumerate(ways):
                np.add.at(dtable[:, 3 * HIDDEN * way : 3 * HIDDEN * (way + 1)], ids[k], dgiven[GATES[way]].T)
            du += dgates @ h.reshape(2 * HIDDEN, n).T
            carried = (u.T @ dgates).reshape(2, HIDDEN, n) + dnew * z + passed
        dstates = np.stack([du[GATES[way], way * HIDDEN : (way + 1) * HIDDEN].T for way in range(2)])
        return dtable, [dstates, dattention, context @ d, np.array([d.sum()], states.dtype)]

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * logits + self.shift)))


def start(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(draw(WORD_ROWS, WIDTH, scale=0.1), draw(GRAM_ROWS, WIDTH, scale=0.1), draw(2 * WIDTH, 6 * HIDDEN, scale=0.3), np.zeros(6 * HIDDEN, np.float32), draw(2, HIDDEN, 3 * HIDDEN, scale=0.3), draw(2 * HIDDEN, scale=0.3), draw(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32))


def _grouped(order: list[int], counts: list[int]) -> Iterator[list[int]]:
    """Texts in order, up to BATCH at a time and, unless one has more, up to HELD_WINDOWS windows."""
    group, n = [], 0
    for i in order:
        if group and (len(group) == BATCH or n + counts[i] > HELD_WINDOWS):
            yield group
            group, n = [], 0
        group.append(i)
        n += counts[i]
    if group:
        yield group


def train(texts: list[list[str]], labels: np.ndarray, share: float, seed: int = 5) -> Network:
    """texts: the windows of each text, words joined by spaces; share: of toxic texts among all."""
    rng = np.random.default_rng(seed)
    net = start(seed)
    met: dict[str, str] = {}  # one object for each word, however many windows hold it
    shared = lambda w: met.get(w) or met.setdefault(w, normal(w))
    windows = [[list(map(shared, w.split(" "))) if w else [] for w in text] for text in texts]
    counts = list(map(len, windows))
    dense = [net.inputs, net.bias, net.states, net.attention, net.output, net.offset]
    first, second = ([np.zeros_like(p) for p in dense] for _ in range(2))
    seen_words, seen_grams = np.full(WORD_ROWS, 1e-4), np.full(GRAM_ROWS, 1e-4)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step = 0
    best = np.zeros(len(texts))
    for epoch in range(EPOCHS + 1):  # the last one only scores
        learning = epoch < EPOCHS
        order = rng.permutation(len(texts)) if learning else np.arange(len(texts))
        for own in _grouped(order.tolist(), counts):
            rows = [w for i in own for w in windows[i]]
            owner = np.repeat(np.arange(len(own)), [counts[i] for i in own])
            known = {w: k for k, w in enumerate(dict.fromkeys(w for row in rows for w in row))}
            names = list(known) or [""]
            ids = np.zeros((WINDOW, len(rows)), np.int64)
            mask = np.zeros((WINDOW, len(rows)), bool)
            for k, row in enumerate(rows):
                ids[: len(row), k] = [known[w] for w in row]
                mask[: len(row), k] = True
            embedded, given = net.embed(names)
            projected = embedded @ net.inputs + net.bias
            parts = [slice(at, at + HELD_WINDOWS) for at in range(0, len(rows), HELD_WINDOWS)]
            passes = [net.logits(ids[:, p], projected, mask[:, p], learning and len(parts) == 1) for p in parts]
            z = np.concatenate([x for x, _ in passes])
            top = np.full(len(own), -np.inf)
            np.maximum.at(top, owner, z)
            if not learning:
                best[own] = top
                continue
            part = np.exp(z - top[owner])
            total = np.bincount(owner, part, len(own))
            part = part / total[owner]
            whole = np.bincount(owner, part * z, len(own))
            p = 1 / (1 + np.exp(-whole))
            slope = ((p - labels[own]) * balance[own] / len(own))[owner]
            d = (slope * part * (1 + z - whole[owner])).astype(np.float32)
            dproj, grads = np.zeros_like(projected), None
            for k, one in enumerate(parts):
                kept = passes[0][1] if len(parts) == 1 else net.logits(ids[:, one], projected, mask[:, one], True)[1]
                dtable, more = net.backward(d[one], ids[:, one], mask[:, one], kept, len(names))
                dproj += dtable
                grads = more if k == 0 else [a + b for a, b in zip(grads, more, strict=True)]
            dembedded = dproj @ net.inputs.T
            grads = [embedded.T @ dproj, dproj.sum(axis=0), *grads]
            step += 1
            for q, g, m, v in zip(dense, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            words, who, grams, scale = given
            for store, seen, index, g in ((net.words, seen_words, words, dembedded[:, :WIDTH]), (net.grams, seen_grams, grams, (dembedded[:, WIDTH:] * scale[:, None])[who])):
                rows_, back = np.unique(index, return_inverse=True)
                total = np.zeros((len(rows_), WIDTH), np.float32)
                np.add.at(total, back, g)
                seen[rows_] += (total * total).mean(axis=1)
                store[rows_] -= ROW_RATE * total / np.sqrt(seen[rows_])[:, None]
    net.slope, net.shift = calibrated(best, labels, share)
    return net


def calibrated(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """A logistic fit of the labels on the texts' highest logits, the labels weighing as in the whole corpus, by Newton's method."""
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    middle, spread = logits.mean(), logits.std() + 1e-6
    x = np.stack([(logits - middle) / spread, np.ones_like(logits)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + 1e-2 * theta
        theta = theta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
    return float(theta[0] / spread), float(theta[1] - theta[0] * middle / spread)


def learned_windows(text: str) -> list[str]:
    """A text's windows from end to end, words joined by spaces."""
    words = tokens_of(text)
    return [" ".join(words[a : a + WINDOW]) for a in starts_of(len(words), LEARNED_STRIDE)]


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """A network for the 0/1 column `label` of `labels`, from rows that aren't held out; None where either value is missing.

    Null labels and ids are passed over; of several labels of one id the greatest counts, and of
    several texts of one id the one of the least hash. All windows of the sampled texts are learned
    from.
    """
    given = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).cast("string").alias("label_id")).agg(F.max(label).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("label_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    picked = given.filter(draw < F.when(F.col("toxic") == 1, SAMPLE / counts[1]).otherwise(SAMPLE / counts[0]))
    # About 2 SAMPLE ids, whatever the size of the tables, and one text of each.
    texts = df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("one"))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in one.select("doc_id", "one.toxic", "one.text").collect())
    if len({r[1] for r in rows}) < 2:
        return None
    return train([learned_windows(r[2]) for r in rows], np.array([r[1] for r in rows]), counts[1] / (counts[0] + counts[1]))


class Scorer:
    """Scores texts with a network, keeping the projected inputs of words it has met."""

    def __init__(self, network: Network):
        self.network = network
        self.rows: dict[str, int] = {}
        self.inputs = np.zeros((KEPT_WORDS + 1, 6 * HIDDEN), np.float32)  # the last row pads

    def ids(self, tokens: list[str]) -> np.ndarray:
        ids = np.fromiter((self.rows.get(t, -1) for t in tokens), np.int64, len(tokens))
        new = list(dict.fromkeys(tokens[i] for i in np.flatnonzero(ids < 0).tolist()))
        if new:
            if len(self.rows) + len(new) > KEPT_WORDS:
                self.rows.clear()
                new = list(dict.fromkeys(tokens))
                ids[:] = -1
            at = len(self.rows)
            self.inputs[at : at + len(new)] = self.network.project(list(map(normal, new)))
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            missing = np.flatnonzero(ids < 0)
            ids[missing] = [self.rows[tokens[i]] for i in missing.tolist()]
        return ids

    def logits(self, tokens: list[str], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of windows that start at `starts` among the tokens and have `sizes` words."""
        out = np.empty(len(starts), np.float32)
        ids = np.concatenate([self.ids(tokens), np.full(WINDOW, KEPT_WORDS)])
        for padded in (False, True):
            own = np.flatnonzero((sizes < WINDOW) == padded)
            for at in range(0, len(own), BLOCK):
                some = own[at : at + BLOCK]
                place = starts[some] + np.arange(WINDOW)[:, None]
                mask = np.arange(WINDOW)[:, None] < sizes[some] if padded else None
                out[some] = self.network.logits(np.where(mask, ids[place], KEPT_WORDS) if padded else ids[place], self.inputs, mask)[0]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        for chunk in self._chunks(texts):
            tokens: list[str] = []
            starts, sizes, owner = [], [], []
            for i, words in chunk:
                at = starts_of(len(words))
                starts += [len(tokens) + a for a in at]
                sizes += [min(WINDOW, len(words))] * len(at)
                owner += [i] * len(at)
                tokens += words
            np.maximum.at(best, owner, self.logits(tokens, np.array(starts), np.array(sizes)))
        return self.network.score(best)

    @staticmethod
    def _chunks(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """Texts, together up to KEPT_WORDS / 4 words; a longer one comes in overlapping parts, each window in one of them."""
        most = KEPT_WORDS // 4 // STRIDE * STRIDE
        chunk, n = [], 0
        for i, text in enumerate(texts):
            words = tokens_of(text)
            parts = [words] if len(words) <= most else [words[a : a + most + WINDOW] for a in range(0, len(words) - WINDOW, most)]
            for part in parts:
                if n + len(part) > most and chunk:
                    yield chunk
                    chunk, n = [], 0
                chunk.append((i, part))
                n += len(part)
        if chunk:
            yield chunk


_SCORERS: dict[int, Scorer] = {}


def _scorer(network: Network, name: int) -> Scorer:
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(network)
    return _SCORERS[name]


def score(df: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from THRESHOLD on).

    Null and empty texts are scored as one window without words; without a network every score is 0.
    Texts are scored whole, repeated rows each; other columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(network)
    name = zlib.crc32(network.states.tobytes() + network.inputs.tobytes()) if network else 0
    kind = df.schema[key].dataType.simpleString()

    def run(x: dict) -> dict:
        found = np.zeros(len(x["text"])) if sent.value is None else _scorer(sent.value, name).scores(x["text"])
        return {"doc_id": x["doc_id"], "score": found.astype(np.float64), "predicted": (found >= THRESHOLD).astype(np.int32)}

    return map_columns(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
