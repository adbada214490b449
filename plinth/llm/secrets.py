"""Secret scans: fixed patterns, and random strings exposed by how badly a tokenizer packs them."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: A run of fewer characters a token than this is random. Prose and names pack at 2.5 and more, random base64 at about 1.6.
CHARS_A_TOKEN = 2.1
#: Runs shorter than this carry too few tokens for a ratio.
LEAST_RUN = 20

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Matches of [0-9a-f]+ are whole runs, so those of 24 and more can be asked for at once.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
# What is random or badly packed and yet no secret: digests of the usual lengths, UUIDs and numbers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9TZ+/_=-]++)"
)
# The shape of names: pieces of letters of one case, joined. The signs that join short words cost tokens, so a run of this shape is a name if its pieces are words by themselves.
# (Possessive quantifiers: a run has one way to be cut into pieces, so a long one can't be tried in many.)
NAME = re.compile(r"[+/_=-]*+(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+(?:[+/_=-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)[0-9]{0,4}+)*+[+/_=-]*+")
LETTERS = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=2)
def vocabulary(file: str):
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(run: str, encoding) -> int:
    return len(encoding.encode_ordinary(run))


def is_name(run: str, encoding, least_ratio: float = CHARS_A_TOKEN) -> bool:
    """Whether a run is made of pieces that are each one token or pack well, and that pack well together."""
    if not NAME.fullmatch(run):
        return False
    letters = tokens = 0
    for piece in LETTERS.findall(run):
        own = _tokens(piece, encoding)
        if own > 1 and len(piece) < least_ratio * own:
            return False
        letters, tokens = letters + len(piece), tokens + own
    return letters >= least_ratio * tokens


def is_random(run: str, encoding, least_ratio: float = CHARS_A_TOKEN) -> bool:
    """Whether a run packs into few characters a token and is no known digest, number or name."""
    return not KNOWN.fullmatch(run) and len(run) < least_ratio * _tokens(run, encoding) and not is_name(run, encoding, least_ratio)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def added_spans(text: str, base: list[tuple[int, int, str]], encoding) -> list[tuple[int, int, str]]:
    """Random runs outside all base spans."""
    spans = sorted(base)
    starts, reach = [a for a, _, _ in spans], [-1, *accumulate((b for _, b, _ in spans), max)]  # how far the first k spans reach
    out = []
    for m in RUN.finditer(text):
        if reach[bisect_left(starts, m.end())] <= m.start() and is_random(m.group(), encoding):
            out.append((m.start(), m.end(), "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _file(file: str | None) -> str:
    if file:
        return file
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """Secrets of whole texts.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points,
    end exclusive). Null and empty texts have none; repeated rows are scanned each; other columns
    are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(x: dict) -> dict:
        encoding = vocabulary(_file(file))
        out: dict[str, list] = {"doc_id": x["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for t in x["text"]:
            base = base_spans(t or "")
            for name in KINDS[:3]:
                out[f"n_{name}"].append(sum(k == name for _, _, k in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added_spans(t or "", base, encoding)))
        return out

    return map_columns(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, at, end = [], 0, -1
    for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if a >= end:
            out += [text[at:a], f"<{kind}>"]
            end = b
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", length: str | None = None, file: str | None = None) -> DataFrame:
    """`df` with its secrets masked in `text`, and the column `length` (if given) set to the new number of characters where the text has changed. Null texts stay null; all rows and columns stay."""
    columns = df.columns

    def run(x: dict) -> dict:
        encoding = vocabulary(_file(file))
        for i, t in enumerate(x[text]):
            if t and (spans := (base := base_spans(t)) + added_spans(t, base, encoding)):
                x[text][i] = redacted(t, spans)
                if length:
                    x[length][i] = len(x[text][i])
        return {c: x[c] for c in columns}

    return map_columns(df, run, df.schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
