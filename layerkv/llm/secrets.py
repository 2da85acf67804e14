"""Spans of texts that look like secrets: fixed patterns, and strings a tokenizer finds inefficient.

The patterns are assignments to telling names, access key ids and long hexadecimal runs. Beyond
them, a run of letters, digits and symbols that keys are made of is random if a byte-pair vocabulary made
from text needs many tokens for it, that is if it has few characters for each token. Symbols at its ends
are left off first. Before the test, digests of the usual lengths, UUIDs and what is put together of short
parts (paths, dates, names in pieces) are excluded; words, names and numbers aren't, the vocabulary knows them.

Defined results
- A null text is empty; an empty text has no spans. Repeated rows are scanned each for itself.
- Spans are in code points, end exclusive. Matches of one pattern never overlap; an assignment and
  the hexadecimal run in it are two spans. A random run that lies in a pattern's span isn't repeated.
- Input columns named like the results are left out; an empty table gives an empty result.
- Whole texts are scanned. Runs are tokenized in pieces of a bounded length, so the time for a run
  grows with its length only.
- The tokenizer's ranks are read by the driver, from the path given, and sent to the executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from layerkv.llm.common import col, map_arrow, others

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: Least length of a pattern's secret; the assignment's is that of its value.
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}
#: A run with fewer characters for each token than this is random. Chosen on generated strings alone: nine in
#: ten strings of 24 random lower-case letters are below it, and nearly all of mixed letters and digits.
MOST_CHARS_PER_TOKEN = 1.9
PIECE = 256

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
NAMES = ("passw", "secret", "token", "api")  # one of them is in every assignment
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_!$%^*~#-]{16,}")
SYMBOLS = "+/_!$%^*~#-"  # of a run, not letters or digits
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PART = re.compile(r"[/_-]+")
LEAST_PART = 6


@lru_cache(2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def chars_per_token(run: str, tokens: tiktoken.Encoding) -> float:
    return len(run) / sum(len(tokens.encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def known(run: str) -> bool:
    """Digests, identifiers of a fixed form and runs of short parts, which are no secrets however they tokenize."""
    parts = PART.split(run)
    return len(run) < LEAST_PART * len(parts) or len(run) in DIGEST_LENGTHS and bool(DIGEST.fullmatch(run)) or bool(UUID.fullmatch(run))


class Cover:
    """Whether one of the spans covers a run; runs must be asked for in order of their starts."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.at, self.reach = sorted(spans), 0, -1

    def holds(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] <= start:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return end <= self.reach


def random_spans(text: str, base: list[tuple[int, int, str]], tokens: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    found, patterns = [], Cover([(a, b) for a, b, _ in base])
    for m in RUN.finditer(text):
        run = m[0].strip(SYMBOLS)
        start = m.start() + m[0].find(run)
        end = start + len(run)
        if len(run) >= LEAST["random"] and not patterns.holds(start, end) and not known(run) and chars_per_token(run, tokens) < MOST_CHARS_PER_TOKEN:
            found.append((start, end, "random"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(text: str, tokens: tiktoken.Encoding) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those the tokenizer adds."""
    base = base_spans(text)
    return base, random_spans(text, base, tokens)


def scan(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``df`` with counts, digest and spans in place of the text."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    rest = others(df, text, *added)
    schema = df.select(*map(col, rest)).schema
    for name, kind in zip(added, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks.value)
        for batch in batches:
            rows = []
            for t in batch.columns[-1]:
                base, more = find(t.as_py() or "", tokens)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            results = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *results], names=schema.names)

    return map_arrow(df.select(*map(col, [*rest, text])), run, schema)


def redact(text: str, tokens: tiktoken.Encoding, mark: str = "[secret]") -> str:
    """The text with every span replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for start, end, _ in sorted(sum(find(text, tokens), [])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
