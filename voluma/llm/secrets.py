"""Secret scan: rules for known shapes, and a token-efficiency test for random strings.

A vocabulary learnt from prose spends few characters per token on random strings.  Runs of key characters whose ratio is low
are reported, with or without digits, unless they are known digests (hexadecimal of a digest's length), UUIDs, or identifiers made of
words.  A digest or UUID counts as known only where the text before it does not name it as a key, token or password.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .tokens import Vocabulary

#: The shapes of the rules. Group 2 of the first is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Runs that may be random: key characters, long enough, no part of a longer one.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
#: Lengths of the hexadecimal forms of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_SIZES = frozenset((32, 40, 56, 64, 96, 128))
#: Parts of an identifier, and what makes one a word: so many letters, and so many characters a token.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]+")
LEAST_WORD, WORD_RATIO = 4, 3
#: Text right before a run that makes it a secret whatever its form, and how far back it is looked for.
NAMED_SECRET = re.compile(r"(?:passw(?:or)?d|passwd|secret|token|key|auth|credentials?|bearer)[\"'\s:=(<]{1,8}\Z", re.IGNORECASE)
BEFORE = 24
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' matches, leftmost and non-overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_word(part: str, vocabulary: Vocabulary) -> bool:
    """Few long tokens, in lower case and at the start or in the middle of a text."""
    part = part.lower()
    return len(part) >= LEAST_WORD and any(len(part) >= WORD_RATIO * len(vocabulary.encode(s + part)) for s in ("", " "))


def is_known(run: str, vocabulary: Vocabulary, before: str = "") -> bool:
    """A digest or a UUID that ``before`` does not name as a secret, or an identifier or path of which words make up three quarters."""
    if UUID.fullmatch(run) or DIGEST.fullmatch(run) and len(run) in DIGEST_SIZES:
        return not NAMED_SECRET.search(before)
    return sum(len(m[0]) for m in PART.finditer(run) if is_word(m[0], vocabulary)) >= 0.75 * len(run)


def random_spans(text: str, vocabulary: Vocabulary, least_ratio: float) -> list[tuple[int, int, str]]:
    """Runs with fewer characters a token than ``least_ratio``."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) < least_ratio * len(vocabulary.encode(run)) and not is_known(run, vocabulary, text[max(0, m.start() - BEFORE) : m.start()]):
            out.append((m.start(), m.end(), "random"))
    return out


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in in_order(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"


def _scanner(path: str, least_ratio: float, mark: str, redact: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(path)
        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text)
                every = base + random_spans(text, vocabulary, least_ratio)
                counts = [sum(s[2] == kind for s in every) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), redacted(text, every, mark) if redact else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return F.pandas_udf(run, SCHEMA)


def scan_secrets(docs: DataFrame, vocabulary_path: str, least_ratio: float = 2.0, text_col: str = "text", into: str = "secrets", mark: str = "[secret]", redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with one more column ``into``: n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted.

    Spans are kind:start:end in code points, by start and then kind, comma-joined.  Null text is empty text (redacted is then
    empty too); without ``redact`` that field is null.  Rows are independent: repeated rows and ties give equal results, and
    an empty table gives none.  A column already named ``into`` is replaced.
    """
    return docs.withColumn(into, _scanner(vocabulary_path, least_ratio, mark, redact)(F.coalesce(F.col(text_col), F.lit(""))))


def redact_secrets(docs: DataFrame, vocabulary_path: str, least_ratio: float = 2.0, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets of non-null texts replaced by ``mark``."""
    into = fresh("_secrets", docs.columns)
    found = scan_secrets(docs, vocabulary_path, least_ratio, text_col, into, mark, redact=True)
    text = F.when(F.col(text_col).isNotNull(), F.col(f"{into}.redacted"))
    return found.withColumn(text_col, text).select(*docs.columns)
