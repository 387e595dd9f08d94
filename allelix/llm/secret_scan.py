"""Secrets in texts: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, without

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Maximal runs, of which only those long enough count, so the shortest length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Where a window of `window` characters of the class has at least so many bits a character, it is a secret."""

    kind: str
    pattern: str
    window: int
    bits: float


#: Random hexadecimal digits have 3.1 bits on average in 20 characters, random base64 characters 4.1; words stay well below.
CLASSES = (CharClass("entropy_hex", "0-9a-fA-F", 20, 2.9), CharClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.8))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class AllowList:
    """What isn't a secret though it looks random: patterns of candidates, or of what is left of them."""

    #: What one of these fits in full isn't scanned.
    whole: tuple[str, ...] = ()
    #: Nor what one of these fits in full, if it is made of words and numbers (see `wordy`).
    worded: tuple[str, ...] = ()
    #: What these match is cut out of a candidate; what stands beside it is scanned.
    parts: tuple[str, ...] = ()


ALLOWED = AllowList(
    whole=(
        r"[0-9+=/_-]+",  # numbers, dates, rules
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUIDs
        r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYz?EXAMPLEKEY",  # the key of a vendor's manuals
    ),
    worded=(
        r"[A-Za-z]+(?:[-_/=+][A-Za-z]*)*",  # words, also joined ones
        r"[A-Za-z0-9_-]*(?:/(?:[A-Za-z0-9_-]{1,19}|[A-Za-z0-9]{1,19}(?:[-_][A-Za-z0-9]{1,19})+)){2,}/?",  # paths of short names, and of longer ones of short words
    ),
    parts=(
        # checksums under their names, in hexadecimal or base64 of just their length
        *(rf"\A{name}[-_=](?:[0-9a-fA-F]{{{bits // 4}}}|[A-Za-z0-9+/_-]{{{-(-bits // 6)}}}={{0,2}})(?![A-Za-z0-9+_=-])" for name, bits in (("md5", 128), ("sha1", 160), ("sha256", 256), ("sha384", 384), ("sha512", 512))),
        r"(?<![A-Za-z0-9])(?:EXAMPLE|example)(?![A-Za-z0-9])|0123456789|abcdefghij|ABCDEFGHIJ",  # placeholders; within a key, a word may be part of it
    ),
)
#: A word or a number. Twenty random base64 characters touch 11 of these on average, names and paths at most 7.
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
MOST_PIECES, PIECES_WITHIN = 7, 20

_TERM = [0.0, *(c * log2(c) for c in range(1, 257))]


def random_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose Shannon entropy reaches `bits`; counts move by one character a step."""
    counts: dict[str, int] = {}
    weight, spans = 0.0, []  # weight: the sum of c log2 c over the window's counts c
    for at, char in enumerate(text):
        c = counts.get(char, 0)
        weight += _TERM[c + 1] - _TERM[c]
        counts[char] = c + 1
        if at >= window:
            gone = text[at - window]
            c = counts[gone]
            weight += _TERM[c - 1] - _TERM[c]
            counts[gone] = c - 1
        if at >= window - 1 and log2(window) - weight / window >= bits - 1e-9:
            begin = at - window + 1
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([begin, at + 1])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def wordy(text: str) -> bool:
    """Whether no PIECES_WITHIN characters on end touch more than MOST_PIECES words and numbers."""
    pieces = [m.span() for m in PIECE.finditer(text)]
    return all(begin - end > PIECES_WITHIN - 2 for (_, end), (begin, _) in zip(pieces, pieces[MOST_PIECES:], strict=False))


def scanned_parts(candidate: str, allowed: AllowList) -> Iterator[tuple[int, str]]:
    """Where what the allow-list leaves of a candidate begins, and what it is."""

    def suppressed(part: str) -> bool:
        return any(compiled(p).fullmatch(part) for p in allowed.whole) or (any(compiled(p).fullmatch(part) for p in allowed.worded) and wordy(part))

    if suppressed(candidate):
        return
    cuts = [m.span() for m in compiled("|".join(f"(?:{p})" for p in allowed.parts)).finditer(candidate)] if allowed.parts else []
    begin = 0
    for a, b in [*cuts, (len(candidate), len(candidate))]:
        part = candidate[begin:a]
        if part and not (cuts and suppressed(part)):
            yield begin, part
        begin = b


def entropy_spans(text: str, classes: tuple[CharClass, ...] = CLASSES, allowed: AllowList = ALLOWED) -> list[tuple[int, int, str]]:
    """Random-looking stretches of each class in what the allow-list leaves of the candidates."""
    runs, found = [(c, compiled(f"[{c.pattern}]{{{c.window},}}")) for c in classes], []
    for m in CANDIDATE.finditer(text):
        for at, part in scanned_parts(m[0], allowed):
            for c, run in runs:
                for r in run.finditer(part):
                    # a hexadecimal run must mix digits and letters, a base64 run two kinds of characters
                    kinds = sum(bool(compiled(k).search(r[0])) for k in ("[a-z]", "[A-Z]", "[0-9]"))
                    if kinds >= 2:
                        begin = m.start() + at + r.start()
                        found += [(begin + a, begin + b, c.kind) for a, b in random_windows(r[0], c.window, c.bits)]
    return found


_compiled: dict[str, re.Pattern] = {}


def compiled(pattern: str) -> re.Pattern:
    if pattern not in _compiled:
        _compiled[pattern] = re.compile(pattern, re.DOTALL)
    return _compiled[pattern]


def ordered(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each stretch that spans cover, overlapping ones together, replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: AllowList = ALLOWED, mask: str = "[SECRET]") -> DataFrame:
    """Every row of df with n_assign, n_access, n_hex, base_sha256, spans and redacted.

    spans lists kind:start:end by start, then kind (assign, access, hex, the classes), in code points, end exclusive: the
    base patterns' matches and the random stretches; a word of the allow-list doesn't hide what is joined to it. base_sha256 is the digest of the base matches' list. redacted is
    the text with all spans masked, equal to the text if there are none. Null texts count as empty. Rows are judged
    one by one, repeated ones alike, texts of any length whole; an empty table gives no rows; columns of df that clash with an output are replaced.
    """
    kinds = BASE_KINDS + tuple(c.kind for c in classes)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base = ordered(base_spans(t), kinds)
                every = ordered(base + entropy_spans(t, classes, allowed), kinds)
                n = [sum(s[2] == k for s in base) for k in BASE_KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redact(t, every, mask) if every else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])
        give_back()

    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
    rest = without(df, own)
    found = df.select(*[F.col(c) for c in rest], F.col(text).alias("_text"), scanned(F.coalesce(text, F.lit(""))).alias("_found"))
    return found.select(*rest, *[f"_found.{c}" for c in own[:-1]], F.coalesce("_found.redacted", "_text").alias("redacted"))
