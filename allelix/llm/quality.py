"""Line-first quality rules: lines that fail go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, without

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Parameters. A line fails by its first rule that holds; a document fails if too little of its word text stays."""

    #: Navigation: so many separators, at one for so many words at least.
    separators: int = 3
    words_per_separator: int = 4
    #: Boilerplate: share of the words that hold a symbol or a repeated mark, and of the letters in upper case (in lines of some words).
    symbol_share: float = 0.3
    upper_share: float = 0.7
    upper_words: int = 4
    #: A boilerplate phrase fails a line of at most so many words; of a longer one, its sentence of at most so many goes.
    phrase_line_words: int = 30
    phrase_sentence_words: int = 60
    #: Punctuation: a line of so many words needs an end mark, at its end or after a sentence within; of over long_words, any mark within will do.
    open_words: int = 12
    long_words: int = 60
    #: Documents lose at most so much of their words' characters.
    most_lost: float = 0.4


SEPARATOR = re.compile(r"[|»›•·]| > | - (?=\S+ - )")
MARK = re.compile(r"[#*$%&<>]|!!|\?\?")
END = re.compile(r"""[.!?…:;。！？]["'”’»)\]]*\s*$""")
SENTENCE_END = re.compile(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=[。！？])""")
INNER = re.compile(r"[.!?,;:…]")
SENTENCE = re.compile(r"""[.!?…:;]["'”’»)\]]*\s|[。！？]""")
#: Fixed phrases of licences, notices and site furniture, in English, French, German and Spanish. Firm ones are boilerplate anywhere.
FIRM = (
    r"all rights reserved|lorem ipsum|released under the .{1,40} licen[sc]e|licen[sc]ed under (?:the|an?)(?=.{0,60}(?:licen[sc]e|gpl|creative commons)|\s*$)|(?:site|website|page|app) uses cookies|"
    r"tous droits r[ée]serv[ée]s|sous licence(?=\s+(?:libre|ouverte|publique|creative|cc|mit|gnu|gpl|apache|bsd)\b|\s*$)|alle rechte vorbehalten|lizenziert unter|"
    r"todos los derechos reservados|bajo (?:la )?licencia(?=\s+(?:libre|p[úu]blica|abierta|creative|cc|mit|gnu|gpl|apache|bsd)\b|\s*$)"
)
#: Of these, prose may speak: they are boilerplate at the begin of a line, and where they are a third of its words.
TOPIC = (
    r"terms of (?:use|service)|privacy policy|cookie policy|uses cookies|accept (?:all )?cookies|enable javascript|click here|licen[sc]ed under the|"
    r"conditions (?:g[ée]n[ée]rales )?d['’]utilisation|politique de (?:confidentialit[ée]|cookies)|mentions l[ée]gales|accepter (?:tous )?les cookies|sous licence|cliquez ici|"
    r"nutzungsbedingungen|datenschutzerkl[äa]rung|cookie-richtlinie|cookies akzeptieren|hier klicken|klicken sie hier|newsletter abonnieren|auf facebook teilen|"
    r"(?:t[ée]rminos|condiciones) de (?:uso|servicio)|pol[íi]tica de (?:privacidad|cookies)|aviso legal|aceptar (?:todas )?las cookies|bajo (?:la )?licencia|haga clic aqu[íi]|haz clic aqu[íi]"
)
#: Calls to the reader, at the begin of a line or sentence.
CALL = (
    r"sign up for|subscribe to our|share (?:this (?:page|article|post|story|link|video|site)|on(?=\s+(?:facebook|twitter|x|linkedin|whatsapp|reddit|pinterest|instagram|telegram)\b|\s*$))|inscrivez-vous|abonnez-vous|partager sur|"
    r"jetzt anmelden|reg[íi]strate|suscr[íi]bete|compartir en"
)
BOILERPLATE = re.compile(rf"(?<!\w)(?:(?P<firm>{FIRM})|(?P<topic>{TOPIC})|(?:^\W*|(?<=[.!?:;|•»›]\s)\W{{0,2}})(?P<call>{CALL}))(?!\w)", re.IGNORECASE)
#: So many words of a line for one of a topic's phrase.
WORDS_PER_TOPIC = 3
#: What a match of a pattern holds at least (of BOILERPLATE in lower case), so that most texts needn't be searched by it.
SEPARATOR_PARTS = ("|", "»", "›", "•", "·", " > ", " - ")
MARK_PARTS = ("#", "*", "$", "%", "&", "<", ">", "!!", "??")
BOILERPLATE_PARTS = (
    "rights reserved", "terms of", "policy", "cookies", "javascript", "lorem", "under the", "click here", "sign up", "subscribe to", "share ",
    "droits r", "utilisation", "politique de", "mentions l", "sous licence", "cliquez ici", "inscrivez-vous", "abonnez-vous", "partager sur",
    "rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl", "cookie-richtlinie", "lizenziert unter", "hier klicken", "klicken sie hier", "jetzt anmelden", "newsletter abonnieren", "facebook teilen",
    "derechos reservados", "terminos de", "t\u00e9rminos de", "condiciones de", "politica de", "pol\u00edtica de", "aviso legal", "licencia", "clic aqu", "gistrate", "g\u00edstrate", "scribete", "scr\u00edbete", "compartir en",
)
LOWER = b"abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Hopeful:
    """Which patterns a text can match at all."""

    separator: bool = True
    mark: bool = True
    boilerplate: bool = True


def hopeful(text: str) -> Hopeful:
    lower = text.lower()
    return Hopeful(any(p in text for p in SEPARATOR_PARTS), any(p in text for p in MARK_PARTS), any(p in lower for p in BOILERPLATE_PARTS))


def mostly_upper(line: str, share: float) -> bool:
    """Whether all of a line's cased letters, or over `share` of its letters, are in upper case."""
    raw = line.encode("utf-8", "surrogatepass")
    lower = len(raw) - len(raw.translate(None, LOWER))
    if lower and (1 - share) * (len(line) - lower) <= share * lower:
        return False  # even if all other characters were in upper case
    if not lower and line.upper() == line != line.lower():
        return True
    return sum(map(str.isupper, line)) > share * sum(map(str.isalpha, line))


def is_notice(line: str) -> bool:
    """Whether a line or sentence is boilerplate by its phrases."""
    topics = 0
    for m in BOILERPLATE.finditer(line):
        if m["topic"] is None or not any(map(str.isalnum, line[: m.start()])):
            return True
        topics += len(m["topic"].split())
    return topics > 0 and topics * WORDS_PER_TOPIC >= len(line.split())


def failed_rule(line: str, rules: LineRules, can: Hopeful = Hopeful()) -> str | None:
    """The rule by which a line fails, or None. Lines without words don't fail. can: what the line's text allows."""
    words = line.split()
    if not words:
        return None
    if can.separator:
        separators = len(SEPARATOR.findall(line))
        if separators >= rules.separators and separators * rules.words_per_separator >= len(words):
            return "navigation"
    if can.mark and MARK.search(line) and sum(bool(MARK.search(w)) for w in words) > rules.symbol_share * len(words):
        return "boilerplate"
    if len(words) >= rules.upper_words and mostly_upper(line, rules.upper_share):
        return "boilerplate"
    if can.boilerplate and len(words) <= rules.phrase_line_words and is_notice(line):
        return "boilerplate"
    if len(words) >= rules.open_words and not (INNER if len(words) > rules.long_words else SENTENCE).search(line) and not END.search(line):
        return "punctuation"
    return None


def without_notices(line: str, rules: LineRules) -> str:
    """A line of many words without its sentences that hold a boilerplate phrase; overlong ones stay."""
    if not BOILERPLATE.search(line) or len(line.split()) <= rules.phrase_line_words:
        return line
    ends = [0, *(m.end() for m in SENTENCE_END.finditer(line)), len(line)]
    sentences = [line[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    left = [s for s in sentences if not is_notice(s) or len(s.split()) > rules.phrase_sentence_words]
    return line if len(left) == len(sentences) else "".join(left).rstrip()


def clean_lines(text: str, rules: LineRules) -> tuple[str, int, int]:
    """The text without failed lines and sentences, how many lines these are or stand in, and how many characters of words they hold."""
    lines, can = text.split("\n"), hopeful(text)
    kept, bad, lost = [], 0, 0
    for line in lines:
        left: str | None = line
        if line and failed_rule(line, rules, can) is not None:
            left = None
        elif can.boilerplate:
            left = without_notices(line, rules) or (None if line else line)
        if left is not None:
            kept.append(left)
        if left != line:
            bad += 1
            lost += len("".join(line.split())) - len("".join((left or "").split()))
    return ("\n".join(kept), bad, lost) if bad else (text, 0, 0)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a three-word window that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    last = dict(zip(words, range(n)))  # a word's number is where it stands last
    code = np.fromiter(map(last.__getitem__, words), np.int64, n)
    windows = (code[:-2] * n + code[1:-1]) * n + code[2:] if n < 2_000_000 else None
    if windows is None:  # too many words for one integer: number the pairs first
        pairs = np.unique(code[:-1] * n + code[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + code[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line and (not line.isspace() or line.encode("utf-8", "surrogatepass").split()):
            seen.add(line)
    return n


def judge_quality(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), least_words: int = 50, most_repeated_percent: int = 50) -> DataFrame:
    """Every row of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_bad_lines, kept, cleaned.

    base_failed: fewer than least_words words, or over most_repeated_percent of them in repeated three-word windows.
    kept: not base_failed, and what fails holds at most rules.most_lost of the words' characters. cleaned: the text
    without failed lines, and long lines without their boilerplate sentences; n_bad_lines counts both. Null texts have no words and are rejected. Rows are judged
    one by one, repeated ones alike, texts of any length whole; an empty table gives no rows; columns of df that
    clash with an output are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names) + ", cleaned string")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                words = t.encode("utf-8", "surrogatepass").split()
                chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
                cleaned, bad, lost = clean_lines(t, rules)
                rows.append((len(words), chars, sum(map(t.count, SYMBOLS)), repeated_lines(t), repeated_words(words), bad, lost, cleaned if bad else None))
            yield pd.DataFrame(rows, columns=[*names, "cleaned"])
        give_back()

    once = measured.asNondeterministic()  # else a condition on what comes out measures every text a second time, in workers of its own
    own = [*names[:-1], "base_failed", "kept", "cleaned"]
    rest = without(df, own)
    found = df.select(*rest, F.col(text).alias("_text"), once(F.coalesce(text, F.lit(""))).alias("_m"))
    failed = (F.col("_m.n_words") < least_words) | (100 * F.col("_m.n_repeat_words") > most_repeated_percent * F.col("_m.n_words"))
    kept = ~failed & (F.col("_m.lost_chars") <= rules.most_lost * F.col("_m.word_chars"))
    return found.select(*rest, *[f"_m.{n}" for n in names[:-1]], failed.alias("base_failed"), kept.alias("kept"), F.coalesce("_m.cleaned", "_text").alias("cleaned"))
