"""The tokenizer, normalizer and features of ``text`` (H0-H14) for Arrow batches.

``regexp_extract_all`` copies the whole text for each of its matches, so its
work grows with the square of a text's length; here a text is one pass of
``re``.  The patterns are those of ``text``; their character classes are asked
of the JVM (``classes``), as Python may know another version of Unicode.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T

_ASKED = {"word": "\\p{L}\\p{M}\\p{N}", "punct": "\\p{P}", "upper": T.UPPER_RE, "not_upper": T.NOT_UPPER_RE.strip("[]")}
_known: dict[str, str] = {}


def classes(spark: SparkSession) -> dict[str, str]:
    """The inside of a ``re`` character class for each class of ``_ASKED``, as the JVM's regex engine has it; asked once."""
    if not _known:
        pieces = [("".join(map(chr, range(at, at + 512))),) for at in range(0, 0x110000, 512) if not 0xD800 <= at < 0xE000]
        rows = spark.createDataFrame(pieces, "s string").select(
            *[F.regexp_extract_all("s", F.lit(f"[{c}]+"), F.lit(0)) for c in _ASKED.values()]).collect()
        runs = {name: [r for found in lists for r in found] for name, lists in zip(_ASKED, zip(*rows))}
        _known.update({name: "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in found) for name, found in runs.items()})
    return _known


def _python(pattern: str) -> str:
    r"""``\x{1F600}`` as Python writes it."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{m[1].zfill(8)}", pattern)


#: Classes up to these characters: a text is looked at with the smallest that hold all of it, as ``re`` is slow on long classes.
_UP_TO = (0x7F, 0xFFFF, 0x10FFFF)
_ESCAPED = re.compile(r"\\U(\w{8})-\\U(\w{8})")


def _up_to(inside: str, last: int) -> str:
    """The part of a class up to a character."""
    return "".join(f"\\U{a}-\\U{min(int(b, 16), last):08x}" for a, b in _ESCAPED.findall(inside) if int(a, 16) <= last)


class Tokenizer:
    """``text.tokenize`` and what is made of the tokens."""

    def __init__(self, known: dict[str, str]):
        emoji, self.token = _python(T.EMOJI_RE), []
        for last in _UP_TO:
            word, punct = _up_to(known["word"], last), _up_to(known["punct"], last)
            # Before the emojis, which ASCII has none of: words and marks whose first character begins none.
            first = f"[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f][{word}_@'’-]*|[,;:!?\"()'/&%-]|\\.+" + (f"|{emoji}" if last > 0x7F else "")
            self.token.append(re.compile(f"{first}|[{word}_@][{word}_@'’-]*|[{punct}]|[^{_python(T.WS)}{word}{punct}]"))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.marks = frozenset(chr(c) for a, b in _ESCAPED.findall(known["punct"]) for c in range(int(a, 16), int(b, 16) + 1))
        self.emoji, self.upper, self.not_upper = (re.compile(x) for x in (emoji, f"[{known['upper']}]", f"[{known['not_upper']}]"))

    def tokens(self, text: str) -> list[str]:
        return self.token[0 if text.isascii() else 2 if self.beyond.search(text) else 1].findall(text)

    def normal(self, text: str) -> str:
        """The tokens that are not all punctuation, joined by one space."""
        marks = self.marks
        return " ".join([t for t in self.tokens(text) if t not in marks and (len(t) == 1 or t[0] not in marks or not marks.issuperset(t))])

    def features(self, text: str) -> dict[str, int]:
        """The 11 features."""
        marks, toks = self.marks, self.tokens(text)
        punct = sum(map(marks.__contains__, toks)) + sum(1 for t in toks if len(t) > 1 and t[0] in marks and marks.issuperset(t))
        capital, emoji = sum(map(str.isupper, toks)) if text.isascii() else 0, 0
        if not text.isascii():
            others = [t for t in toks if not t.isascii()]
            capital = sum(1 for t in toks if t.isascii() and t.isupper()) + sum(
                1 for t in others if not "a" <= t[-1] <= "z" and self.upper.search(t) and not self.not_upper.search(t))
            emoji = sum(1 for t in others if t[0] not in _NO_EMOJI and self.emoji.fullmatch(t))
        return {"punct_count": punct, "contains_exclamation": "!" in text, "contains_punct_mark": "." in toks,
                "contains_question_mark": "?" in text, "contains_hashtag": "#" in text, "contains_mention": "@" in text,
                "capital_char_count": capital, "token_count": len(toks), "char_length": len(text), "emoji_count": emoji,
                "contains_emoji": emoji > 0}


#: No emoji begins with one of these.
_NO_EMOJI = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def normalizer(known: dict[str, str]):
    """Of an array of lower-case texts: their normal form."""
    tok = Tokenizer(known)

    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else tok.normal(t) for t in texts.to_pylist()], pa.string())
    return normal


def featurizer(known: dict[str, str], names: list[str]):
    """Of an array of texts: a struct of the named features; a null text has zeros."""
    tok = Tokenizer(known)

    def features(texts: pa.Array) -> pa.Array:
        rows = [[f[n] for n in names] for f in (tok.features(t or "") for t in texts.to_pylist())]
        table = np.array(rows, dtype=np.int32).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in table.T], list(names))
    return features
