"""Scalar text functions as built-in Column expressions.

Everything here compiles to JVM expressions (regex, higher-order array
functions), so it stays inside whole-stage code generation: no Python runs
per row.  Patterns are passed with ``F.lit`` (not inside ``F.expr``) so they
are not escaped twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed patterns (Java and RE2 syntax alike; the oracle SQL uses them as is).
# Whitespace as Python's str.isspace() sees it.
WS = ("\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
# One emoji: a flag pair, a keycap, or a pictograph with modifiers and
# zero-width-joiner continuations.
EMOJI_RE = ("[\\x{1F1E6}-\\x{1F1FF}]{2}"
            "|[0-9#*]\\x{FE0F}?\\x{20E3}"
            "|[\\x{2190}-\\x{21FF}\\x{2300}-\\x{23FF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}]"
            "[\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}]*"
            "(?:\\x{200D}[\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1FAFF}][\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}]*)*")
# A token: an emoji, a word (letters, marks, digits, _ and @, with inner
# apostrophes and hyphens), an ellipsis, one punctuation mark, or one other
# non-space symbol.
TOKEN_RE = (f"{EMOJI_RE}"
            "|[\\p{L}\\p{M}\\p{N}_@][\\p{L}\\p{M}\\p{N}_@'’-]*"
            "|\\.{2,}"
            "|\\p{P}"
            f"|[^{WS}\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}]")
PUNCT_TOKEN_RE = "^\\p{P}+$"
EMOJI_TOKEN_RE = f"^(?:{EMOJI_RE})$"
# Upper-case token (Python str.isupper): some upper-case letter and no
# lower-case or title-case letter.
UPPER_RE = "\\p{IsUppercase}"
NOT_UPPER_RE = "[\\p{IsLowercase}\\p{Lt}]"
WORD_SPLIT_RE = f"[{WS}]+"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """H0: ARRAY<STRING> of tokens."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), F.lit(0))


def _as_int(b: Column) -> Column:
    return b.cast("int")


def punct_count(tokens) -> Column:
    """H1: tokens made only of punctuation."""
    return count_whole_tokens(spaced_tokens(tokens), PUNCT_TOKEN)


def contains_exclamation(tokens) -> Column:
    """H2: some token is exactly '!'."""
    return _as_int(F.array_contains(_c(tokens), "!"))


def contains_punct_mark(tokens) -> Column:
    """H3: some token is exactly '.' (an ellipsis is one token, so no hit)."""
    return _as_int(F.array_contains(_c(tokens), "."))


def contains_question_mark(tokens) -> Column:
    """H4: some token is exactly '?'."""
    return _as_int(F.array_contains(_c(tokens), "?"))


def contains_hashtag(text) -> Column:
    """H5: some token contains '#'; every '#' lands in a token, so test the text."""
    return _as_int(F.coalesce(_c(text).contains("#"), F.lit(False)))


def contains_mention(text) -> Column:
    """H6: some token contains '@'."""
    return _as_int(F.coalesce(_c(text).contains("@"), F.lit(False)))


def capital_token_count(tokens) -> Column:
    """H7: tokens that are upper case (counts tokens, not characters)."""
    return count_whole_tokens(spaced_tokens(tokens), UPPER_TOKEN)


def token_count(tokens) -> Column:
    """H8."""
    return F.size(_c(tokens))


def char_length(text) -> Column:
    """H9: length in code points."""
    return F.coalesce(F.char_length(_c(text)), F.lit(0))


def emoji_count(tokens) -> Column:
    """Emoji tokens (a flag, keycap or joined sequence is one token)."""
    return count_whole_tokens(spaced_tokens(tokens), EMOJI_RE)


def contains_emoji(tokens) -> Column:
    """H11."""
    return _as_int(emoji_count(tokens) > 0)


def lowercase(text) -> Column:
    """H13."""
    return F.lower(_c(text))


def drop_punct_tokens(tokens) -> Column:
    """Tokens that are not all punctuation (used by H14)."""
    return F.filter(_c(tokens), lambda t: ~t.rlike(PUNCT_TOKEN_RE))


def spaced_tokens(tokens) -> Column:
    """' t1 t2 ... tn': every token preceded by one space (tokens never contain one)."""
    return F.concat(F.lit(" "), F.array_join(_c(tokens), " "))


def count_whole_tokens(spaced, token_re: str) -> Column:
    """Number of tokens of a ``spaced_tokens`` string that match ``token_re`` whole.

    One regex pass over the string instead of a test per token: a match
    must start after a space and end before a space or the end.
    """
    return F.size(F.regexp_extract_all(_c(spaced), F.lit(f"(?<= )(?:{token_re})(?= |\\z)"), F.lit(0)))


# Whole-token forms of H1, H7 and H10 for ``count_whole_tokens``.
PUNCT_TOKEN = "\\p{P}+"
UPPER_TOKEN = "[^ \\p{IsLowercase}\\p{Lt}]*\\p{IsUppercase}[^ \\p{IsLowercase}\\p{Lt}]*"


def join_without_punct(tokens) -> Column:
    """Tokens that are not all punctuation, joined by one space (H14 without lemmas).

    One regex pass instead of a per-token test: tokens never contain a
    space, so in ' t1 t2 ... tn' the pattern ' <punct>+' followed by a space
    or the end matches exactly the all-punctuation tokens, each with the
    space before it.  The leading space is dropped afterwards.
    """
    spaced = F.concat(F.lit(" "), F.array_join(_c(tokens), " "))
    return F.substr(F.regexp_replace(spaced, F.lit(" \\p{P}+(?= |\\z)"), F.lit("")), F.lit(2))


def words(text) -> Column:
    """Whitespace-separated words (no empty strings)."""
    return F.filter(F.split(_c(text), WORD_SPLIT_RE), lambda w: F.length(w) > 0)


def argmax(scores) -> Column:
    """index of the first maximum of a numeric array (0-based); NULL for empty."""
    a = _c(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
