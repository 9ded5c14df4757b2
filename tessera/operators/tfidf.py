"""Character n-gram TF-IDF.

Semantics (character n-grams inside word boundaries, smooth IDF, L2 rows):
* each whitespace-separated word is padded with one space on both sides and
  all n-grams (n = min_n..max_n) are taken inside the padded word;
* idf(t) = ln((1 + n_docs) / (1 + df(t))) + 1, fitted on train documents;
* weight = count * idf, each document's weights scaled to unit L2 norm;
  terms unseen in train are dropped.

Plan: n-grams of one and two characters are counted in Arrow batches, as code
points (a row for every n-gram *occurrence* cost 102 task seconds at sf0.1).
What is shuffled is the text, once, on ``sentence_id``: the rows of one id are
then neighbours, so its counts, its norm and its weights are worked out where
the text lies and no row per n-gram is ever moved or sorted.  Document
frequencies leave each batch as one row a term.  The IDF table is handed to the
tasks only after its size is checked; beyond the bound, and for longer n-grams
(column expression ``char_wb_grams``), counts are rows, the norm is a window and
the IDF meets them in a shuffle join where AQE splits the hot terms.  Nothing is
cached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, words
from ..session import bound_arrow_batches
from .joins import DEFAULT_BROADCAST_ROWS, is_bounded, join_small
from .partitioning import cluster_by_id


def _grams_of_padded(pw: Column, n: int) -> Column:
    """All n-grams of one padded word, as an array (code-point based)."""
    if n == 1:
        return F.regexp_extract_all(pw, F.lit("(?s)."), F.lit(0))
    # Not from the middle of a character beyond 16 bits, which the regex engine keeps as two units.
    return F.regexp_extract_all(pw, F.lit("(?s)(?![\\x{DC00}-\\x{DFFF}])(?=(" + "." * n + "))"), F.lit(1))


def char_wb_grams(text: Column, min_n: int = 1, max_n: int = 2) -> Column:
    """ARRAY<STRING> of all char n-grams of a text, word-bounded.

    For n <= 2 the whole text is scanned twice instead of every word: words
    are padded by rewriting the text as ' w1  w2 ... wk ' (one space each
    side, two between words).  Its characters are exactly the unigrams of
    the padded words, and its character pairs are their bigrams plus one
    '  ' pair between neighbouring words, which no padded word contains and
    which is removed.  Larger n falls back to one pass per word.
    """
    if max_n > 2:
        def per_word(w):
            pw = F.concat(F.lit(" "), w, F.lit(" "))
            # A padded word shorter than min_n counts once, as a whole.
            short = F.when(F.length(pw) < min_n, F.array(pw)).otherwise(F.array().cast("array<string>"))
            return F.concat(short, *[_grams_of_padded(pw, n) for n in range(min_n, max_n + 1)])
        return F.flatten(F.transform(words(text), per_word))
    padded, full = _padded(text)
    parts = []
    if min_n <= 1:
        parts.append(_grams_of_padded(padded, 1))
    if max_n >= 2:
        parts.append(F.filter(_grams_of_padded(padded, 2), lambda g: g != F.lit("  ")))
    grams = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.when(full, grams).otherwise(F.array().cast("array<string>"))


# Code points take 21 bits; a bigram is its first code point + 1 above its second.
_POINT = 21
_CHARS = 1 << 18  # characters that are counted at a time


def _gram_codes(points: np.ndarray, min_n: int, max_n: int) -> np.ndarray:
    """The n-grams of a padded text (' w1  w2 ') as numbers: all characters, all pairs but the two blanks between words."""
    parts = [points] if min_n <= 1 else []
    if max_n >= 2:
        a, b = points[:-1], points[1:]
        parts.append((((a + 1) << _POINT) | b)[(a != 32) | (b != 32)])
    return np.concatenate(parts)


def _text_grams(text: str, min_n: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a padded text and their counts; a long text is counted in pieces that share one character."""
    found = []
    for at in range(0, max(len(text), 1), _CHARS):
        piece = np.frombuffer(text[at:at + _CHARS + 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes = _gram_codes(piece, min_n, max_n)
        if len(text) > at + _CHARS and min_n <= 1:  # the shared character belongs to the next piece
            codes = np.delete(codes, _CHARS)
        found.append(np.unique(codes, return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def _as_text(codes: np.ndarray) -> pa.Array:
    """The n-grams of numbers."""
    known, where = np.unique(codes, return_inverse=True)
    names = [(chr((c >> _POINT) - 1) if c >> _POINT else "") + chr(c & ((1 << _POINT) - 1)) for c in known.tolist()]
    return pa.DictionaryArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())


def _padded(text: Column) -> tuple[Column, Column]:
    """A text as ' w1  w2 ... wk ' and whether it has words."""
    trimmed = F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")
    return F.concat(F.lit(" "), F.regexp_replace(trimmed, f"[{WS}]+", "  "), F.lit(" ")), F.length(trimmed) > 0


def _words_padded(text: str | None) -> str:
    """As ``_padded``, of one text; empty if it has no words.  ``WS`` are the characters at which ``str.split`` parts."""
    words = (text or "").split()
    return f" {'  '.join(words)} " if words else ""


def starts(cols: list[pa.Array], rows: int) -> np.ndarray:
    """Where a run of equal rows begins; nulls are equal."""
    new = np.zeros(rows, dtype=bool)
    new[:1] = True
    for col in cols:
        new[1:] |= np.diff(col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
    return np.flatnonzero(new)


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``size`` and the place of each key among them; without a sort where a table is no larger than the work."""
    if size > max(4 * len(keys), 1 << 16):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, dtype=bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def _many_grams(texts: list[str], owner: np.ndarray, min_n: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of padded texts; the owners ascend, an owner may have several texts.

    Between two texts stand two blanks, which are no pair.  Pairs of characters
    are numbered among those that occur, and a table of owners by pairs is
    counted up: no sort of all n-grams, unless the table would be mostly empty.
    A character is the first of as many pairs as it occurs,
    as a blank follows the last text.
    """
    points = np.frombuffer("".join([*texts, " "]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letters, at = _places(points, int(points.max()) + 1)
    pairs, which = _places(at[:-1] * len(letters) + at[1:], len(letters) ** 2)
    owner, of = np.unique(owner, return_inverse=True)
    which += np.repeat(of * len(pairs), [len(t) for t in texts])
    if len(owner) * len(pairs) <= 16 * len(which):
        n = np.bincount(which)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys, n = np.unique(which, return_counts=True)
    row, pair = np.divmod(keys, len(pairs))
    first, second = (x[pair] for x in np.divmod(pairs, len(letters)))
    found = []
    if min_n <= 1:
        new = np.flatnonzero(np.diff(row * len(letters) + first, prepend=-1))
        found.append((row[new], letters[first[new]], np.add.reduceat(n, new)))
    if max_n >= 2:
        first, second = letters[first], letters[second]
        real = (first != 32) | (second != 32)
        found.append((row[real], (((first + 1) << _POINT) | second)[real], n[real]))
    row, code, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    return owner[row[order]], code[order], n[order]


def _pieces(begin: int, ends: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring runs (by their ends) of together at most ``most`` characters; a larger run is a piece of its own."""
    total = np.append(0, np.cumsum(size))
    at = before = begin
    for end in ends.tolist():
        if before > at and total[end] - total[at] > most:
            yield at, before
            at = before
        before = end
    if before > at:
        yield at, before


class _Open:
    """The counts of one id whose rows may go on in the next batch, by its other columns."""

    def __init__(self, key: tuple):
        self.key, self.found = key, {}

    def add(self, keep: tuple, codes: np.ndarray, n: np.ndarray) -> None:
        parts = self.found.setdefault(keep, [])
        parts.append((codes, n))
        if sum(len(c) for c, _ in parts) > _CHARS and len(parts) > 1:
            self.found[keep] = [_summed(parts)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _by_id(min_n: int, max_n: int, emit):
    """A function of Arrow batches ``(id, keep..., text)`` whose rows of one id are neighbours, those of equal ``keep`` too.

    ``emit(key columns, which of their rows is each n-gram's, which id, codes, counts)`` makes the output.  An id
    may go on over batches: the last one of a batch is held until the next id comes.
    """
    def closed(held: _Open, types: list[pa.DataType]):
        found = [(keep, *_summed(parts)) for keep, parts in held.found.items()]
        if not sum(len(c) for _, c, _ in found):
            return
        rows = [(*held.key, *keep) for keep, _, _ in found]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        at = np.repeat(np.arange(len(found)), [len(c) for _, c, _ in found])
        yield emit(cols, at, np.zeros(len(at), dtype=np.int64), np.concatenate([c for _, c, _ in found]),
                   np.concatenate([n for _, _, n in found]))

    def count(batches):
        held, types = None, []
        for b in batches:
            if not len(b):
                continue
            keys, texts = b.columns[:-1], list(map(_words_padded, b.column(b.num_columns - 1).to_pylist()))
            types = [c.type for c in keys]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            ids, rows = starts(keys[:1], len(b)), starts(keys, len(b))
            first = np.append(ids, len(b))
            row_run, id_run = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            row_run[rows], id_run[ids] = 1, 1
            row_run, id_run = np.cumsum(row_run) - 1, np.cumsum(id_run) - 1

            def add(i: int, j: int) -> None:
                for r in range(i, j):
                    if texts[r]:
                        held.add(tuple(c[r].as_py() for c in keys[1:]), *_text_grams(texts[r], min_n, max_n))

            # The first id may be the one that is held, the last one may go on.
            begin, end = 0, int(first[-2])
            if held is not None and held.key == (keys[0][0].as_py(),):
                begin = int(first[1])
                add(0, begin)
            if begin < len(b):
                if held is not None:
                    yield from closed(held, types)
                ends = first[(first > begin) & (first <= end)]
                for i, j in _pieces(begin, ends, size, _CHARS):
                    if int(size[i:j].sum()) > _CHARS:  # one id of long texts
                        held = _Open((keys[0][i].as_py(),))
                        add(i, j)
                        yield from closed(held, types)
                    elif size[i:j].any():
                        own, codes, n = _many_grams(texts[i:j], row_run[i:j] - row_run[i], min_n, max_n)
                        at = rows[row_run[i]:row_run[j - 1] + 1]
                        yield emit([c.take(pa.array(at)) for c in keys], own, id_run[at][own] - id_run[i], codes, n)
                held = _Open((keys[0][end].as_py(),))
                add(end, len(b))
        if held is not None:
            yield from closed(held, types)
    return count


def _long(names: list[str], value: str, values=None):
    """``emit`` of one row an n-gram; ``values(id numbers, codes, counts)`` gives a mask (or None) and the values."""
    def emit(cols, at, ids, codes, n):
        if values is not None:
            known, n = values(ids, codes, n)
            at, codes = at[known], codes[known]
        which = pa.array(at)
        return pa.RecordBatch.from_arrays([*[c.take(which) for c in cols], _as_text(codes), pa.array(n)], [*names, "term", value])
    return emit


def _lists(names: list[str], values):
    """``emit`` of one row a key: its n-grams and their values as lists."""
    def emit(cols, at, ids, codes, n):
        known, x = values(ids, codes, n)
        at, codes = at[known], codes[known]
        bounds = pa.array(np.searchsorted(at, np.arange(len(cols[0]) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*cols, pa.ListArray.from_arrays(bounds, _as_text(codes)), pa.ListArray.from_arrays(bounds, pa.array(x))],
            [*names, "terms", "values"])
    return emit


def _weights(table):
    """Unit-length weights of each id from the shared (sorted codes, idf); unseen n-grams have none."""
    def values(ids, codes, n):
        known, idf = table.value
        if not len(known):
            return np.zeros(len(codes), dtype=bool), np.zeros(0)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        seen = known[at] == codes
        w, ids = n[seen] * idf[at[seen]], ids[seen]
        norm = np.sqrt(np.bincount(ids, w * w))
        return seen, w / norm[ids] if len(w) else w
    return values


def gram_codes(terms: list[str]) -> np.ndarray:
    """The numbers of n-grams of one or two characters."""
    return np.array([ord(t) if len(t) == 1 else ((ord(t[0]) + 1) << _POINT) | ord(t[1]) for t in terms], dtype=np.int64)


def counted_texts(col: pa.Array, min_n: int, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, n-gram, count) of a text column, the rows ascending, a piece of about ``_CHARS`` characters at a time."""
    some, own, size = [], [], 0
    for k in range(len(col)):
        t = _words_padded(col[k].as_py())
        if some and size + len(t) > _CHARS:
            yield _many_grams(some, np.array(own), min_n, max_n)
            some, own, size = [], [], 0
        if len(t) > _CHARS:
            codes, n = _text_grams(t, min_n, max_n)
            yield np.full(len(codes), k), codes, n
        elif t:
            some.append(t)
            own.append(k)
            size += len(t)
    if some:
        yield _many_grams(some, np.array(own), min_n, max_n)


def _frequencies(min_n: int, max_n: int):
    """In how many rows each n-gram occurs: one row a term and batch."""
    def count(batches):
        for b in batches:
            found = []
            for _, codes, _ in counted_texts(b.column(0), min_n, max_n):
                found.append(np.unique(codes, return_counts=True))
                if len(found) > 1 and sum(len(c) for c, _ in found) > _CHARS:
                    found = [_summed(found)]
            if found:
                codes, n = _summed(found)
                yield pa.RecordBatch.from_arrays([_as_text(codes), pa.array(n)], ["term", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([len(b)], pa.int64())], ["term", "n"])
    return count


def _texts_by_id(df: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """``(id, keep..., text)``, partitioned by the id and sorted, in Arrow batches of bounded size."""
    bound_arrow_batches(df.sparkSession)
    # The text column is used once: an expression behind it (a tokenizer's regex) is not evaluated again for each use.
    rows = cluster_by_id(df.select(*keep, F.col(text_col).alias("_text")), keep[0])
    return rows.sortWithinPartitions(*keep)


def in_batches(min_n: int, max_n: int) -> bool:
    return 1 <= min_n <= max_n <= 2


def document_frequencies(df: DataFrame, min_n: int = 1, max_n: int = 2, text_col: str = "norm_text") -> DataFrame:
    """``(term, df)``: in how many rows each n-gram occurs; the NULL term counts all rows, texts without words too."""
    if in_batches(min_n, max_n):
        bound_arrow_batches(df.sparkSession)
        found = df.select(F.col(text_col).alias("_text")).mapInArrow(_frequencies(min_n, max_n), "term string, n bigint")
        return found.groupBy("term").agg(F.sum("n").alias("df"))
    grams = F.array_distinct(char_wb_grams(F.col(text_col), min_n, max_n))
    # Each document adds its distinct n-grams and one NULL marker, whose count is the number of documents.
    marked = F.concat(F.coalesce(grams, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    return df.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def counted_frequencies(df: DataFrame, grams_col: str = "grams") -> DataFrame:
    """As ``document_frequencies``, of rows whose n-grams are counted: a struct with a list ``codes`` of distinct n-grams."""
    def count(batches):
        for b in batches:
            codes, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([_as_text(codes), pa.array(n)], ["term", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([len(b)], pa.int64())], ["term", "n"])
    found = df.select(F.col(grams_col)["codes"].alias("_codes")).mapInArrow(count, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("df"))


def char_ngrams(df: DataFrame, min_n: int = 1, max_n: int = 2, text_col: str = "norm_text",
                id_col: str = "sentence_id") -> DataFrame:
    """One row per n-gram occurrence: ``(id, term)``."""
    return df.select(id_col, F.explode(char_wb_grams(F.col(text_col), min_n, max_n)).alias("term"))


def term_counts(df: DataFrame, min_n: int = 1, max_n: int = 2, text_col: str = "norm_text",
                id_col: str = "sentence_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keep..., term, tf)`` raw counts per document.

    The rows of one id are brought together as texts and counted there, so no
    row per n-gram is shuffled, sorted or aggregated.
    """
    keys = (id_col, *keep)
    if not in_batches(min_n, max_n):
        grams = cluster_by_id(df.select(*keys, F.explode(char_wb_grams(F.col(text_col), min_n, max_n)).alias("term")), id_col)
        return grams.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = _texts_by_id(df, keys, text_col)
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(_by_id(min_n, max_n, _long(list(keys), "tf")), schema)


def fit_idf(train: DataFrame, min_n: int = 1, max_n: int = 2, text_col: str = "norm_text") -> DataFrame:
    """``(term, df, idf)`` with the smooth formula, from the train documents.

    One pass: the NULL term counts the documents.  The counts (one row per
    term) are written once to the shared checkpoint folder.
    """
    counts = document_frequencies(train, min_n, max_n, text_col).checkpoint(eager=True)
    docs = counts.where(F.col("term").isNull()).first()
    n_docs = float(docs["df"]) if docs else 0.0
    idf = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    return counts.where(F.col("term").isNotNull()).select("term", "df", idf.alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame, id_col: str = "sentence_id",
          max_broadcast_terms: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """tf * idf scaled to unit L2 norm per document (I4).

    Keeps every column of ``tf`` but ``tf`` itself and adds ``weight``.  For
    counts that are a table already; ``weigh`` works on the texts.
    """
    keep = [c for c in tf.columns if c != "tf"]
    x = join_small(tf, idf.select("term", "idf"), "term", "inner", max_rows=max_broadcast_terms)
    x = x.select(*keep, (F.col("tf") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return x.select(*keep, (F.col("_w") / norm).alias("weight"))


def weigh(docs: DataFrame, idf: DataFrame, keep: tuple[str, ...] = (), min_n: int = 1, max_n: int = 2,
          text_col: str = "norm_text", id_col: str = "sentence_id", lists: bool = False,
          max_broadcast_terms: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``(id, keep..., term, weight)`` of every document: ``tfidf`` of ``term_counts``, made where the text lies.

    With ``lists``, one row a document: ``(id, keep..., terms, values)``; a
    document without known n-grams may have no row.  Beyond
    ``max_broadcast_terms`` the counts become rows that meet the IDF in a join.
    """
    keys = (id_col, *keep)
    known = idf.select("term", "idf")
    if not in_batches(min_n, max_n) or not is_bounded(known, max_broadcast_terms):
        long = tfidf(term_counts(docs, min_n, max_n, text_col, id_col, keep), idf, id_col, max_broadcast_terms)
        return packed(long, keys) if lists else long
    table = known.toArrow()
    codes = gram_codes(table.column("term").to_pylist())
    order = np.argsort(codes)
    shared = docs.sparkSession.sparkContext.broadcast((codes[order], table.column("idf").to_numpy()[order]))
    rows = _texts_by_id(docs, keys, text_col)
    columns = [rows.schema[c] for c in keys]
    if lists:
        return rows.mapInArrow(_by_id(min_n, max_n, _lists(list(keys), _weights(shared))), T.StructType([
            *columns, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
    return rows.mapInArrow(_by_id(min_n, max_n, _long(list(keys), "weight", _weights(shared))), T.StructType([
        *columns, T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def packed(weights: DataFrame, keys: tuple[str, ...], value: str = "weight") -> DataFrame:
    """``(keys..., terms, values)``: the rows of a long table as lists."""
    pairs = F.collect_list(F.struct("term", F.col(value).alias("v")))
    return weights.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.term").alias("terms"), F.col("_p.v").alias("values"))


def fit_transform_tfidf(docs: DataFrame, is_test_col: str = "is_test", min_n: int = 1, max_n: int = 2,
                        text_col: str = "norm_text", id_col: str = "sentence_id"):
    """Fit the IDF on the train rows of ``docs`` and weight every row.

    ``docs`` holds ``id, text, is_test``.  Returns ``(weights, idf)`` where
    ``weights`` is ``(id, is_test, term, weight)``.
    """
    idf = fit_idf(docs.where(~F.col(is_test_col)), min_n, max_n, text_col)
    return weigh(docs, idf, (is_test_col,), min_n, max_n, text_col, id_col), idf


def gram_vocab(idf: DataFrame) -> DataFrame:
    """Vocabulary sorted by term with a dense index from 0 (I7), without a one-task sort."""
    from ..sources.delimited import with_row_index
    return with_row_index(idf.select("term"), "term", "term_index").select("term", "term_index")
