"""Scores of whole texts under models learned from the corpus.

Two models: add-0.1 smoothed words (a base line) and context-tree weighting
over bytes (``context_tree``).  Both are tables that grow with the corpus, so
neither is broadcast.  Documents are dealt to blocks of about
``block_bytes``; a block gathers its distinct words and grams with their
training counts, the model answers for exactly those keys, and a block meets
its slice of the model in a co-group.  A block and its slice are bounded by
the block's own bytes, and a word that every document holds costs one row a
block.

Rows that are equal in id and text would all fall into one block; they are
scored once, with a count.  A text longer than a block is cut before white
space into parts, each dealt on its own with the bytes before it as context;
the sums of the parts are added.  (A single word longer than a block stays in
one part.)  Every row counts 64 bytes beside its text, so many empty texts
make more blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import WordRun, documents, runs, text_buffers
from tessera.llm.context_tree import gram_run, log10_of_grams

WORD, GRAM = 0, 1
MOST_BITS = 1 << 30  # of the Bloom filter of repeated rows
ROW_BYTES = 64  # what a row weighs beside its text
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Settings:
    depth: int = 4  # bytes of context
    block_bytes: int = 16 << 20
    smoothing: float = 0.1


def _cut(size: int, depth: int):
    """Parts of about ``size`` bytes: the columns before the text, the text, the bytes before it, whether it is the last."""
    def emit(batches):
        for b in batches:
            for i, raw in enumerate(documents(b.column(b.num_columns - 1))):
                at = 0
                while at < len(raw) or not at:
                    end = _SPACE.search(raw, at + size) if at + size < len(raw) else None
                    stop = end.start() if end else len(raw)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(i, 1) for c in b.columns[:-1]), pa.array([raw[at:stop].decode(errors="replace")]),
                         pa.array([raw[max(0, at - depth):at]], pa.binary()), pa.array([stop == len(raw)])],
                        [*b.schema.names[:-1], "text", "lead", "last"])
                    at = stop
                    if stop == len(raw):
                        break
    return emit


def _parts(table: pa.Table, depth: int):
    """Runs of a block, as (run, grams, place of each text's first gram, whether its last text ends there).

    A part of a longer text is a run of its own.
    """
    data, off = text_buffers(table["text"])
    lead = table["lead"].to_pylist()
    whole = table["last"].combine_chunks().to_numpy(zero_copy_only=False) & np.array([not x for x in lead], dtype=bool)
    cuts = np.flatnonzero(~whole)
    for i, j in runs(off):
        own = cuts[np.searchsorted(cuts, i):np.searchsorted(cuts, j)]
        edges = sorted({i, j, *own.tolist(), *(own + 1).tolist()})
        for a, b in zip(edges, edges[1:]):
            run = WordRun(data, off, a, b)
            if whole[a]:
                yield run, *gram_run(run.raw, run.bounds, depth), True
                continue
            before = np.frombuffer(lead[a].lower(), dtype=np.uint8)
            grams, first = gram_run(np.concatenate([before, run.raw]), np.array([0, len(before) + len(run.raw)]), depth)
            last = table["last"][a].as_py()
            yield run, grams[len(before):len(grams) - (not last)], first, last


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _counted(keys: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their training counts; ``times`` says how often each key counts, 0 in held-out texts."""
    out = []
    for n in np.unique(times):
        key, count = np.unique(keys[times == n], return_counts=True)
        out.append((key, count * n))
    return out


def _gather(depth: int):
    """The distinct words and grams of one block, with their training counts."""
    def gather(table: pa.Table) -> pa.Table:
        found = {WORD: [], GRAM: []}
        held = table["held"].combine_chunks().to_numpy(zero_copy_only=False)
        times = np.where(held, 0, table["times"].combine_chunks().to_numpy())
        for run, grams, first, _ in _parts(table, depth):
            t = times[run.first_doc:run.first_doc + run.docs]
            found[WORD] += _counted(run.hash, np.repeat(t, np.diff(run.before)))
            found[GRAM] += _counted(grams, np.repeat(t, np.diff(first, append=len(grams))))
        kinds, keys, ns = [], [], []
        for kind, parts in found.items():
            if parts:
                key, n = _summed(parts)
                kinds.append(np.full(len(key), kind, dtype=np.int8))
                keys.append(key.view(np.int64))
                ns.append(n)
        size = sum(map(len, keys))
        block = np.full(size, table["block"][0].as_py(), dtype=np.int32)
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
        return pa.table({"block": pa.array(block), "kind": join(kinds, np.int8), "key": join(keys, np.int64),
                         "n": join(ns, np.int64)})
    return gather


def _values(key: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(0)
    at = np.searchsorted(key, wanted)
    if at.max(initial=0) >= len(key) or not np.array_equal(key[at], wanted):
        raise RuntimeError("a block lacks part of its slice of the model")
    return value[at]


def _score(settings: Settings, total: int, distinct: int, texts: int):
    """Scores of one block from its slice: word counts and log10 probabilities of grams."""
    s = settings.smoothing
    norm = np.log10(total + s * (distinct + 1))
    end = np.log10(texts + s) - norm

    def score(docs: pa.Table, slice_: pa.Table) -> pa.Table:
        kind = slice_["kind"].combine_chunks().to_numpy()
        table = {}
        for k in (WORD, GRAM):
            at = np.flatnonzero(kind == k)
            key = slice_["key"].combine_chunks().to_numpy()[at].view(np.uint64)
            order = np.argsort(key)
            table[k] = key[order], slice_["value"].combine_chunks().to_numpy()[at][order]
        words, counts = table[WORD]
        logs = np.log10(counts + s) - norm
        n = docs.num_rows
        tokens, known, base, ctw, size = (np.zeros(n, t) for t in (np.int64, np.int64, float, float, np.int64))
        for run, grams, first, ends in _parts(docs, settings.depth):
            at = slice(run.first_doc, run.first_doc + run.docs)
            doc = np.repeat(np.arange(run.docs), np.diff(run.before))
            place = _values(words, np.arange(len(words)), run.hash).astype(np.int64)
            tokens[at] = np.diff(run.before) + ends
            known[at] = np.bincount(doc[counts[place] > 0], minlength=run.docs) + (ends and texts > 0)
            base[at] = np.bincount(doc, weights=logs[place], minlength=run.docs) + (end if ends else 0.0)
            if len(grams):
                ctw[at] = np.add.reduceat(_values(*table[GRAM], grams), first)
            size[at] = np.diff(first, append=len(grams))
        return pa.table({"id": docs["id"], "row_key": docs["row_key"], "held": docs["held"], "times": docs["times"],
                         "cut": docs["cut"], "n_tokens": tokens, "n_known": known, "base_score": base, "score": ctw,
                         "size": size})
    return score


def held_out(id_col: str) -> Column:
    """Ids whose CRC-32 (of the id as text) is divisible by ten; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def scores(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null texts are empty; an empty text has its end as the one token and a
    score for ending at once.  ``score`` is the log10 probability that context
    tree weighting gives to the lower-cased bytes and the end;
    ``bits_per_byte`` is its code length per coded byte.  Repeated rows count
    as often as they stand there.  Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), store.row_key(id_col, text_col).alias("row_key"),
                       held_out(id_col).alias("held"), F.lit(1).cast("long").alias("times"), F.lit(False).alias("cut"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, longest, texts = rows.agg(
        F.coalesce(F.sum(F.octet_length("text") + ROW_BYTES), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0)),
        F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-size // settings.block_bytes))
    dealt = _dealt(rows, longest, settings)
    blocked = dealt.withColumn("block", F.pmod(F.xxhash64("id", "text", "lead"), F.lit(blocks)).cast("int"))
    gathered = store.written(blocked.groupBy("block").applyInArrow(
        _gather(settings.depth), "block int, kind tinyint, key bigint, n bigint"), "lm-keys")

    words = gathered.where(F.col("kind") == WORD)
    counted = store.written(words.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("value")), "lm-words")
    total, distinct = counted.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count(F.when(F.col("value") > 0, 1))).first()
    total, distinct = total + texts, distinct + (texts > 0)

    asked = gathered.where(F.col("kind") == GRAM)
    counts = store.written(asked.groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "lm-grams")
    values = store.written(log10_of_grams(counts, settings.depth), "lm-gram-values")
    answers = words.join(counted, words["key"] == counted["word"]).select(
        "block", "kind", "key", F.col("value").cast("double").alias("value")).union(
        asked.join(values, asked["key"] == values["gram"]).select("block", "kind", "key", "value"))

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("row_key", T.LongType()),
        T.StructField("held", T.BooleanType()), T.StructField("times", T.LongType()), T.StructField("cut", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score")), T.StructField("size", T.LongType())])
    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(settings, total, distinct, texts), schema)
    sums = ("n_tokens", "n_known", "base_score", "score", "size")
    if longest > settings.block_bytes:  # the parts of cut texts are added
        scored = store.written(scored, "lm-parts")
        joined = scored.where("cut").groupBy("id", "row_key", "held", "times", "cut").agg(
            *(F.sum(c).alias(c) for c in sums))
        scored = scored.where("not cut").union(joined)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return scored.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("size")).alias("bits_per_byte"), again.alias("__again")).drop("__again")


def _dealt(rows: DataFrame, longest: int, settings: Settings) -> DataFrame:
    """``rows`` with equal ones as one (``times``), long texts in parts (``cut``), and what each part follows."""
    whole = [F.lit(b"").cast("binary").alias("lead"), F.lit(True).alias("last")]
    keys = store.written(rows.groupBy("row_key").count().where("count > 1").select("row_key"), "lm-repeated")
    n = keys.count()
    if n:  # only rows that a Bloom filter marks as possibly repeated move before they are dealt
        marked = store.marked(rows, "row_key", store.bloom(keys, store.filter_bits(n, MOST_BITS)), "maybe")
        one = marked.where("maybe").groupBy("id", "row_key", "held", "cut", "text").agg(F.count(F.lit(1)).alias("times"))
        rows = marked.where("not maybe").drop("maybe").unionByName(one)
    if longest <= settings.block_bytes:
        return rows.select("*", *whole)
    long = F.octet_length("text") > settings.block_bytes
    schema = T.StructType([*rows.schema.fields, T.StructField("lead", T.BinaryType()), T.StructField("last", T.BooleanType())])
    parts = rows.where(long).withColumn("cut", F.lit(True)).mapInArrow(_cut(settings.block_bytes, settings.depth), schema)
    return rows.where(~long).select("*", *whole).unionByName(parts)
