"""Filter interaction audit on a sparse document-term matrix.

Five filters are applied in all 120 orders; the report says how many documents
each step removes, which it would have removed had another filter not come
first, and what good or toxic ones go with them.

* Words are dictionary-encoded: every shard (one bounded Arrow batch of
  documents) numbers its words as it reads them, the shards' dictionaries meet
  in one global dictionary with dense ids, and each shard's numbers are
  replaced by global ones.  The texts are read once and never shuffled.
* The result is a table of CSR shards (row pointers, sorted global column ids,
  counts).  A row's sum is the document's words, its nonzero entries the
  distinct ones: they decide filters A and B.  The remaining flags are attached
  to the rows.
* Documents collapse to counts by (part, set of failing filters, labels); all
  orders are worked out on those.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import NOT_SPACE, runs, text_buffers, word_pieces, word_spans

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
SHARD = 16 << 20

_CAPITALS = bytes(range(65, 91))
_LATER_BYTES = bytes(range(0x80, 0xC0))


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes (8 bytes of length, then zstd)."""
    raw = np.ascontiguousarray(values, dtype=np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.int64)


def csr_gaps(pointers: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sorted column ids as gaps inside each row (the first one of a row as it is): small numbers."""
    gaps = np.diff(columns, prepend=0)
    first = pointers[:-1][np.diff(pointers) > 0]
    gaps[first] = columns[first]
    return gaps


def csr_columns(pointers: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The column ids of ``csr_gaps``."""
    if not len(gaps):
        return gaps
    total = np.cumsum(gaps)
    first = pointers[:-1]
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0)
    return total - np.repeat(before, np.diff(pointers))


def sort_rows(pointers: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's entries by column id."""
    row = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    top = int(columns.max(initial=0)) + 1
    if len(pointers) * top >= 1 << 62:
        order = np.lexsort((columns, row))
    else:
        order = np.argsort(row * top + columns)
    return columns[order], counts[order]


def text_flags(raw: bytes) -> int:
    """Bits 2 and 3: too many capitals (C), holds a mark (D)."""
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw.translate(None, _LATER_BYTES))
    return (4 if 100 * capitals > MOST_CAPITALS_PERCENT * points else 0) | (
        8 if len(raw.translate(None, MARKS)) < len(raw) else 0)


def word_flags(pointers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits 0 and 1 of each row from its sum and its entries: too few words (A), too few distinct ones (B)."""
    before = np.concatenate([[0], np.cumsum(counts)])
    words = before[pointers[1:]] - before[pointers[:-1]]
    distinct = np.diff(pointers)
    return (words < LEAST_WORDS) * 1 | (100 * distinct < LEAST_DISTINCT_PERCENT * words) * 2


def _words(raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of concatenated texts, case kept, and how many each text has."""
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end, before = word_spans(data, bounds, NOT_SPACE)
    ends = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=ends[1:])
    return (pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[NOT_SPACE[data]])]),
            np.diff(before))


def _numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts in the order in which they first come, and the texts' counts of them as CSR arrays."""
    words, owner = [pa.array([], pa.binary())], []
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    for i, j in runs(bounds):
        if j - i > 1:
            found, n = _words(b"".join(texts[i:j]), bounds[i:j + 1] - bounds[i])
            words.append(found)
            owner.append(np.repeat(np.arange(i, j), n))
        else:  # perhaps a long text: in pieces, so that the work space is bounded whatever its length
            found = [pa.array(x, pa.binary()) for x in word_pieces(texts[i])]
            words += found
            owner.append(np.full(sum(map(len, found)), i))
    coded = pa.concat_arrays(words).dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy()
    entries, counts, at = [], [], 0
    for own in owner:
        entry, n = np.unique(own * len(known) + codes[at:at + len(own)], return_counts=True)
        entries.append(entry)
        counts.append(n)
        at += len(own)
    whole = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    row, columns = np.divmod(whole(entries), max(len(known), 1))
    return known, np.searchsorted(row, np.arange(len(texts) + 1)), columns, whole(counts)


def _shard(ids: pa.Array, parts: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    words, ptr, cols, n = _numbered(texts)
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays([
        whole(ids), whole(parts), whole(pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())),
        whole(pa.array([text_flags(x) for x in texts], pa.int32())), whole(words),
        pa.array([pack(ptr)], pa.binary()), pa.array([pack(csr_gaps(ptr, cols))], pa.binary()), pa.array([pack(n)], pa.binary())],
        ["ids", "parts", "digests", "flags", "words", "pointers", "columns", "counts"])


def _shards(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(2))
        for i, j in runs(off, SHARD):
            texts = [bytes(data[a:z]) for a, z in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist())]
            yield _shard(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), texts)


def _renumbered(batches) -> Iterator[pa.RecordBatch]:
    """(shard, columns, pointers, counts, numbers: [(place, id)]) -> the same shard over global ids."""
    for b in batches:
        ends = b.column(4).offsets.to_numpy()
        pairs = b.column(4).flatten()
        place, ident = (pairs.field(k).to_numpy() for k in (0, 1))
        ends = ends - ends[0]
        for k in range(len(b)):
            to = np.empty(ends[k + 1] - ends[k], dtype=np.int64)
            to[place[ends[k]:ends[k + 1]]] = ident[ends[k]:ends[k + 1]]
            ptr, n = unpack(b.column(2)[k].as_py()), unpack(b.column(3)[k].as_py())
            cols, n = sort_rows(ptr, to[csr_columns(ptr, unpack(b.column(1)[k].as_py()))], n)
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(k, 1), pa.array([pack(ptr)], pa.binary()),
                pa.array([pack(csr_gaps(ptr, cols))], pa.binary()), pa.array([pack(n)], pa.binary())],
                ["shard", "pointers", "columns", "counts"])


def dictionary(words: DataFrame) -> DataFrame:
    """(word, id): dense ids of the distinct values of the one column ``word``."""
    listed = store.written(words.distinct().select("word", F.monotonically_increasing_id().alias("place")), "dictionary")
    part = F.shiftrightunsigned("place", 33)
    sizes = {r["p"]: r["n"] for r in listed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):  # one number per written partition
        offsets.append(total)
        total += sizes.get(p, 0)
    before = F.from_json(F.lit(json.dumps(offsets)), "array<bigint>")
    return listed.select("word", (F.element_at(before, part.cast("int") + 1) + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"))


def csr_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The document-term matrix: (shards, rows' ids and flags by shard, dictionary).

    ``shards`` has (shard, pointers, columns, counts) as packed integers;
    its rows are the entries of ``ids``, ``parts``, ``digests`` and ``flags``
    of the same shard in the second table.  A null text is empty.
    """
    store.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    local = T.StructType([
        T.StructField("ids", T.ArrayType(kind)), T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("flags", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("pointers", T.BinaryType()),
        T.StructField("columns", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    read = store.written(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                    F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_shards, local).withColumn("shard", F.monotonically_increasing_id()), "local-shards")
    known = dictionary(read.select(F.explode("words").alias("word")))
    # Each shard's own dictionary in global ids; it is no larger than the shard.
    numbers = (read.select("shard", F.posexplode("words").alias("place", "word")).join(known, "word")
               .groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("numbers")))
    rows = read.select("shard", "columns", "pointers", "counts").join(numbers, "shard", "left").withColumn(
        "numbers", F.coalesce("numbers", F.array().cast("array<struct<place:int,id:bigint>>")))
    shards = store.written(rows.select("shard", "columns", "pointers", "counts", "numbers").mapInArrow(
        _renumbered, "shard long, pointers binary, columns binary, counts binary"), "csr-shards")
    return shards, read.select("shard", "ids", "parts", "digests", "flags"), known


def _row_flags(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(len(b)):
            ptr = unpack(b.column(0)[k].as_py())
            flags = word_flags(ptr, unpack(b.column(1)[k].as_py()))
            yield pa.RecordBatch.from_arrays([
                b.column(2)[k].values, b.column(3)[k].values, b.column(4)[k].values,
                pa.array(flags | b.column(5)[k].values.to_numpy(), pa.int32())], ["id", "part", "digest", "failing"])


def failing_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per input row: id, part, failing (bit k: fails the k-th filter).

    A null text is empty, a null part the empty string.  A null id is neither
    smaller nor larger than any other, so such a row never fails E and makes
    no other fail it.
    """
    kind = docs.schema[id_col].dataType
    shards, about, _ = csr_shards(docs, id_col, text_col, part_col)
    rows = store.written(
        shards.select("shard", "pointers", "counts").join(about, "shard")
        .select("pointers", "counts", "ids", "parts", "digests", "flags")
        .mapInArrow(_row_flags, T.StructType([
            T.StructField("id", kind), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()),
            T.StructField("failing", T.IntegerType())])), "audit-rows")
    copies = store.written(rows.where(F.col("id").isNotNull()).groupBy("digest")
                           .agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last"), "copies")
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(copies, "digest", "left").select(
        "id", "part", (F.col("failing") + F.when(late, F.lit(16)).otherwise(F.lit(0))).alias("failing"))


def _steps() -> list[dict]:
    """Every step of every order: the bit of its filter and the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "bit": 1 << k, "before": before})
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The report: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Rows of all parts, orders and steps, zeros included; no documents, no
    rows.  Of several label rows of one id, one with the value 1 is enough;
    labels with a null id belong to none.
    """
    found = failing_filters(docs, id_col, text_col, part_col)
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    marked = store.written(marked, "label-marks")
    known = found.where(F.col("id").isNotNull()).join(marked, F.col("id") == F.col("label_id"), "left")
    cells = known.select("part", "failing", "good", "toxic").union(
        found.where(F.col("id").isNull()).select("part", "failing", F.lit(0), F.lit(0)))
    cells = store.written(cells.groupBy("part", "failing").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")), "audit-cells")
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = cells.select("*", F.explode(steps).alias("s")).select("part", "failing", "n", "good", "toxic", "s.*")
    fails = F.col("failing").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failing").bitwiseAND(F.col("before")) != 0
    # Of the 120 orders, those in which this filter comes first among the failing ones.
    orders = F.floor(F.lit(120) / F.greatest(F.bit_count("failing"), F.lit(1))).cast("long")
    total = lambda cond, what: F.sum(F.when(cond, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, "n").alias("kept"), total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"), total(F.col("failing") == F.col("bit"), "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        total(fails, F.col("n") * orders).alias("shapley"))
