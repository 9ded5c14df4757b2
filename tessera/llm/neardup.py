"""Near-duplicate groups: banded MinHash, odd sketches, exact confirmation, components.

A document's set holds the hashes of its distinct word shingles (64 bits
each).  Documents with equal sets form one class; from there on one
representative stands for the class, so copies cost nothing more.

* ``bands * rows`` MinHash samples; bands of ``rows`` samples name buckets.
  The number of bands follows from the threshold so that a pair at the
  threshold shares no bucket with probability below ``MISS``.
* A second MinHash sample, the ``SAMPLE`` smallest hashes of the set, is folded
  into an odd sketch: every sampled hash flips one bit of a parity map.  The
  population count of two sketches' XOR is at most the size of the samples'
  symmetric difference, which the threshold and the set sizes bound: exactly
  for sets within the sample, with probability above 1 - ``MISS`` beyond.
  Pairs above the bound are not verified.
* Buckets first emit stars (every member with the smallest and the largest
  member).  Confirmed links are merged; only in buckets that still hold more
  than one component are the members outside the bucket's main component
  compared with the members of other components.  Pairs inside a component
  are never emitted, so a clique of copies costs a star, not a square.
* That comparison uses a second parity map, of the whole set and with at least
  four bits an element (up to ``MOST_PARITY``).  It is made inside Arrow groups
  of at most about ``BLOCK`` by ``BLOCK`` members; only pairs whose maps differ
  by no more than a link allows become rows.  A group with more such pairs than
  members emits a spanning forest of the closest ones first; what is left when
  those links are merged comes out in a second round.
* Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import WordRun, documents, mix64, word_runs
from tessera.llm.components import components

MISS = 1e-9
SAMPLE = 512
SKETCH_LONGS = 16
MOST_BITS = 1 << 30
MOST_PARITY = 1 << 16
BLOCK = 1024
PAIR_WORDS = 1 << 19


@dataclass(frozen=True)
class Settings:
    """``width`` words a shingle; similarity of at least ``percent`` / 100; samples in a band."""

    width: int = 5
    percent: int = 80
    rows: int = 4

    @property
    def bands(self) -> int:
        t = self.percent / 100
        return math.ceil(math.log(MISS) / math.log(1 - min(t ** self.rows, 1 - 1e-9)))


def shingle_hashes(run: WordRun, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a run and the n + 1 bounds of each document's part.

    A document with fewer words than ``width`` has its whole sequence as its
    one shingle; a document without words has none.
    """
    h, before = run.hash, run.before
    words = np.diff(before)
    count = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(count, out=bounds[1:])
    doc = np.repeat(np.arange(len(words)), count)
    first = np.arange(bounds[-1]) - bounds[doc] + before[doc]
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        at = first + k
        inside = at < before[doc + 1]
        out = np.where(inside, mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[np.where(inside, at, 0)]), out)
    return out, bounds


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minhashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n samples (rows) of each set (columns); ``starts`` are the sets' first places, none is empty."""
    a, b = _family(n)
    out = np.empty((n, len(starts)), dtype=np.uint64)
    work = np.empty_like(hashes)
    for i in range(n):
        np.multiply(hashes, a[i], out=work)
        np.add(work, b[i], out=work)
        np.bitwise_xor(work, work >> np.uint64(29), out=work)
        np.minimum.reduceat(work, starts, out=out[i])
    return out


def odd_sketch(distinct: np.ndarray) -> np.ndarray:
    """The parity map (SKETCH_LONGS 64-bit words) of the smallest hashes of a set; ``distinct`` is sorted."""
    bit = (distinct[:SAMPLE] & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def parity_map(distinct: np.ndarray) -> np.ndarray:
    """The parity map of a whole set: a power of two of bits, four an element or ``MOST_PARITY``, in 64-bit words."""
    bits = min(MOST_PARITY, max(64, 1 << (4 * len(distinct) - 1).bit_length()))
    odd = (np.bincount((distinct & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (rows) in fewer words: a bit's place is taken modulo the new number of bits."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def maps_apart(maps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the parity maps at places ``a`` and ``b``, in the shorter one's width: at most the sets' difference."""
    words = np.fromiter((len(x) // 8 for x in maps), np.int64, len(maps))
    of_width, row = {}, np.zeros(len(maps), dtype=np.int64)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        of_width[w] = np.frombuffer(b"".join(maps[i] for i in at), dtype=np.uint64).reshape(len(at), w)
        row[at] = np.arange(len(at))
    out = np.zeros(len(a), dtype=np.int64)
    for w in of_width:
        for v in of_width:
            least = min(v, w)
            pairs = np.flatnonzero((words[a] == w) & (words[b] == v))
            if not len(pairs):
                continue
            x, y = _folded(of_width[w], least), _folded(of_width[v], least)
            step = max(PAIR_WORDS // least, 1)
            for k in range(0, len(pairs), step):
                at = pairs[k:k + step]
                out[at] = np.bitwise_count(x[row[a[at]]] ^ y[row[b[at]]]).sum(axis=1, dtype=np.int64)
    return out


def _lists(values: np.ndarray, width: int) -> pa.Array:
    flat = np.ascontiguousarray(values).astype(np.uint64).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _signatures(settings: Settings):
    n = settings.bands * settings.rows

    def sign(batches):
        for batch in batches:
            texts = batch.column(1)
            keys = np.fromiter((xxhash.xxh3_64_intdigest(x.lower()) for x in documents(texts)), np.uint64, len(texts))
            for run in word_runs(texts):
                hashes, bounds = shingle_hashes(run, settings.width)
                size, ids = np.zeros(run.docs, dtype=np.int64), [None] * run.docs
                sketch = np.zeros((run.docs, SKETCH_LONGS), dtype=np.uint64)
                for d in range(run.docs):
                    if bounds[d + 1] > bounds[d]:
                        distinct = np.unique(hashes[bounds[d]:bounds[d + 1]])
                        size[d], ids[d], sketch[d] = len(distinct), set_id(distinct), odd_sketch(distinct)
                full = np.flatnonzero(size)
                samples = minhashes(hashes, bounds[full], n) if len(full) else np.zeros((n, 0), np.uint64)
                band = np.zeros((settings.bands, len(full)), dtype=np.uint64)
                for i in range(n):
                    band[i // settings.rows] = mix64(band[i // settings.rows] * np.uint64(31) + samples[i])
                band = mix64(band + np.arange(settings.bands, dtype=np.uint64)[:, None])
                bands = np.zeros((run.docs, settings.bands), dtype=np.uint64)
                bands[full] = band.T
                i, j = run.first_doc, run.first_doc + run.docs
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, run.docs), batch.column(2).slice(i, run.docs),
                     pa.array(keys[i:j].view(np.int64)), pa.array(size), pa.array(ids, pa.binary()),
                     _lists(bands, settings.bands), _lists(sketch, SKETCH_LONGS)],
                    ["id", "row_key", "text_key", "n", "sid", "bands", "sketch"])
    return sign


def _sets(width: int, bitmap):
    def emit(batches):
        done: set[bytes] = set()
        for batch in batches:
            texts = [x.lower() for x in documents(batch.column(0))]
            keys = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in texts), np.uint64, len(texts))
            wanted = np.flatnonzero(store.passes(bitmap.value, keys))
            for run in word_runs(pa.array([texts[i] for i in wanted], pa.binary())):
                hashes, bounds = shingle_hashes(run, width)
                ids, sets, maps = [], [], []
                for d in range(run.docs):
                    distinct = np.unique(hashes[bounds[d]:bounds[d + 1]])
                    if len(distinct) and (sid := set_id(distinct)) not in done:
                        done.add(sid)
                        ids.append(sid)
                        sets.append(distinct.view(np.int64))
                        maps.append(parity_map(distinct).tobytes())
                if ids:
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.binary()),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))),
                         pa.array(maps, pa.binary())], ["sid", "shingles", "parity"])
    return emit


def _bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH_LONGS)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _may_link(settings: Settings) -> Column:
    """What the sizes and the sketches of two sets allow.

    Sets of n_a <= n_b that are linked differ in at most ``apart`` elements;
    leaving out elements beyond the sample adds at most as many.  If both sets
    exceed the sample, the two samples differ by twice the number of sampled
    elements that the other set lacks, a hypergeometric count whose mean the
    sizes bound; Bernstein's inequality gives the margin.
    """
    t = settings.percent / 100
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = F.floor((small + large) * ((1 - t) / (1 + t)) + 1e-6)
    over = F.greatest(small - SAMPLE, F.lit(0)) + F.greatest(large - SAMPLE, F.lit(0))
    share = F.greatest(1 - (small + large) * (t / (1 + t)) / large, F.lit(0.0))
    log_miss = -math.log(MISS)
    margin = log_miss / 3 + F.sqrt(log_miss ** 2 / 9 + 2 * log_miss * SAMPLE * share * (1 - share))
    most = F.when(small > SAMPLE, F.least(2 * (SAMPLE * share + margin), apart + over)).otherwise(apart + over)
    return (small * 100 >= large * settings.percent) & (_bits_apart("sketch_a", "sketch_b") <= most)


def _side(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    rows = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
            .withColumn("both", F.size(F.array_intersect("x", "y")))
            .withColumn("any", F.size("x") + F.size("y") - F.col("both")))
    return rows.where(F.col("both") * 100 >= F.col("any") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the edges (a, b) that join two trees, taken in order."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        if (u := find(u)) != (v := find(v)):
            parent[u] = v
            out.append(k)
    return out


def _near_pairs(percent: int, forest: bool):
    """Of a group's rows: pairs (a, b) of different components of one bucket that sizes and parity maps allow.

    ``rest`` says that the group has more pairs than rows and emitted those
    that span them, the closest first.
    """
    def near(rows: pa.Table) -> pa.Table:
        key, cid, root, main, n = (rows.column(c).to_numpy() for c in ("key", "cid", "root", "main", "n"))
        left = rows.column("left").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        y = y[np.argsort(key[y], kind="stable")]
        first = np.searchsorted(key[y], key[x], side="left")
        count = np.searchsorted(key[y], key[x], side="right") - first
        maps = rows.column("parity").to_pylist()
        found, before, k = [], np.concatenate([[0], np.cumsum(count)]), 0
        while k < len(x):  # some rows of the left side at a time
            stop = max(int(np.searchsorted(before, before[k] + PAIR_WORDS, side="right")) - 1, k + 1)
            size = count[k:stop]
            a = np.repeat(x[k:stop], size)
            b = y[np.arange(len(a)) - np.repeat(before[k:stop] - before[k], size) + np.repeat(first[k:stop], size)]
            ok = (root[a] != root[b]) & ((root[b] == main[b]) | (cid[a] < cid[b]))
            ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            bits, most = maps_apart(maps, a, b) * (100 + percent), (n[a] + n[b]) * (100 - percent)
            ok = bits <= most
            found.append((a[ok], b[ok], bits[ok] / most[ok]))
            k = stop
        a, b, far = (np.concatenate(c) for c in zip(*found)) if found else (x[:0], x[:0], np.zeros(0))
        rest = forest and len(a) > len(rows)
        if rest:
            order = np.argsort(far, kind="stable")
            keep = order[_spanning(root[a[order]], root[b[order]])]
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.minimum(cid[a], cid[b]), pa.int64()),
                         "b": pa.array(np.maximum(cid[a], cid[b]), pa.int64()), "rest": pa.array(np.full(len(a), rest))})
    return near


def _open_pairs(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, rest) of the buckets that hold several components.

    Buckets of at most ``BLOCK`` members are dealt to groups of a few
    thousand rows.  Larger ones are cut into blocks of about ``BLOCK`` members
    on either side, and every block meets every block of the other side.
    """
    placed = (members.join(found.withColumnRenamed("node", "cid"), "cid", "left")
              .select("key", "cid", F.coalesce("root", "cid").alias("root")))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    split = store.written(parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.max("m").alias("most"),
        F.max_by("root", F.struct("m", "root")).alias("main")).where("parts > 1"), "split")
    rows = store.written(placed.join(split, "key").join(sets.select("cid", "n", "parity"), "cid"), "open")
    groups = max(1, -(-rows.count() // (4 * BLOCK)))
    blocks = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("other", F.col("m") - F.col("most")).withColumn("i", blocks("other")).withColumn("j", blocks("m"))
    large, block = F.col("m") > BLOCK, lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    a = rows.where("root <> main").select("*", F.lit(True).alias("left"), block("i").alias("x"),
                                          F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("y"))
    b = rows.select("*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("x"),
                    block("j").alias("y"))
    dealt = a.union(b).select("key", "cid", "root", "main", "n", "parity", "left", "x", "y",
                              F.when(large, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))).alias("g"),
                              large.alias("large"))
    return store.written(dealt.groupBy("large", "g", "x", "y").applyInArrow(
        _near_pairs(percent, forest), "a long, b long, rest boolean"), "open-pairs")


def near_groups(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row_key.

    ``component_id`` is the smallest id that the row reaches over links, its
    own included; ``kept`` says that it is the row's own.  A text without
    words (null, empty, blank) has the empty set and is linked with nothing.
    A null id is no smallest id: such a row takes the id of its group, and
    null (kept) if the group has none.  Repeated rows have equal results.
    ``row_key`` hashes id and text, for ``drop_near_duplicates``.
    """
    return _groups(docs, settings, id_col, text_col).drop("stays")


def _groups(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``near_groups`` with ``stays``: the row has the smallest (id, row_key) of its group, or no words."""
    spark = docs.sparkSession
    store.prepare(spark)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("row_key", T.LongType()), T.StructField("text_key", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("sid", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        store.row_key(id_col, text_col).alias("row_key"))
    rows = store.written(texts.mapInArrow(_signatures(settings), schema)
                         .withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = store.written(
        rows.where("n > 0").groupBy("sid").agg(
            F.min("rid").alias("cid"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("least"),
            F.any_value("n").alias("n"),
            F.min("text_key").alias("text_key"), F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch")), "classes")

    # Bucket members, without the buckets that a Bloom filter proves to have one member.
    members = classes.select("cid", F.explode("bands").alias("key"))
    n_members = classes.count() * settings.bands
    shared = store.bloom(members.select("key"), store.filter_bits(n_members, MOST_BITS), least=2)
    members = store.written(store.marked(members, "key", shared, "maybe").where("maybe").select("key", "cid"), "members")
    # Aggregates that are joined back are written first: both sides of the join then have exchanges of their own,
    # and the runtime splits the partition of a hot bucket.
    buckets = store.written(members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("m > 1"), "buckets")

    # Stars, filtered by size and sketch.
    small = classes.select("cid", "n", "sketch")
    stars = members.join(buckets, "key")
    stars = (stars.select(F.col("lo").alias("a"), F.col("cid").alias("b"))
             .union(stars.select(F.col("cid").alias("a"), F.col("hi").alias("b"))).where("a <> b").distinct())
    stars = store.written(stars.join(_side(small, "a"), "a").join(_side(small, "b"), "b")
                          .where(_may_link(settings)).select("a", "b"), "stars")

    # Full sets of the classes in shared buckets, read in one more pass over the texts.
    wanted = members.join(buckets.select("key"), "key", "left_semi").select("cid").distinct()
    wanted = store.written(classes.join(wanted, "cid", "left_semi").select("cid", "sid", "text_key", "n"), "wanted")
    bitmap = store.bloom(wanted.select("text_key"), store.filter_bits(wanted.count(), MOST_BITS))
    sets = (texts.select("text").mapInArrow(_sets(settings.width, bitmap), "sid binary, shingles array<bigint>, parity binary")
            .groupBy("sid").agg(F.any_value("shingles").alias("shingles"), F.any_value("parity").alias("parity")))
    sets = store.written(wanted.select("cid", "sid", "n").join(sets, "sid").select("cid", "n", "shingles", "parity"), "sets")

    links = store.written(_confirmed(stars, sets, settings.percent), "links")
    found = components(links)

    # Buckets that still hold several components: members outside the main one are compared with the other components.
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for forest in (True, False):
        pairs = _open_pairs(members, found, sets, settings.percent, forest)
        more = store.written(_confirmed(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"),
                                        sets, settings.percent), "links")
        if more.head(1):
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
        if not pairs.where("rest").head(1):
            break
        tested = tested.union(pairs.select("a", "b")).distinct()

    least = found.join(classes.select(F.col("cid").alias("node"), "least"), "node")
    of_root = least.groupBy("root").agg(F.min("least").alias("first"))
    linked = least.join(of_root, "root").select(F.col("node").alias("cid"), "first")
    by_set = classes.select("sid", "cid", "least").join(linked, "cid", "left").select(
        "sid", F.coalesce("first", "least").alias("first"))
    out = rows.where("n > 0").join(by_set, "sid").select(
        "id", "n", F.col("first.id").alias("component_id"), "row_key",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row_key") == F.col("first.row_key"))).alias("stays"))
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "row_key", F.lit(True).alias("stays"))
    return out.union(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                                   F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key", "stays")


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row of every near-duplicate group, with all its columns; the rows that stay are not shuffled.

    The smallest id, a null one last, and of equal ids the smallest row key.
    Repeated rows (equal in id and text) stay or go together.
    """
    groups = _groups(docs, settings, id_col, text_col)
    dropped = store.written(groups.where("not stays").select(F.col("doc_id").alias("id"), "row_key"), "near-dropped")
    return store.without(docs, dropped, id_col, text_col, MOST_BITS)
