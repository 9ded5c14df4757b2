"""One nested annotation object read by many tasks (A1, layout ``object``).

A JSON object cannot be cut at a line break.  It is read in pieces that end in
``}``, which Spark's text source splits by bytes like lines.  Whether a brace
counts depends on everything before it: is it inside a string, how deep is it.

1. Every split is summed up without knowing that: how its quotes change
   inside to outside, and how its braces change the depth if it begins
   outside, or inside, a string.  One small row a split reaches the driver,
   which composes them in file order and so knows where each split begins.
2. With that, every task cuts its split where a tweet or a group begins or
   ends.  Only the cut-off text at the edges of splits is put together again.
3. A tweet is wrapped with its group's key into an object of its own, which
   is parsed like a line of the ``ndjson`` layout.

Escapes never cross a piece: ``\\}`` is no JSON escape, so a piece does not end
between a backslash and its character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import scratch_path
from .annotations import parse_annotations

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STRING = r'"(?:[^"\\]++|\\.)*+"'  # a JSON string, quotes included
_PIECES = "file string, size long, block long, value string"
_SUMMARY = "file string, size long, block long, bytes long, quotes long, outside long, inside long"
_FRAGMENT = "file string, block long, place int, kind string, groups int, edge string, text binary"


def _braces(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the braces outside strings, the depth after each (from 0), and whether the data ends inside one."""
    raw = np.frombuffer(_ESCAPED.sub(b"xx", data), dtype=np.uint8)
    at = np.flatnonzero((raw == 0x22) | (raw == 0x7B) | (raw == 0x7D))
    what = raw[at]
    quoted = (np.cumsum(what == 0x22) + inside) & 1
    brace = (what != 0x22) & (quoted == 0)
    return at[brace], np.cumsum(np.where(what[brace] == 0x7B, 1, -1)), bool((np.count_nonzero(what == 0x22) + inside) & 1)


def _runs(batch: pa.RecordBatch):
    """(file, size, block, bytes) of the rows of each split in a batch; every piece gets its brace back."""
    file, size, block = (batch.column(k).to_pylist() for k in range(3))
    values = batch.column(3)
    at = 0
    for k in range(1, len(batch) + 1):
        if k == len(batch) or (file[k], block[k]) != (file[at], block[at]):
            yield file[at], size[at], block[at], b"".join(
                x for v in values.slice(at, k - at).cast(pa.binary()).to_pylist() for x in (v, b"}"))
            at = k


def _summary(batches):
    """One row for each split: bytes, parity of its quotes, change of depth from outside and from inside a string."""
    done: dict[tuple, list] = {}
    for b in batches:
        for file, size, block, data in _runs(b):
            _, out, quotes = _braces(data, False)
            _, inn, _ = _braces(data, True)
            s = done.setdefault((file, size, block), [0, 0, 0, 0])
            a, z = (out, inn) if not s[1] else (inn, out)  # what follows begins where the part before ended
            s[0] += len(data)
            s[2] += int(a[-1]) if len(a) else 0
            s[3] += int(z[-1]) if len(z) else 0
            s[1] ^= int(quotes)
    for key, s in done.items():
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(
            ("file", "size", "block", "bytes", "quotes", "outside", "inside"), (*key, *s))})


def _compose(rows: list) -> tuple[dict[tuple, tuple[bool, int, int]], list[str]]:
    """Where each split begins, {(file, block): (inside a string, depth, bytes that are the file's)}, and broken files."""
    starts, broken = {}, []
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r["file"], []).append(r)
    for file, parts in files.items():
        inside, depth, total = False, 0, 0
        parts.sort(key=lambda r: r["block"])
        surplus = sum(r["bytes"] for r in parts) - parts[0]["size"]  # 1 if the file does not end in a brace
        for n, r in enumerate(parts):
            own = r["bytes"] - (surplus if n == len(parts) - 1 else 0)
            starts[file, r["block"]] = (inside, depth, own)
            depth += r["inside"] if inside else r["outside"]
            inside ^= bool(r["quotes"])
            total += own
        if not inside:
            depth += surplus  # the brace that was not there
        if inside or depth or surplus not in (0, 1):
            broken.append(file)
    return starts, broken


def _kind(depth: int, before: int) -> str | None:
    return {(0, 1): "open", (1, 2): "group", (3, 2): "tweet", (2, 1): "end", (1, 0): "close"}.get((before, depth))


def _fragments(starts):
    def cut(batches):
        state: dict[tuple, list] = {}
        for b in batches:
            for file, _, block, data in _runs(b):
                if (file, block) not in starts.value:
                    raise RuntimeError(f"{file}: its splits changed while it was read; read it again")
                s = state.setdefault((file, block), [*starts.value[file, block], 0, 0, b"", False])
                inside, depth, left, place, groups, rest, cut_once = s
                data = data[:left]
                left -= len(data)
                at, after, inside = _braces(data, inside)
                after = after + depth
                before = np.concatenate([[depth], after[:-1]]) if len(after) else after
                out, last = [], 0
                # Only depths 0 to 3 matter: a tweet's own objects lie deeper.
                for k in np.flatnonzero((np.minimum(before, after) <= 2) & ~((before == 2) & (after == 3))):
                    kind = _kind(int(after[k]), int(before[k]))
                    end = int(at[k]) + (1 if kind == "tweet" else 0)
                    out.append((place, kind or "depth", groups, "" if cut_once else "head", rest + data[last:end]))
                    place, groups, cut_once, rest = place + 1, groups + (kind == "group"), True, b""
                    last = int(at[k]) + 1
                rest += data[last:]
                depth = int(after[-1]) if len(after) else depth
                state[file, block] = [inside, depth, left, place, groups, rest, cut_once]
                if out:
                    yield _fragment_batch(file, block, out)
        for (file, block), (_, _, _, place, groups, rest, cut_once) in state.items():
            yield _fragment_batch(file, block, [(place, None, groups, "tail" if cut_once else "middle", rest)])
    return cut


def _fragment_batch(file: str, block: int, rows: list) -> pa.RecordBatch:
    place, kind, groups, edge, text = zip(*rows)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(place, pa.int32()), pa.array(kind, pa.string()),
         pa.array(groups, pa.int32()), pa.array(edge), pa.array(text, pa.binary())],
        ["file", "block", "place", "kind", "groups", "edge", "text"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def read_annotation_objects(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``(doc, source)`` as ``read_annotations`` gives them, one row a tweet, from files of one nested object each.

    Each file is split into many tasks (of ``split_bytes``, default: the
    session's).  Of repeated group keys the last one counts, of repeated tweet
    keys in a group too.  A file whose quotes or braces do not match is one
    malformed row without text; text that fits nowhere is a malformed row.
    Eager: the files are read when this is called.
    """
    key = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(key)
    if split_bytes:
        spark.conf.set(key, str(split_bytes))
    try:
        pieces = _pieces(spark, path)
        starts, broken = _compose(pieces.mapInArrow(_summary, _SUMMARY).collect())
        where = scratch_path(spark, "object-fragments")
        held = spark.sparkContext.broadcast(starts)
        pieces.mapInArrow(_fragments(held), _FRAGMENT).write.parquet(where)
    finally:
        spark.conf.set(key, usual)
    cuts = spark.read.schema(_FRAGMENT).parquet(where)
    cuts = cuts.where(~F.col("file").isin(broken)) if broken else cuts

    # One row a split: groups begun in earlier splits, and the split whose tail a cut-off beginning belongs to.
    splits = cuts.where("kind is null").select("file", "block", "groups", "edge").collect()
    offsets, run, seen = [], {}, {}
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        f = r["file"]
        offsets.append((f, r["block"], seen.get(f, 0), run.get(f, -1)))
        seen[f] = seen.get(f, 0) + r["groups"]
        if r["edge"] == "tail":
            run[f] = r["block"]
    about = spark.createDataFrame(offsets, "file string, block long, earlier int, owner long")
    cuts = join_small(cuts, about, ["file", "block"], "inner", known_rows=len(offsets)).withColumn(
        "number", F.col("earlier") + F.col("groups"))
    whole = cuts.where("edge = ''").select("file", "block", "place", "kind", "number", "text")
    edges = cuts.where("edge <> ''").withColumn("owner", F.when(F.col("edge") == "tail", F.col("block")).otherwise(F.col("owner")))
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = edges.groupBy("file", "owner").agg(
        F.min("block").alias("block"), F.min_by("place", "block").alias("place"), F.max("kind").alias("kind"),
        F.max_by("number", "block").alias("number"), parts.alias("parts"))
    joined = joined.select("file", "block", "place", "kind", F.col("number"), F.aggregate(
        "parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["text"])).alias("text"))
    cuts = whole.unionByName(joined)

    blank = F.trim(F.regexp_replace(F.col("text").cast("string"), r"\s+", "")) == ""
    found = F.regexp_extract(F.col("text").cast("string"), rf"(?s)({_STRING})\s*:\s*$", 1)
    heads = cuts.where("kind = 'group'").select(
        "file", "block", (F.col("number") + 1).alias("number"), "text", F.when(found != "", found).alias("raw"))
    heads = heads.withColumn("key", F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0)))
    last = heads.groupBy("file", "key").agg(F.max("number").alias("number"))
    heads = heads.join(last.drop("key"), ["file", "number"], "left_semi")
    tweets = cuts.where((F.col("kind") == "tweet") | ((F.col("kind") == "end") & ~blank)).select(
        "file", "block", "place", "number", F.regexp_replace(F.col("text").cast("string"), r"^\s*,", "").alias("body"))
    name = F.regexp_extract("body", rf"(?s)^\s*({_STRING})", 1)
    tweets = tweets.withColumn("tweet", F.get(F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>"), F.lit(0)))
    order = F.struct("block", "place")
    twice = tweets.groupBy("file", "number", "tweet").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last")).where("n > 1")
    tweets = join_small(tweets, twice.select("file", "number", "tweet", "last"), ["file", "number", "tweet"], "left")
    tweets = tweets.where(F.col("last").isNull() | (F.col("last") == order))
    met = join_small(tweets, heads.select("file", "number", "raw"), ["file", "number"], "inner")
    value = F.concat(F.lit("{"), "raw", F.lit(":{"), "body", F.lit("}}"))
    empty = heads.join(tweets.select("file", "number").distinct(), ["file", "number"], "left_anti")
    # Whatever else has text: only the commas between groups, and blanks, belong there.
    stray = cuts.where(F.col("kind").isNull() & ~blank | F.col("kind").isin("open", "close", "depth") & ~blank).select(
        "file", "block", F.concat(F.lit("not part of a group: "), F.col("text").cast("string")).alias("value"))
    spoilt = heads.where(~F.regexp_replace(F.col("text").cast("string"), r"^\s*,", "").rlike(rf"(?s)^\s*{_STRING}\s*:\s*$")).select(
        "file", "block", F.col("text").cast("string").alias("value"))
    rows = (met.select("file", "block", value.alias("value"))
            .unionByName(empty.where("raw is not null").select("file", "block", F.concat(F.lit("{"), "raw", F.lit(":{}}")).alias("value")))
            .unionByName(stray).unionByName(spoilt))
    if broken:
        rows = rows.unionByName(spark.createDataFrame([(f, 0, "quotes or braces do not match") for f in broken], rows.schema))
    return parse_annotations(rows, "value", F.col("file"), F.col("block"))
