"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate secrets in whole texts.  The hash of every candidate's
value is then counted over the corpus, by distinct owners and repositories: a
value that many owners or many repositories have is a copied example, one that a single owner has
and that looks random is a live-looking credential, one with owners in between
is shared.  Values never leave the scan, only their hashes do.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import documents
from tessera.llm.spans import Span, digest, in_code_points

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "live", "example", "shared")

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]++")
_HEX = re.compile(rb"[0-9a-f]{24,}")


@dataclass(frozen=True)
class Settings:
    copied_owners: int = 3  # owners from which a value counts as a copied example
    copied_repositories: int = 4  # the same by repositories, of however few owners
    live_bits: float = 2.8  # entropy per character that a live-looking value has at least
    live_length: int = 12


def find(raw: bytes) -> list[tuple[Span, tuple[int, int]]]:
    """(span, place of the value) of every candidate, in bytes."""
    out = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        out += [((*m.span(), "assign"), m.span(1)) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        out += [((*m.span(), "access"), m.span()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    return out + [((*m.span(), "hex"), m.span()) for m in _HEX.finditer(raw)]


def looks_random(value: bytes, settings: Settings) -> bool:
    n = len(value)
    if n < settings.live_length:
        return False
    counts = [value.count(c) for c in set(value)]
    return -sum(c / n * math.log2(c / n) for c in counts) >= settings.live_bits


_CANDIDATE = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("from", pa.int64()),
                        ("to", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])


def _scan(settings: Settings):
    def emit(batches):
        for b in batches:
            base, rows = [], []
            for raw in documents(b.column(3)):
                found = find(raw)
                spans = in_code_points(raw, [s for s, _ in found])
                values = in_code_points(raw, [(*v, "") for _, v in found])
                places = [(a, KINDS.index(k), e, v[0], v[1], hashlib.sha256(raw[f:t]).hexdigest()[:32],
                           looks_random(raw[f:t], settings))
                          for (a, e, k), v, (_, (f, t)) in zip(spans, values, found)]
                places.sort()
                base.append(digest([(p[0], p[2], KINDS[p[1]]) for p in places]))
                rows.append([{"rank": p[1], "start": p[0], "end": p[2], "from": p[3], "to": p[4], "value": p[5],
                              "random": p[6]} for p in places])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(base, pa.string()),
                                              pa.array(rows, pa.list_(_CANDIDATE))],
                                             ["id", "owner", "repository", "base", "found"])
    return emit


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories, places) from rows (value, owner, repository).

    Aggregated step by step, so a value that stands in a third of all
    documents costs each task one row per owner and repository.
    """
    return (candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"),
                                  F.sum("n").alias("places")))


def scan(docs: DataFrame, owner: Column, repository: Column, settings: Settings = Settings(), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_live, n_example, n_shared, base_sha256,
    spans, ownership.

    ``spans`` joins the base spans and, at the place of the value, a ``live``,
    ``example`` or ``shared`` span by the ownership counts (a single owner's
    value that does not look random has none); ``base_sha256`` digests the
    base spans; ``ownership`` joins start:end:owners:repositories of all values.  Null and empty texts have none; a
    null owner or repository is one owner or repository of its own.  Repeated
    rows count as further places of the same owner.
    """
    store.prepare(docs.sparkSession)
    field = T.StructType([T.StructField("rank", T.IntegerType()), *(T.StructField(c, T.LongType())
                          for c in ("start", "end", "from", "to")), T.StructField("value", T.StringType()),
                          T.StructField("random", T.BooleanType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.StringType())
                           for c in ("owner", "repository", "base")), T.StructField("found", T.ArrayType(field))])
    rows = store.written(
        docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"),
                    repository.cast("string").alias("repository"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_scan(settings), schema).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("found") > 0).select("rid", "owner", "repository", F.explode("found").alias("c"))
    counted = store.written(ownership(each.select(F.col("c.value").alias("value"), "owner", "repository")), "owners")
    live = (F.col("owners") == 1) & F.col("c.random")
    copied = (F.col("owners") >= settings.copied_owners) | (F.col("repositories") >= settings.copied_repositories)
    verdict = F.when(copied, F.lit(KINDS.index("example"))).when(
        live, F.lit(KINDS.index("live"))).when(F.col("owners") > 1, F.lit(KINDS.index("shared")))
    added = (each.select("rid", "c", F.col("c.value").alias("value")).join(counted, "value")
             .select("rid", verdict.alias("rank"), F.col("c.from").alias("start"), F.col("c.to").alias("end"),
                     "owners", "repositories")
             .groupBy("rid").agg(
                 F.collect_set(F.when(F.col("rank").isNotNull(), F.struct("start", "rank", "end"))).alias("added"),
                 F.collect_set(F.struct("start", "end", "owners", "repositories")).alias("ownership")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    out = rows.join(added, "rid", "left").withColumn("added", F.coalesce("added", none))
    base = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))
    label = lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))
    counts = lambda s: F.concat_ws(":", s["start"], s["end"], s["owners"], s["repositories"])
    count = lambda column, kind: F.size(F.filter(
        column, lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *(count("found", k) for k in BASE),
                      *(count("added", k) for k in ("live", "example", "shared")), F.col("base").alias("base_sha256"),
                      F.array_join(F.transform(F.array_sort(F.concat(base, "added")), label), ",").alias("spans"),
                      F.coalesce(F.array_join(F.transform(F.array_sort("ownership"), counts), ","), F.lit("")).alias("ownership"))
