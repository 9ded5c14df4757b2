"""Nested annotation JSON: read, flatten, validate (A1-A3).

Layout of one annotation object (keys are free-form strings):

    { "<group>": { "<tweet>": { "sentences": { "<sentence>":
        { "text": ..., "stype": ..., "coarse": ..., "fine": ... } } } } }

``layout='object'`` reads a whole file as one object (the corpus as
published: one task per file).  ``layout='ndjson'`` reads one such object per
line, which splits across tasks.  ``objects.read_annotation_objects`` reads
the object layout in many tasks.

A record that is not one JSON object (cut off, followed by more text, an
array, a bare value) is no document.  It stays a row, with a NULL ``doc`` and
its text in ``source.record``, so that validation reports it: ``fail`` raises
and ``split`` returns the record with its file and the offset of its split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("stype", T.StringType()),
    T.StructField("coarse", T.StringType()),
    T.StructField("fine", T.StringType()),
])
TWEET_TYPE = T.StructType([T.StructField("sentences", T.MapType(T.StringType(), SENTENCE_TYPE))])
ANNOTATION_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), TWEET_TYPE))

SENTENCE_COLUMNS = ["sentence_id", "group_id", "tweet_id", "sent_id", "pos",
                    "text", "stype", "coarse", "fine"]
REQUIRED = ["text", "stype", "coarse", "fine"]


#: Where a row comes from: its file, the offset of the split that was read, and, of a malformed record, its text.
SOURCE_TYPE = "struct<file:string,offset:bigint,record:string>"


def parse_annotations(df: DataFrame, value_col: str = "value", file: F.Column | None = None,
                      offset: F.Column | None = None) -> DataFrame:
    """Parse a string column of annotation JSON into ``doc`` (NULL: malformed) and ``source`` (A1).

    The record is parsed as the only element of an array of one-field
    objects, because the JSON reader ignores whatever follows a complete
    value: text after the object makes the whole malformed instead.  The
    array's length is only known if its syntax is right to the end; the typed
    reader alone would give up inside a record and keep what it had.
    """
    value = F.col(value_col)
    wrapped = F.concat(F.lit('[{"r":'), value, F.lit("}]"))
    parsed = F.from_json(wrapped, T.ArrayType(T.StructType([T.StructField("r", ANNOTATION_TYPE)])))
    one = F.when(F.json_array_length(wrapped) == 1, F.get(parsed, F.lit(0))["r"])
    none = F.lit(None)
    read = df.select(one.alias("doc"), value.alias("_record"), (file if file is not None else none).cast("string").alias("_file"),
                     (offset if offset is not None else none).cast("bigint").alias("_offset"))
    return read.select("doc", F.struct(
        F.col("_file").alias("file"), F.col("_offset").alias("offset"),
        F.when(F.col("doc").isNull(), F.col("_record")).alias("record")).cast(SOURCE_TYPE).alias("source"))


def read_annotations(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Read annotation JSON files into one ``doc`` map column per object, with its ``source`` (A1).

    Blank files and lines are no records.
    """
    if layout == "object":
        raw = spark.read.text(path, wholetext=True)
    elif layout == "ndjson":
        raw = spark.read.text(path)
    else:
        raise ValueError(f"unknown layout {layout!r}; expected 'object' or 'ndjson'")
    return parse_annotations(raw.where(F.col("value").rlike("\\S")), "value",
                             F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))


def _entries(m: F.Column) -> F.Column:
    """The (key, value) entries of one JSON object; a repeated key has its first position and its last value.

    The JSON reader keeps every entry.  Objects without repeated keys (told by
    one linear pass) are left as they are.
    """
    e = F.map_entries(m)
    keys = F.transform(e, lambda x: x["key"])
    last = F.reverse(e)
    once = F.transform(F.array_distinct(keys), lambda k: F.struct(
        k.alias("key"), F.element_at(last, F.array_position(F.reverse(keys), k).cast("int"))["value"].alias("value")))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), once).otherwise(e)


def _part(name: str) -> F.Column:
    """A key as one part of an id: the separator and the escape character are escaped."""
    return F.replace(F.replace(F.col(name), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def flatten_sentences(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """group -> tweet -> sentence, one row per sentence, in key order (A2).

    ``posexplode_outer`` keeps a tweet without ``sentences`` as a row with a
    NULL ``sent_id``, so that ``validate_sentences`` can report it.
    ``sentence_id`` joins the three keys by ``/``, which is escaped inside
    keys, so different keys never share an id.  The same (group, tweet,
    sentence) on two ndjson lines is two rows with one id.  A malformed
    record (NULL ``doc``) is one row without ids, an object without groups
    none.  ``source`` is carried along if ``docs`` has it.
    """
    keep = ["source"] if "source" in docs.columns else []
    whole = docs.where(F.col(doc_col).isNull() | (F.size(F.col(doc_col)) > 0))
    g = whole.select(*keep, F.posexplode_outer(_entries(F.col(doc_col))).alias("gpos", "g"))
    t = g.select(*keep, F.col("g.key").alias("group_id"),
                 F.posexplode_outer(_entries(F.col("g.value"))).alias("tpos", "t"))
    s = t.select(*keep, "group_id", F.col("t.key").alias("tweet_id"),
                 F.posexplode_outer(_entries(F.col("t.value.sentences"))).alias("pos", "e"))
    s = s.select(*keep, "group_id", "tweet_id", "pos", F.col("e.key").alias("sent_id"), F.col("e.value").alias("s"))
    ident = F.concat_ws("/", _part("group_id"), _part("tweet_id"), _part("sent_id"))
    return s.select(
        F.when(F.col("group_id").isNotNull(), ident).alias("sentence_id"),
        "group_id", "tweet_id", "sent_id", F.col("pos").cast("int").alias("pos"),
        "s.text", "s.stype", "s.coarse", "s.fine", *keep)


def problem_column() -> F.Column:
    """Why a flattened row is unusable, or NULL when it is fine (A3)."""
    c = F.when(F.col("group_id").isNull(), F.lit("malformed JSON"))
    c = c.when(F.col("tweet_id").isNull(), F.lit("missing tweets"))
    c = c.when(F.col("sent_id").isNull(), F.lit("missing sentences"))
    for name in REQUIRED:
        c = c.when(F.col(name).isNull(), F.lit(f"missing {name}"))
    return c.when(F.col("text") == "", F.lit("empty text"))


def validate_sentences(df: DataFrame, mode: str = "fail"):
    """Check required fields (A3).

    ``mode='fail'``: return the rows, raising at execution on the first bad
    row (the filter keeps the check from being pruned away).
    ``mode='split'``: return ``(good, bad)``; ``bad`` has a ``problem`` column
    and, if the rows were read with one, the ``source`` (file, offset, and the
    text of a malformed record).
    """
    problem = problem_column()
    if mode == "fail":
        where = F.lit("")
        if "source" in df.columns:
            where = F.concat(F.lit(" in "), F.coalesce("source.file", F.lit("?")), F.lit(" from offset "),
                             F.coalesce(F.col("source.offset").cast("string"), F.lit("?")), F.lit(": "),
                             F.coalesce(F.substring("source.record", 1, 200), F.lit("")))
        ok = F.when(problem.isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("bad annotation row "), F.coalesce(F.col("sentence_id"), F.lit("?")),
                                   F.lit(": "), problem, where)))
        return df.where(ok)
    if mode == "split":
        tagged = df.withColumn("problem", problem)
        return (tagged.where(F.col("problem").isNull()).drop("problem"),
                tagged.where(F.col("problem").isNotNull()))
    raise ValueError(f"unknown mode {mode!r}; expected 'fail' or 'split'")


def write_validated(df: DataFrame, good_path: str, bad_path: str) -> None:
    """Write good rows to one folder and bad ones, with problem and source, to another (A3); both as Parquet."""
    good, bad = validate_sentences(df, "split")
    good.drop("source").write.mode("overwrite").parquet(good_path)
    bad.write.mode("overwrite").parquet(bad_path)


def to_annotation_json(df: DataFrame, group_col: str, tweet_col: str, sentences_col: str) -> DataFrame:
    """One ndjson line per (group, tweet) row: the nested object holding its sentences.

    ``sentences_col`` is a ``map<string, struct<text,stype,coarse,fine>>`` in
    sentence order.  The inverse of ``flatten_sentences`` for the ndjson
    layout; no grouping is needed because the reader merges nothing across
    lines.
    """
    tweet = F.struct(F.col(sentences_col).alias("sentences"))
    obj = F.create_map(F.col(group_col).cast("string"),
                       F.create_map(F.col(tweet_col).cast("string"), tweet))
    return df.select(F.to_json(obj).alias("value"))
