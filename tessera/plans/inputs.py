"""Adapters from the driver's parquet tables to the pipeline's tables.

The pipeline works on sentence tables ``(sentence_id, text, labels)`` and on
prediction tables ``(sentence_id, labels, prediction)``.  These functions
derive them from the given tables (parquet scans with column pruning and
filter pushdown), so every query's work grows with the data.

Fixed stand-in rules (the oracle SQL in ``registry`` uses the same):
* documents: sentence_id = doc_id, labels = lang.
* labels joined to documents: coarse from (quality, toxic), fine from
  (quality, toxic), see ``QUALITY_COARSE`` / ``QUALITY_FINE``.
* conversations: group = conv_id, tweet = turn, sentences = lines of text;
  stype = coarse = fine = role.
* events: labels = event_type; prediction = a fixed CASE on event_id.
* lemma table: the distinct normalised tokens of the train documents, each
  mapped to itself with one suffix of ``LEMMA_SUFFIX_RE`` stripped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.annotations import flatten_sentences, parse_annotations, to_annotation_json

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed stand-in label values: (quality, toxic) -> coarse and fine class.
QUALITY_COARSE = {(1, 0): "ASSERTIVE", (1, 1): "EXPRESSIVE", (0, 1): "OTHER", (0, 0): "COMMISSIVE"}
QUALITY_FINE = {(1, 0): "ASSERT", (1, 1): "THANK", (0, 1): "COMPLAIN", (0, 0): "PROMISE"}


# Fixed stand-in lemma rule: strip one of these word endings.
LEMMA_SUFFIX_RE = "(?:en|e|n|s)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a sentence table: ``sentence_id = doc_id``, ``labels = lang``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("sentence_id"), "text", F.col("lang").alias("labels"))


def _pair_case(mapping: dict) -> F.Column:
    c = None
    for (q, t), name in mapping.items():
        cond = (F.col("quality") == q) & (F.col("toxic") == t)
        c = F.when(cond, F.lit(name)) if c is None else c.when(cond, F.lit(name))
    return c


def labelled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to labels: a flattened annotation table with coarse and fine."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "inner")
    return j.select(F.col("doc_id").alias("sentence_id"), "text", F.col("source").alias("stype"),
                    _pair_case(QUALITY_COARSE).alias("coarse"), _pair_case(QUALITY_FINE).alias("fine"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with their text lines as an ordered sentence map (per row, no grouping)."""
    c = table(spark, sf_dir, "conversations")
    lines = F.split(F.col("text"), "\n")
    ids = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i.cast("string"))
    structs = F.transform(lines, lambda x: F.struct(x.alias("text"), F.col("role").alias("stype"),
                                                    F.col("role").alias("coarse"), F.col("role").alias("fine")))
    return c.select("conv_id", "turn", F.map_from_arrays(ids, structs).alias("sentences"))


def turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a sentence table: ``sentence_id = conv_id/turn``, ``labels = role``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("sentence_id"), "text", F.col("role").alias("labels"))


def conversation_annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation ndjson lines built from conversations (column ``value``)."""
    return to_annotation_json(conversation_turns(spark, sf_dir), "conv_id", "turn", "sentences")


# Fixed stand-in label values: role -> coarse and fine class.
ROLE_COARSE = {"system": "COMMISSIVE", "user": "ASSERTIVE", "assistant": "OTHER"}
ROLE_FINE = {"system": "PROMISE", "user": "THANK", "assistant": "SUGGEST"}


def marked_annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``conversation_annotation_json`` with label classes, the first line's text or type blanked in some turns."""
    c = table(spark, sf_dir, "conversations")
    lines = F.split(F.col("text"), "\n")
    first = lambda i, rest: (i == 0) & (F.col("turn") % 5 == rest)
    pick = lambda m: F.when(F.col("role") == "system", m["system"]).when(
        F.col("role") == "user", m["user"]).otherwise(m["assistant"])
    none = F.lit(None).cast("string")
    structs = F.transform(lines, lambda x, i: F.struct(
        F.when(first(i, 2), none).otherwise(x).alias("text"),
        F.when(first(i, 3), none).otherwise(F.col("role")).alias("stype"),
        pick(ROLE_COARSE).alias("coarse"), pick(ROLE_FINE).alias("fine")))
    ids = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i.cast("string"))
    turns = c.select("conv_id", "turn", F.map_from_arrays(ids, structs).alias("sentences"))
    return to_annotation_json(turns, "conv_id", "turn", "sentences")


#: Turns of one conversation, and conversations, that one nested object holds at most.
OBJECT_TURNS, OBJECT_CONVERSATIONS = 64, 16


def conversation_objects(spark: SparkSession, sf_dir: str, conversations: int = OBJECT_CONVERSATIONS) -> DataFrame:
    """(file, value): nested annotation objects of bounded size; a long conversation goes on in further files."""
    turns = conversation_turns(spark, sf_dir).withColumn("chunk", F.floor(F.col("turn") / OBJECT_TURNS))
    convs = turns.groupBy("conv_id", "chunk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("turn").cast("string").alias("turn"), F.struct("sentences").alias("tweet"))),
        lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0))).alias("tweets"))
    file = F.concat_ws("-", F.floor(F.col("conv_id") / conversations), "chunk")
    objects = convs.groupBy(file.alias("file")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), F.col("tweets")))).alias("o"))
    return objects.select("file", F.to_json("o").alias("value"))


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: conversations -> nested JSON text -> parsed -> flattened (A1, A2)."""
    return flatten_sentences(parse_annotations(conversation_annotation_json(spark, sf_dir))).drop("source")


# Fixed stand-in rule: what happens to the line of a turn, by turn % 7.
BROKEN_LINES = {1: "cut off", 3: "an array", 4: "two objects", 6: "one brace too many"}


def broken_annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``marked_annotation_json`` with the lines of some turns broken (rule above)."""
    lines = marked_annotation_json(spark, sf_dir)
    rest = F.regexp_extract("value", r'^\{"[^"]*":\{"(\d+)"', 1).cast("int") % 7
    v = F.col("value")
    broken = (F.when(rest == 1, F.substring(v, F.lit(1), F.length(v) - 2)).when(rest == 3, F.concat(F.lit("["), v, F.lit("]")))
              .when(rest == 4, F.concat(v, F.lit(" "), v)).when(rest == 6, F.concat(v, F.lit("}"))).otherwise(v))
    return lines.select(broken.alias("value"))


def event_prediction_expr(run: F.Column | int = 0) -> F.Column:
    """Fixed prediction rule on events; ``run`` shifts how often it is right."""
    run = F.lit(run) if isinstance(run, int) else run
    m = F.col("event_id") % 10
    return (F.when(m < F.lit(4) + 2 * run, F.col("event_type"))
            .when(m == 9, F.lit("refund"))
            .when(F.col("event_id") % 2 == 0, F.lit("view"))
            .otherwise(F.lit("signup")))


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a prediction table: truth = event_type, prediction = fixed CASE."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sentence_id"), F.col("event_type").alias("labels"),
                    event_prediction_expr(0).alias("prediction"))


def event_predictions_runs(spark: SparkSession, sf_dir: str, runs: int = 3) -> DataFrame:
    """Prediction tables of ``runs`` runs stacked with ``run_id`` (no join: explode)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    r = e.select("event_id", "event_type", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_id"))
    return r.select("run_id", F.col("event_id").alias("sentence_id"), F.col("event_type").alias("labels"),
                    event_prediction_expr(F.col("run_id")).alias("prediction"))


def lemma_table(train: DataFrame, text_col: str = "text") -> DataFrame:
    """``(form, lemma)`` for every distinct normalised train token (stand-in rule above).

    A distinct over the exploded tokens: partial + final aggregate, so a
    frequent word costs one row per map task.
    """
    from ..functions import text as T
    toks = T.drop_punct_tokens(T.tokenize(T.lowercase(F.col(text_col))))
    forms = train.select(F.explode(toks).alias("form")).distinct()
    return forms.select("form", F.regexp_replace("form", LEMMA_SUFFIX_RE, "").alias("lemma"))
