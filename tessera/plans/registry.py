"""Registered queries: one per operator of the inventory, each with its oracle SQL.

Every query reads the given tables (or tables Spark derives from them) in
full.  Floats are rounded to 6 decimals so the value hashes are stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as H
from ..operators import labels as L
from ..operators import encode as K
from ..operators import models as J
from ..operators import lemmas as RL
from ..operators import pairwise as PW
from ..operators import tfidf as TF
from ..operators import training as E
from ..operators import vectors as V
from ..operators import metrics as M
from ..operators.joins import join_small
from ..operators.partitioning import dealt, spread_if_few
from ..operators.models import majority_label, majority_predict
from ..operators.split import assign_split, assign_split_exact, assign_split_groups, split
from ..session import scratch_path
from ..sources import annotations as A
from ..sources import delimited as D
from ..sources import objects as O
from . import inputs as I
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _report_cols(rep: DataFrame, by=()) -> DataFrame:
    return rep.select(*by, "label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1_score").alias("f1_score"), "support", F.col("row_order").cast("int"))


def text_docs(spark, sf):
    """The documents for CPU-heavy text work: a scan of few splits is spread over the cores."""
    return spread_if_few(I.documents_sentences(spark, sf))


def docs_split(spark, sf):
    return split(I.documents_sentences(spark, sf), 0.2, 200, "sentence_id")


# --------------------------------------------------------------------------- flagship
@register("majority_report", Q.report_sql(
    Q.DOCS_SPLIT + "," + Q.VOCAB_FROM_TRAIN + """,
maj AS (SELECT labels FROM train WHERE labels IS NOT NULL GROUP BY labels
        ORDER BY count(*) DESC, labels LIMIT 1),
pred AS (SELECT t.sentence_id, t.labels, m.labels AS prediction FROM test t, maj m)"""))
def majority_report(spark, sf):
    """documents -> label = lang -> hash split -> majority baseline -> report.

    One count by (split, label) holds all that the vocabulary, the majority
    and the report need; the documents are read once.
    """
    docs = assign_split(I.documents_sentences(spark, sf), 0.2, 200)
    counts = docs.groupBy("is_test", "labels").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    train, test = counts.where(~F.col("is_test")), counts.where("is_test")
    pred = majority_predict(train, test, majority_label(train, weights="n"))
    return _report_cols(M.classification_report(pred, L.label_vocab(train), weights="n"))


# --------------------------------------------------------------------------- A. sources
@register("flatten_conversations", """
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id, turn, role, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t)
SELECT conv_id || '/' || turn || '/' || i AS sentence_id, CAST(conv_id AS VARCHAR) AS group_id,
       CAST(turn AS VARCHAR) AS tweet_id, CAST(i AS VARCHAR) AS sent_id, CAST(i AS INTEGER) AS pos,
       line AS text, role AS stype, role AS coarse, role AS fine
FROM x""")
def flatten_conversations(spark, sf):
    """conversations -> nested annotation JSON text -> from_json -> three posexplodes (A1, A2)."""
    return I.conversation_sentences(spark, sf)


@register("validate_conversations", """
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id, turn, role, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t)
SELECT conv_id || '/' || turn || '/' || i AS sentence_id,
       CASE WHEN line IS NULL THEN 'missing text' WHEN role IS NULL THEN 'missing stype'
            WHEN line = '' THEN 'empty text' END AS problem
FROM x""")
def validate_conversations(spark, sf):
    """Required-field check on the flattened conversations (A3), good and bad rows tagged."""
    s = I.conversation_sentences(spark, sf)
    return s.select("sentence_id", A.problem_column().alias("problem"))


_LINES = """
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id, turn, role, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t),
s AS (SELECT conv_id || '/' || turn || '/' || i AS sentence_id, conv_id, turn, i,
  CASE WHEN i = 0 AND turn % 5 = 2 THEN NULL ELSE line END AS text,
  CASE WHEN i = 0 AND turn % 5 = 3 THEN NULL ELSE role END AS stype,
  CASE role WHEN 'system' THEN 'COMMISSIVE' WHEN 'user' THEN 'ASSERTIVE' ELSE 'OTHER' END AS coarse,
  CASE role WHEN 'system' THEN 'PROMISE' WHEN 'user' THEN 'THANK' ELSE 'SUGGEST' END AS fine FROM x),
p AS (SELECT *, CASE WHEN text IS NULL THEN 'missing text' WHEN stype IS NULL THEN 'missing stype'
  WHEN text = '' THEN 'empty text' END AS problem FROM s)"""


@register("annotation_bad_rows", _LINES + " SELECT sentence_id, problem FROM p WHERE problem IS NOT NULL")
def annotation_bad_rows(spark, sf):
    """Annotation ndjson files with blanked fields -> read -> flatten -> rejected rows with their reasons (A1-A3)."""
    path = scratch_path(spark, "annotations")
    I.marked_annotation_json(spark, sf).write.text(path)
    _, bad = A.validate_sentences(A.flatten_sentences(A.read_annotations(spark, path, "ndjson")), "split")
    return bad.select("sentence_id", "problem")


@register("annotation_broken_records", _LINES + """,
b AS (SELECT DISTINCT conv_id, turn, CASE turn % 7 WHEN 1 THEN 'cut off' WHEN 3 THEN 'an array' WHEN 4 THEN 'two objects'
    WHEN 6 THEN 'one brace too many' END AS how FROM conversations)
SELECT p.sentence_id, p.problem, NULL AS how, true AS has_file, false AS has_record FROM p JOIN b USING (conv_id, turn)
    WHERE how IS NULL AND problem IS NOT NULL
UNION ALL SELECT conv_id || '/' || turn, 'malformed JSON', how, true, true FROM b WHERE how IS NOT NULL""")
def annotation_broken_records(spark, sf):
    """Annotation files with broken lines -> read -> flatten -> two sinks; the bad one read back (A1-A3).

    A malformed record comes back with its text: the ids are read from it.
    """
    path = scratch_path(spark, "annotations")
    I.broken_annotation_json(spark, sf).write.text(path)
    good, bad = f"{path}-good", f"{path}-bad"
    A.write_validated(A.flatten_sentences(A.read_annotations(spark, path, "ndjson")), good, bad)
    record = F.col("source.record")
    turn = F.regexp_extract(record, r'"([^"]*)":\{"(\d+)"', 2)
    how = F.when(record.isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in I.BROKEN_LINES.items() for x in kv]),
                                                  turn.cast("int") % 7))
    return spark.read.parquet(bad).select(
        F.coalesce("sentence_id", F.concat_ws("/", F.regexp_extract(record, r'"([^"]*)":\{"(\d+)"', 1), turn)).alias("sentence_id"),
        "problem", how.alias("how"), F.col("source.file").isNotNull().alias("has_file"), record.isNotNull().alias("has_record"))


@register("annotation_chain", _LINES + f""",
g AS (SELECT sentence_id, text, coarse, fine, CASE WHEN {Q.is_test_sql('sentence_id')} THEN 'test' ELSE 'train' END AS part
  FROM p WHERE problem IS NULL)
SELECT 'coarse' AS scheme, part, text, coarse AS labels FROM g
UNION ALL SELECT 'coarse_merged', part, text, {Q.MERGED_RULE} FROM g
UNION ALL SELECT 'fine', part, text, {Q.FINE_RULE} FROM g""")
def annotation_chain(spark, sf):
    """Annotation files -> flatten -> validate -> each scheme -> split -> TSV -> read back."""
    path = scratch_path(spark, "annotations")
    I.marked_annotation_json(spark, sf).write.text(path)
    good, _ = A.validate_sentences(A.flatten_sentences(A.read_annotations(spark, path, "ndjson")), "split")
    out = None
    for scheme in L.SCHEMES:
        parts = dict(zip(("train", "test"), split(L.label_scheme(good, scheme), 0.2, 200, "sentence_id")))
        for part, rows in parts.items():
            D.write_tsv(rows, f"{path}-{scheme}/{part}")
            back = D.read_tsv(spark, f"{path}-{scheme}/{part}").select(
                F.lit(scheme).alias("scheme"), F.lit(part).alias("part"), "text", "labels")
            out = back if out is None else out.unionByName(back)
    return out


@register("annotation_object_files", """
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id, turn, role, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t)
SELECT conv_id || '/' || turn || '/' || i AS sentence_id, CAST(i AS INTEGER) AS pos, line AS text, role AS stype FROM x""")
def annotation_object_files(spark, sf):
    """Files of one nested object each (of bounded size), read whole and flattened (A1, A2)."""
    path = scratch_path(spark, "annotation-objects")
    I.conversation_objects(spark, sf).write.partitionBy("file").text(path)
    s = A.flatten_sentences(A.read_annotations(spark, f"{path}/file=*", "object"))
    return s.select("sentence_id", "pos", "text", "stype")


@register("annotation_objects_in_splits", ORACLE["annotation_object_files"])
def annotation_objects_in_splits(spark, sf):
    """Files of one nested object each (256 conversations), every file cut into splits of 128 KB (A1, A2)."""
    path = scratch_path(spark, "annotation-objects")
    I.conversation_objects(spark, sf, 256).write.partitionBy("file").text(path)
    s = A.flatten_sentences(O.read_annotation_objects(spark, f"{path}/file=*", split_bytes=1 << 17))
    return s.select("sentence_id", "pos", "text", "stype")


@register("tsv_roundtrip", f"""
SELECT text, lang AS labels, CASE WHEN {Q.is_test_sql('doc_id')} THEN 'test' ELSE 'train' END AS part
FROM documents""")
def tsv_roundtrip(spark, sf):
    """Split documents, write train/test TSV to the shared folder, read them back (A4, A5)."""
    train, test = docs_split(spark, sf)
    base = scratch_path(spark, "splits")
    D.write_tsv(train, f"{base}/train")
    D.write_tsv(test, f"{base}/test")
    return (D.read_tsv(spark, f"{base}/train").withColumn("part", F.lit("train"))
            .unionByName(D.read_tsv(spark, f"{base}/test").withColumn("part", F.lit("test"))))


@register("errors_csv_roundtrip", f"""
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_id, props AS "Text",
       event_type AS "True Label", prediction AS "Prediction"
FROM (SELECT event_id, props, event_type, {Q.event_prediction_sql()} AS prediction FROM events)
WHERE event_type IS DISTINCT FROM prediction""")
def errors_csv_roundtrip(spark, sf):
    """Event errors with text = props (quotes inside) -> error CSV with index -> read back."""
    e = I.table(spark, sf, "events")
    pred = e.select(F.col("event_id").alias("sentence_id"), F.col("props").alias("text"),
                    F.col("event_type").alias("labels"), I.event_prediction_expr(0).alias("prediction"))
    path = scratch_path(spark, "errors")
    D.write_errors(M.error_table(pred), path)
    return D.read_errors(spark, path)


# --------------------------------------------------------------------------- B. label schemes
@register("label_scheme_coarse", "WITH " + Q.LABELLED + "\nSELECT sentence_id, text, coarse AS labels FROM lab")
def label_scheme_coarse(spark, sf):
    return L.label_scheme(I.labelled_sentences(spark, sf), "coarse")


@register("label_scheme_merged",
          "WITH " + Q.LABELLED + f"\nSELECT sentence_id, text, {Q.MERGED_RULE} AS labels FROM lab")
def label_scheme_merged(spark, sf):
    return L.label_scheme(I.labelled_sentences(spark, sf), "coarse_merged")


@register("label_scheme_fine",
          "WITH " + Q.LABELLED + f"\nSELECT sentence_id, text, {Q.FINE_RULE} AS labels FROM lab")
def label_scheme_fine(spark, sf):
    return L.label_scheme(I.labelled_sentences(spark, sf), "fine")


@register("fold_rare_labels", "WITH " + Q.LABELLED + f""",
f AS (SELECT sentence_id, {Q.FINE_RULE} AS labels FROM lab),
c AS (SELECT labels, count(*) AS n FROM f GROUP BY labels)
SELECT f.sentence_id, CASE WHEN c.n < 10 THEN 'EXCLUDED' ELSE f.labels END AS labels
FROM f JOIN c ON f.labels = c.labels""")
def fold_rare_labels(spark, sf):
    """Fine scheme, then labels seen fewer than 10 times become EXCLUDED."""
    fine = L.label_scheme(I.labelled_sentences(spark, sf), "fine").select("sentence_id", "labels")
    return L.fold_rare_labels(fine, 10)


# --------------------------------------------------------------------------- C/D. vocab, counts, lookups
@register("label_vocab", "WITH " + Q.DOCS_SPLIT + "," + Q.VOCAB_FROM_TRAIN + "\nSELECT label, label_id FROM vocab")
def label_vocab(spark, sf):
    train, _ = docs_split(spark, sf)
    return L.label_vocab(train)


@register("label_counts", "WITH " + Q.DOCS_SPLIT + """
SELECT labels AS label, count(*) FILTER (WHERE NOT is_test) AS train,
       count(*) FILTER (WHERE is_test) AS test
FROM docs WHERE labels IS NOT NULL GROUP BY labels HAVING count(*) FILTER (WHERE NOT is_test) > 0""")
def label_counts(spark, sf):
    train, test = docs_split(spark, sf)
    return L.label_counts(train, test)


@register("num_classes", "SELECT count(DISTINCT event_type) AS num_classes FROM events")
def num_classes(spark, sf):
    return L.num_classes(I.event_predictions(spark, sf))


@register("encode_labels", "WITH " + Q.DOCS_SPLIT + "," + Q.VOCAB_FROM_TRAIN + """
SELECT t.sentence_id, t.labels, v.label_id FROM test t JOIN vocab v ON t.labels = v.label""")
def encode_labels(spark, sf):
    train, test = docs_split(spark, sf)
    vocab = L.label_vocab(train)
    return L.encode_labels(test.select("sentence_id", "labels"), vocab)


@register("decode_labels", "WITH " + Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN + """
SELECT p.sentence_id, v.label_id AS prediction_id, v2.label AS prediction
FROM pred p LEFT JOIN vocab v ON p.prediction = v.label LEFT JOIN vocab v2 ON v.label_id = v2.label_id""")
def decode_labels(spark, sf):
    """Predictions -> ids (non-strict) -> labels again; out-of-vocabulary become NULL."""
    pred = I.event_predictions(spark, sf)
    vocab = L.label_vocab(pred)
    ids = L.encode_labels(pred.select("sentence_id", "prediction"), vocab, "prediction",
                          "prediction_id", strict=False).drop("prediction")
    return L.decode_labels(ids, vocab, "prediction_id", "prediction")


@register("unseen_prediction_labels", """
SELECT prediction AS label, count(*) AS n_test FROM (SELECT event_id, event_type,
  """ + Q.event_prediction_sql() + """ AS prediction FROM events) p
WHERE prediction NOT IN (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)
GROUP BY prediction""")
def unseen_prediction_labels(spark, sf):
    """Predicted labels absent from the truth vocabulary."""
    pred = I.event_predictions(spark, sf)
    return L.unseen_labels(pred, pred.select(F.col("prediction").alias("labels")))


# --------------------------------------------------------------------------- D. evaluation on events
_MAJORITY_ERRORS = "WITH " + Q.DOCS_SPLIT + """,
maj AS (SELECT labels FROM train WHERE labels IS NOT NULL GROUP BY labels ORDER BY count(*) DESC, labels LIMIT 1),
pred AS (SELECT t.sentence_id, t.text, t.labels, m.labels AS prediction FROM test t, maj m),
err AS (SELECT * FROM pred WHERE labels IS DISTINCT FROM prediction)"""


def _majority_errors(spark, sf):
    """Majority predictions, as a table of their own, attached to the test sentences; the errors among them."""
    train, test = docs_split(spark, sf)
    predictions = majority_predict(train, test.select("sentence_id"), majority_label(train))
    return train, M.error_table(M.attach_predictions(test, predictions))


@register("errors_table", _MAJORITY_ERRORS + """
SELECT sentence_id, text AS "Text", labels AS "True Label", prediction AS "Prediction" FROM err""")
def errors_table(spark, sf):
    """Misclassified documents with their text, under the export names."""
    return _majority_errors(spark, sf)[1]


@register("majority_errors_csv", _MAJORITY_ERRORS + """
SELECT CAST(row_number() OVER (ORDER BY sentence_id) - 1 AS BIGINT) AS row_id, text AS "Text", labels AS "True Label",
       prediction AS "Prediction" FROM err""")
def majority_errors_csv(spark, sf):
    """Model output -> attached by id -> errors with their text -> error CSV -> read back."""
    path = scratch_path(spark, "majority-errors")
    D.write_errors(_majority_errors(spark, sf)[1], path)
    return D.read_errors(spark, path)


@register("majority_error_confusion", _MAJORITY_ERRORS + "," + Q.VOCAB_FROM_TRAIN + """
SELECT a.label AS true_label, b.label AS pred_label,
       (SELECT count(*) FROM err e WHERE e.labels = a.label AND e.prediction = b.label) AS n FROM vocab a, vocab b""")
def majority_error_confusion(spark, sf):
    """Confusion counts of a saved error CSV, as the saved error analysis does."""
    train, found = _majority_errors(spark, sf)
    path = scratch_path(spark, "majority-errors")
    D.write_errors(found, path)
    return M.confusion(D.read_errors(spark, path), L.label_vocab(train), "True Label", "Prediction")


_CONF_SQL = "WITH " + Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN + """,
cnt AS (SELECT labels, prediction, count(*) AS n FROM {src} GROUP BY ALL)
SELECT a.label AS true_label, b.label AS pred_label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM vocab a, vocab b LEFT JOIN cnt c ON c.labels = a.label AND c.prediction = b.label"""


@register("confusion_long", _CONF_SQL.format(src="pred"))
def confusion_long(spark, sf):
    pred = I.event_predictions(spark, sf)
    return M.confusion(pred, L.label_vocab(pred))


@register("error_confusion", _CONF_SQL.format(src="(SELECT * FROM pred WHERE labels IS DISTINCT FROM prediction)"))
def error_confusion(spark, sf):
    """Confusion counts over errors only, as the saved error analysis does."""
    pred = I.event_predictions(spark, sf)
    return M.confusion(M.errors(pred), L.label_vocab(pred))


@register("error_confusion_no_errors", "WITH " + Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN + """
SELECT a.label AS true_label, b.label AS pred_label, CAST(0 AS BIGINT) AS n FROM vocab a, vocab b""")
def error_confusion_no_errors(spark, sf):
    """Every prediction is right: the confusion counts of the errors are K^2 zeros."""
    pred = I.event_predictions(spark, sf).withColumn("prediction", F.col("labels"))
    return M.confusion(M.errors(pred), L.label_vocab(pred))


@register("confusion_wide", "WITH " + Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN + """
SELECT v.label AS true_label,
""" + ",\n".join(
    f"  CAST(count(*) FILTER (WHERE p.prediction = '{x}') AS BIGINT) AS {x}"
    for x in ["click", "error", "purchase", "signup", "view"]) + """
FROM vocab v LEFT JOIN pred p ON p.labels = v.label GROUP BY v.label""")
def confusion_wide(spark, sf):
    pred = I.event_predictions(spark, sf)
    return M.confusion_matrix(pred, L.label_vocab(pred))


@register("per_class_metrics", "WITH " + Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN + """,
c AS (SELECT v.label, v.label_id,
        count(*) FILTER (WHERE p.labels = v.label AND p.prediction = v.label) AS tp,
        count(*) FILTER (WHERE p.labels = v.label) AS sup,
        count(*) FILTER (WHERE p.prediction = v.label) AS prd
      FROM vocab v LEFT JOIN pred p ON p.labels = v.label OR p.prediction = v.label GROUP BY ALL)
SELECT label, label_id,
       round(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END, 6) AS precision,
       round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall,
       round(CASE WHEN prd + sup > 0 THEN 2.0 * tp / (prd + sup) ELSE 0 END, 6) AS f1_score,
       CAST(sup AS BIGINT) AS support FROM c""")
def per_class_metrics(spark, sf):
    pred = I.event_predictions(spark, sf)
    pc = M.per_class(pred, L.label_vocab(pred))
    return pc.select("label", "label_id", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1_score").alias("f1_score"), "support")


@register("classification_report", Q.report_sql(Q.EVENTS_PRED + "," + Q.VOCAB_FROM_TRAIN))
def classification_report(spark, sf):
    pred = I.event_predictions(spark, sf)
    return _report_cols(M.classification_report(pred, L.label_vocab(pred)))


def _fixed_vocab_sql(rule: str, classes: list[str]) -> str:
    values = ", ".join(f"('{c}', {i})" for i, c in enumerate(classes))
    return Q.report_sql(Q.LABELLED + f""",
f AS (SELECT sentence_id, {rule} AS labels, {Q.is_test_sql('sentence_id')} AS is_test FROM lab),
maj AS (SELECT labels FROM f WHERE NOT is_test AND labels IS NOT NULL GROUP BY labels
        ORDER BY count(*) DESC, labels LIMIT 1),
pred AS (SELECT f.sentence_id, f.labels, m.labels AS prediction FROM f, maj m WHERE f.is_test),
vocab AS (SELECT * FROM (VALUES {values}) v(label, label_id))""")


def _fixed_vocab_report(spark, sf, version: str) -> DataFrame:
    """Majority baseline of a coarse scheme, reported over the scheme's fixed vocabulary (absent classes are zeros)."""
    rows = L.label_scheme(I.labelled_sentences(spark, sf), version).select("sentence_id", "labels")
    train, test = split(rows, 0.2, 200, "sentence_id")
    return _report_cols(M.classification_report(majority_predict(train, test), L.scheme_vocab(spark, version)))


@register("report_coarse_classes", _fixed_vocab_sql("coarse", L.COARSE_CLASSES))
def report_coarse_classes(spark, sf):
    """The report over the six coarse classes."""
    return _fixed_vocab_report(spark, sf, "coarse")


@register("report_merged_classes", _fixed_vocab_sql(
    Q.MERGED_RULE, ["ASSERTIVE", "COMOTH", "DIRECTIVE", "EXPRESSIVE", "UNSURE"]))
def report_merged_classes(spark, sf):
    """The report over the five merged classes."""
    return _fixed_vocab_report(spark, sf, "coarse_merged")


@register("report_by_run", Q.report_sql(Q.EVENTS_PRED_RUNS + "," + Q.VOCAB_FROM_TRAIN, by=("run_id",)))
def report_by_run(spark, sf):
    """One report per run, in one pass."""
    pred = I.event_predictions_runs(spark, sf)
    vocab = L.label_vocab(I.event_predictions(spark, sf))
    return _report_cols(M.classification_report(pred, vocab, by=("run_id",)), by=("run_id",))


_NULL_RUN = Q.EVENTS_PRED_RUNS.replace("r.run_id, event_id", "nullif(r.run_id, 2) AS run_id, event_id")


@register("report_null_run", Q.report_sql(_NULL_RUN + "," + Q.VOCAB_FROM_TRAIN, by=("run_id",)))
def report_null_run(spark, sf):
    """One report per run, one of the runs without an id."""
    pred = I.event_predictions_runs(spark, sf).withColumn("run_id", F.expr("nullif(run_id, 2)"))
    vocab = L.label_vocab(I.event_predictions(spark, sf))
    return _report_cols(M.classification_report(pred, vocab, by=("run_id",)), by=("run_id",))


_SCORE_SQL = "WITH r AS (" + Q.report_sql(Q.EVENTS_PRED_RUNS + "," + Q.VOCAB_FROM_TRAIN, by=("run_id",)) + """),
s AS (SELECT run_id,
        max(f1_score) FILTER (WHERE label = 'macro avg') AS macro_f1,
        max(f1_score) FILTER (WHERE label = 'weighted avg') AS weighted_f1,
        max(f1_score) FILTER (WHERE label = 'accuracy') AS accuracy
      FROM r GROUP BY run_id)"""


@register("score_by_run", _SCORE_SQL + "\nSELECT run_id, macro_f1, weighted_f1, accuracy FROM s")
def score_by_run(spark, sf):
    """Scalar macro / weighted F1 per run."""
    pred = I.event_predictions_runs(spark, sf)
    vocab = L.label_vocab(I.event_predictions(spark, sf))
    s = M.score(pred, vocab, by=("run_id",))
    return s.select("run_id", r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1"),
                    r6("accuracy").alias("accuracy"))


@register("best_run", _SCORE_SQL + "\nSELECT run_id, macro_f1 FROM s ORDER BY macro_f1 DESC, run_id LIMIT 1")
def best_run(spark, sf):
    """Run with the largest macro F1, ties to the smallest run id."""
    pred = I.event_predictions_runs(spark, sf)
    vocab = L.label_vocab(I.event_predictions(spark, sf))
    s = M.score(pred, vocab, by=("run_id",))
    b = M.best_run(s, "macro_f1", ("run_id",))
    return b.select("run_id", r6("macro_f1").alias("macro_f1"))


# --------------------------------------------------------------------------- E. splits
@register("hash_split", f"SELECT doc_id AS sentence_id, {Q.is_test_sql('doc_id')} AS is_test FROM documents")
def hash_split(spark, sf):
    return assign_split(I.documents_sentences(spark, sf), 0.2, 200).select("sentence_id", "is_test")


@register("exact_split", f"""
SELECT sentence_id, rn <= ceil(0.2 * n) AS is_test FROM (
  SELECT doc_id AS sentence_id, row_number() OVER (ORDER BY {Q.split_hash_sql('doc_id')}, doc_id) AS rn,
         count(*) OVER () AS n FROM documents)""")
def exact_split(spark, sf):
    return assign_split_exact(I.documents_sentences(spark, sf), 0.2, 200).select("sentence_id", "is_test")


@register("group_split", f"""
WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id || '/' || turn AS grp, generate_subscripts(l, 1) - 1 AS i FROM t),
g AS (SELECT grp, count(*) AS n FROM x GROUP BY grp),
o AS (SELECT grp, sum(n) OVER (ORDER BY {Q.split_hash_sql('grp')}, grp) - n < ceil(0.2 * sum(n) OVER ()) AS is_test FROM g)
SELECT grp || '/' || i AS sentence_id, is_test FROM x JOIN o USING (grp)""")
def group_split(spark, sf):
    """Sentences split so that a tweet's sentences stay on one side, the test side within one tweet of its size."""
    return assign_split_groups(I.conversation_sentences(spark, sf)).select("sentence_id", "is_test")


# --------------------------------------------------------------------------- J1
@register("majority_fine", "WITH " + Q.LABELLED + f""",
f AS (SELECT sentence_id, {Q.FINE_RULE} AS labels, {Q.is_test_sql('sentence_id')} AS is_test FROM lab),
maj AS (SELECT labels FROM f WHERE NOT is_test AND labels IS NOT NULL GROUP BY labels
        ORDER BY count(*) DESC, labels LIMIT 1)
SELECT f.sentence_id, f.labels, m.labels AS prediction FROM f, maj m WHERE f.is_test""")
def majority_fine(spark, sf):
    """Majority baseline on the fine scheme."""
    fine = L.label_scheme(I.labelled_sentences(spark, sf), "fine").select("sentence_id", "labels")
    train, test = split(fine, 0.2, 200, "sentence_id")
    return majority_predict(train, test)


# --------------------------------------------------------------------------- H. text features
_TOK = Q.sql_str(T.TOKEN_RE)
_PUNCT = Q.sql_str("\\p{P}+")
_EMOJI = Q.sql_str(T.EMOJI_RE)


@register("tokenize", f"SELECT doc_id AS sentence_id, regexp_extract_all(text, {_TOK}) AS tokens FROM documents")
def tokenize(spark, sf):
    """H0 on every document."""
    d = text_docs(spark, sf)
    return d.select("sentence_id", T.tokenize("text").alias("tokens"))


@register("text_features", f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, {_TOK}) AS tok FROM documents)
SELECT doc_id AS sentence_id,
  CAST(len(list_filter(tok, lambda x: regexp_full_match(x, {_PUNCT}))) AS INTEGER) AS punct_count,
  CAST(list_contains(tok, '!') AS INTEGER) AS contains_exclamation,
  CAST(list_contains(tok, '.') AS INTEGER) AS contains_punct_mark,
  CAST(list_contains(tok, '?') AS INTEGER) AS contains_question_mark,
  CAST(contains(text, '#') AS INTEGER) AS contains_hashtag,
  CAST(contains(text, '@') AS INTEGER) AS contains_mention,
  CAST(len(list_filter(tok, lambda x: upper(x) = x AND lower(x) <> x)) AS INTEGER) AS capital_char_count,
  CAST(len(tok) AS INTEGER) AS token_count,
  CAST(length(text) AS INTEGER) AS char_length,
  CAST(len(list_filter(tok, lambda x: regexp_full_match(x, {_EMOJI}))) AS INTEGER) AS emoji_count,
  CAST(len(list_filter(tok, lambda x: regexp_full_match(x, {_EMOJI}))) > 0 AS INTEGER) AS contains_emoji
FROM t""")
def text_features(spark, sf):
    """The 11 features of every document, tokenised once."""
    d = text_docs(spark, sf).select("sentence_id", "text")
    return H.text_features(d).drop("text")


_MARKED = {0: " ?", 1: " \U0001f600 ok", 2: " #tag @you", 3: " \u2764\ufe0f ! ", 4: ""}
_MARKED_SQL = "text || CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _MARKED.items()) + " END"


@register("text_features_marked", ORACLE["text_features"].replace(
    "SELECT doc_id, text, regexp_extract_all(text,",
    f"SELECT doc_id, {_MARKED_SQL} AS text, regexp_extract_all({_MARKED_SQL},"))
def text_features_marked(spark, sf):
    """The 11 features of documents that get a question mark, an emoji or a tag: every flag has hits."""
    d = text_docs(spark, sf).select("sentence_id", "text")
    fifth = F.col("sentence_id") % 5
    mark = F.when(fifth == 0, _MARKED[0]).when(fifth == 1, _MARKED[1]).when(fifth == 2, _MARKED[2]).when(
        fifth == 3, _MARKED[3]).otherwise(_MARKED[4])
    return H.text_features(d.withColumn("text", F.concat("text", mark))).drop("text")


@register("normalize_text", f"""
SELECT doc_id AS sentence_id,
  array_to_string(list_filter(regexp_extract_all(lower(text), {_TOK}),
                              lambda x: NOT regexp_full_match(x, {_PUNCT})), ' ') AS norm_text
FROM documents""")
def normalize_text(spark, sf):
    """Lowercase, drop punctuation tokens, join by one space; identity lemmas."""
    d = text_docs(spark, sf).select("sentence_id", "text")
    return H.normalize_text(d).select("sentence_id", "norm_text")


@register("normalize_lemmas", f"""
WITH d AS (SELECT doc_id, text, {Q.is_test_sql('doc_id')} AS is_test FROM documents),
tk AS (SELECT doc_id, is_test,
              list_filter(regexp_extract_all(lower(text), {_TOK}), lambda x: NOT regexp_full_match(x, {_PUNCT})) AS t
       FROM d),
lem AS (SELECT form, regexp_replace(form, {Q.sql_str(I.LEMMA_SUFFIX_RE)}, '') AS lemma
        FROM (SELECT DISTINCT unnest(t) AS form FROM tk WHERE NOT is_test)),
x AS (SELECT doc_id, unnest(t) AS form, generate_subscripts(t, 1) AS pos FROM tk),
m AS (SELECT x.doc_id, string_agg(COALESCE(lem.lemma, x.form), ' ' ORDER BY x.pos) AS s
      FROM x LEFT JOIN lem ON x.form = lem.form GROUP BY x.doc_id)
SELECT d.doc_id AS sentence_id, COALESCE(m.s, '') AS norm_text FROM d LEFT JOIN m ON d.doc_id = m.doc_id""")
def normalize_lemmas(spark, sf):
    """H14 with a lemma table: every document's tokens mapped through a table derived from train."""
    d = assign_split(text_docs(spark, sf), 0.2, 200)
    lem = I.lemma_table(d.where(~F.col("is_test")))
    return H.normalize_text(d.select("sentence_id", "text"), lemmas=lem).select("sentence_id", "norm_text")


@register("lemmas_unseen", f"""
WITH d AS (SELECT doc_id, text, {Q.is_test_sql('doc_id')} AS is_test FROM documents),
tk AS (SELECT is_test, unnest(list_filter(regexp_extract_all(lower(text), {_TOK}), lambda x: NOT regexp_full_match(x, {_PUNCT}))) AS form
       FROM d),
forms AS (SELECT form, bool_and(is_test) AS unseen FROM tk GROUP BY form),
pairs AS (SELECT form, regexp_replace(form, {Q.sql_str(I.LEMMA_SUFFIX_RE)}, '') AS lemma FROM forms WHERE NOT unseen),
p AS (SELECT form, lemma, len(list_filter(range(1, least(length(form), length(lemma)) + 1),
        lambda i: form[1:i] = lemma[1:i])) AS same FROM pairs WHERE form <> '' AND lemma <> ''),
c AS (SELECT form, lemma, unnest(range(greatest(same - 3, 0), same + 1)) AS cut FROM p),
n AS (SELECT substr(form, cut + 1) AS suffix, substr(lemma, cut + 1) AS replacement, count(*) AS n FROM c GROUP BY ALL),
rules AS (SELECT suffix, arg_min(replacement, (-n, replacement)) AS replacement FROM n GROUP BY suffix),
e AS (SELECT form, unnest(range(0, length(form) + 1)) AS size FROM forms WHERE unseen AND form <> ''),
m AS (SELECT form, size, substr(form, 1, length(form) - size) || replacement AS lemma FROM e
      JOIN rules ON suffix = substr(form, length(form) - size + 1))
SELECT form, arg_max(lemma, size) AS lemma FROM m WHERE lemma <> '' GROUP BY form""")
def lemmas_unseen(spark, sf):
    """Lemmas of the forms that only test documents have, by suffix rewrites learned from the train table."""
    d = assign_split(text_docs(spark, sf), 0.2, 200)
    rules = RL.learn_rules(I.lemma_table(d.where(~F.col("is_test"))))
    toks = T.drop_punct_tokens(T.tokenize(T.lowercase(F.col("text"))))
    forms = d.select("is_test", F.explode(toks).alias("form")).groupBy("form").agg(F.bool_and("is_test").alias("unseen"))
    return RL.lemmatize(forms.where("unseen"), rules)


@register("argmax_scores", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings""")
def argmax_scores(spark, sf):
    """First maximum of each score vector (F2)."""
    e = I.table(spark, sf, "embeddings")
    return e.select("vec_id", T.argmax("embedding").alias("argmax"))


# --------------------------------------------------------------------------- I. TF-IDF
_WORDS = Q.sql_str(T.WORD_SPLIT_RE)
_NORM = (f"array_to_string(list_filter(regexp_extract_all(lower(text), {_TOK}), "
         f"lambda x: NOT regexp_full_match(x, {_PUNCT})), ' ')")
_TF_CTES = f"""
d AS (SELECT doc_id, {_NORM} AS t, {Q.is_test_sql('doc_id')} AS is_test FROM documents),
w AS (SELECT doc_id, is_test, ' ' || unnest(list_filter(regexp_split_to_array(t, {_WORDS}), lambda x: x <> '')) || ' ' AS pw
      FROM d),
wc AS (SELECT doc_id, is_test, pw, count(*) AS c FROM w GROUP BY ALL),
uw AS (SELECT DISTINCT pw FROM wc),
g AS (SELECT pw, substr(pw, i, 1) AS term FROM (SELECT pw, unnest(generate_series(1, length(pw))) AS i FROM uw)
      UNION ALL
      SELECT pw, substr(pw, i, 2) AS term FROM (SELECT pw, unnest(generate_series(1, length(pw) - 1)) AS i FROM uw)),
tf AS (SELECT wc.doc_id, wc.is_test, g.term, sum(wc.c) AS tf FROM wc JOIN g ON wc.pw = g.pw GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM d WHERE NOT is_test),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT n FROM nd)) / (1 + count(*))) + 1 AS idf
        FROM tf WHERE NOT is_test GROUP BY term)"""


def _docs_norm_split(spark, sf):
    d = assign_split(text_docs(spark, sf), 0.2, 200)
    return H.normalize_text(d).select("sentence_id", "norm_text", "is_test")


@register("term_counts", "WITH " + _TF_CTES + "\nSELECT doc_id AS sentence_id, term, CAST(tf AS BIGINT) AS tf FROM tf")
def term_counts(spark, sf):
    """Char 1-2 gram counts per normalized document."""
    d = H.normalize_text(text_docs(spark, sf)).select("sentence_id", "norm_text")
    return TF.term_counts(d)


@register("idf", "WITH " + _TF_CTES + "\nSELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf):
    """Smooth IDF fitted on the train split."""
    idf_df = TF.fit_idf(_docs_norm_split(spark, sf).where(~F.col("is_test")))
    return idf_df.select("term", F.col("df").cast("bigint").alias("df"), r6("idf").alias("idf"))


@register("tfidf", "WITH " + _TF_CTES + """,
x AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term)
SELECT doc_id AS sentence_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf(spark, sf):
    """L2-normalised TF-IDF of train and test documents with the train IDF (I4)."""
    w, _ = TF.fit_transform_tfidf(_docs_norm_split(spark, sf))
    return w.select("sentence_id", "term", r6("weight").alias("weight"))


@register("gram_vocab", "WITH " + _TF_CTES + """
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_index FROM idf""")
def gram_vocab(spark, sf):
    """Train vocabulary sorted by term, dense index."""
    return TF.gram_vocab(TF.fit_idf(_docs_norm_split(spark, sf).where(~F.col("is_test"))))


# --------------------------------------------------------------------------- I5, I6, J. models
def _docs_train_test(spark, sf):
    d = assign_split(text_docs(spark, sf), 0.2, 200)
    train = d.where(~F.col("is_test")).drop("is_test")
    test = d.where(F.col("is_test")).drop("is_test")
    return train, test


def _svm_inputs(spark, sf, with_features: bool):
    base = _svm_base(spark, sf, with_features)
    return _with_features(*base) if with_features else base


def _svm_base(spark, sf, with_features: bool = False):
    """Train vectors with label ids, test vectors, vocabulary, vector column.

    The texts are read once: their n-grams are counted, the 11 text features
    too if asked for, and written without the texts.  The document
    frequencies and the vectors of both splits come from that table.  The train
    vectors, and with features the test vectors, which two runs then read, are
    written too: the many short jobs of a fit then carry no Python stage.
    """
    docs = V.count_grams(assign_split(text_docs(spark, sf), 0.2, 200), "text")
    if with_features:
        docs = H.text_features(docs)
    path = scratch_path(spark, "counted-docs")
    docs = docs.drop("text", "norm_text")
    docs.write.parquet(path)
    docs = spark.read.schema(docs.schema).parquet(path)
    n = {r["is_test"]: r["count"] for r in docs.groupBy("is_test").count().collect()}
    sized = lambda d, t: dealt(d, n.get(t, 0), J.ROWS_PER_TASK)
    train, test = (sized(docs.where(c).drop("is_test"), t) for t, c in ((False, ~F.col("is_test")), (True, F.col("is_test"))))
    vocab = L.label_vocab(train)
    pm = V.fit_tfidf_model(train, "text", "tfidf", counted=True)
    vectors = V.after_counting(pm)

    def written(d, name):
        path = scratch_path(spark, f"svm-{name}")
        d.write.parquet(path)
        return sized(spark.read.schema(d.schema).parquet(path), name == "test")
    trv, tev = (vectors.transform(d).drop("grams", "tf", "tfidf_raw") for d in (train, test))
    trv = written(L.encode_labels(trv, vocab), "train")
    return trv, written(tev, "test") if with_features else tev, vocab, "tfidf"


def _with_features(trv, tev, vocab, col):
    """Append the 11 unscaled text features to the TF-IDF vector."""
    asm = V.assembler(col)
    return asm.transform(trv), asm.transform(tev), vocab, "features"


_TFIDF_ROWS = """,
x AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term)"""


@register("tfidf_vectors", "WITH " + _TF_CTES + _TFIDF_ROWS + """
SELECT doc_id AS sentence_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf_vectors(spark, sf):
    """Train-fitted TF-IDF as sparse ML vectors for every document.

    The vectors are checked entry by entry: each nonzero entry becomes
    ``(sentence_id, term, weight)`` through the model's vocabulary.
    """
    train, test = _docs_train_test(spark, sf)
    pm = V.fit_tfidf_model(train, "text", "tfidf")
    vec = pm.transform(train.unionByName(test)).select("sentence_id", "tfidf")
    e = V.vector_entries(vec, "tfidf", ("sentence_id",))
    e = join_small(e, V.index_names(spark, pm), "index", "inner")
    return e.select("sentence_id", F.col("name").alias("term"), r6("value").alias("weight"))


_FEATURE_SQL = ",\n".join(
    f"  CAST({expr} AS INTEGER) AS {name}" for name, expr in [
        ("punct_count", f"len(list_filter(tok, lambda x: regexp_full_match(x, {_PUNCT})))"),
        ("contains_exclamation", "list_contains(tok, '!')"),
        ("contains_punct_mark", "list_contains(tok, '.')"),
        ("contains_question_mark", "list_contains(tok, '?')"),
        ("contains_hashtag", "contains(text, '#')"),
        ("contains_mention", "contains(text, '@')"),
        ("capital_char_count", "len(list_filter(tok, lambda x: upper(x) = x AND lower(x) <> x))"),
        ("token_count", "len(tok)"),
        ("char_length", "length(text)"),
        ("emoji_count", f"len(list_filter(tok, lambda x: regexp_full_match(x, {_EMOJI})))"),
        ("contains_emoji", f"len(list_filter(tok, lambda x: regexp_full_match(x, {_EMOJI}))) > 0")])


@register("assemble_features", "WITH " + _TF_CTES + _TFIDF_ROWS + f""",
tw AS (SELECT doc_id AS sentence_id, term AS feature,
              round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM x),
t AS (SELECT doc_id, text, regexp_extract_all(text, {_TOK}) AS tok FROM documents),
f AS (SELECT doc_id AS sentence_id,
{_FEATURE_SQL}
      FROM t),
u AS (UNPIVOT f ON {", ".join(H.FEATURE_COLUMNS)} INTO NAME feature VALUE v)
SELECT sentence_id, feature, value FROM tw
UNION ALL
SELECT sentence_id, feature, CAST(v AS DOUBLE) AS value FROM u WHERE v <> 0""")
def assemble_features(spark, sf):
    """TF-IDF vectors joined to the 11 text features on the id and concatenated.

    Checked entry by entry: each nonzero entry of the assembled vector
    becomes ``(sentence_id, feature, value)``, the feature being the n-gram
    or the text feature at that index.
    """
    train, test = _docs_train_test(spark, sf)
    docs = train.unionByName(test)
    pm = V.fit_tfidf_model(train, "text", "tfidf")
    vec = pm.transform(docs).select("sentence_id", "tfidf")
    feats = H.text_features(docs.select("sentence_id", "text"))
    asm = V.assemble(vec, feats).select("sentence_id", "features")
    e = V.vector_entries(asm, "features", ("sentence_id",))
    e = join_small(e, V.index_names(spark, pm, H.FEATURE_COLUMNS), "index", "inner")
    return e.select("sentence_id", F.col("name").alias("feature"), r6("value").alias("value"))


@register("feature_columns", f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, {_TOK}) AS tok FROM documents),
f AS (SELECT doc_id AS sentence_id,
{_FEATURE_SQL}
      FROM t)
SELECT sentence_id, feature, v::BIGINT AS value FROM (UNPIVOT f ON {", ".join(H.FEATURE_COLUMNS)} INTO NAME feature VALUE v)""")
def feature_columns(spark, sf):
    """Every column but id, text and label, chosen by exclusion, as (id, feature, value) rows."""
    wide = H.text_features(text_docs(spark, sf))
    named = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("value")) for c in H.feature_columns(wide)]
    return wide.select("sentence_id", F.explode(F.array(*named)).alias("f")).select("sentence_id", "f.*")


@register("svm_predictions")
def svm_predictions(spark, sf):
    """One-vs-one linear SVM (C = 1) on TF-IDF, test predictions by vote."""
    trv, tev, vocab, col = _svm_inputs(spark, sf, with_features=False)
    model = J.fit_svm(trv, features_col=col)
    pred = L.decode_labels(model.transform(tev), vocab, "prediction_id", "prediction")
    return pred.select("sentence_id", "labels", "prediction")


@register("svm_ablation")
def svm_ablation(spark, sf):
    """Reports of the SVM without and with the 11 features, one pass over both."""
    from concurrent.futures import ThreadPoolExecutor
    # Both runs read the same counts and features.
    base = _svm_base(spark, sf, with_features=True)
    runs = (base, _with_features(*base))
    # The two fits are independent jobs: submit them together, within the same memory.
    room = J.Room(spark)
    with ThreadPoolExecutor(max_workers=len(runs)) as ex:
        models = list(ex.map(lambda r: J.fit_svm(r[0], features_col=r[3], room=room), runs))
    out = []
    for run, ((_, tev, vocab, _), model) in enumerate(zip(runs, models)):
        p = L.decode_labels(model.transform(tev), vocab, "prediction_id", "prediction")
        out.append(p.select(F.lit(run).alias("run_id"), "sentence_id", "labels", "prediction"))
    preds = out[0].unionByName(out[1])
    return _report_cols(M.classification_report(preds, vocab, by=("run_id",)), by=("run_id",))


@register("svm_ablation_support", "WITH " + Q.DOCS_SPLIT + "," + Q.VOCAB_FROM_TRAIN + """,
r AS (SELECT unnest([0, 1]) AS run_id)
SELECT run_id, label, (SELECT count(*) FROM test t WHERE t.labels = v.label) AS support FROM r, vocab v
UNION ALL SELECT run_id, 'accuracy', (SELECT count(*) FROM test) FROM r
UNION ALL SELECT run_id, unnest(['macro avg', 'weighted avg']),
  (SELECT count(*) FROM test t JOIN vocab v ON t.labels = v.label) FROM r""")
def svm_ablation_support(spark, sf):
    """The rows and support counts of the ablation's reports: no test row is lost or doubled in either run."""
    return svm_ablation(spark, sf).select("run_id", "label", "support")


# The reference trains on sentences: here the turns of the conversations, labelled with their role.
_TURNS = "(SELECT conv_id || '/' || turn AS doc_id, text, role FROM conversations)"
_GAP_LIMIT = 0.05


def _turn_weights(docs: DataFrame):
    """TF-IDF of train and test turns as lists, and the IDF."""
    idf = TF.fit_idf(docs.where(~F.col("is_test")))
    return TF.weigh(docs, idf, ("is_test",), lists=True), idf


def _turn_rows(spark, sf, with_features: bool):
    """Rows of train and test turns, as lists: TF-IDF, with the 11 features as further terms; and the vocabulary."""
    turns = assign_split(I.turn_sentences(spark, sf), 0.2, 200)
    vocab = L.label_vocab(turns.where(~F.col("is_test")))
    path = scratch_path(spark, "turn-rows")
    docs = H.normalize_text(turns.select("sentence_id", "text", "is_test")).select("sentence_id", "norm_text", "is_test")
    _turn_weights(docs)[0].write.parquet(path)
    weights = spark.read.parquet(path)
    if with_features:
        wide = H.text_features(turns.select("sentence_id", "is_test", "text"))
        columns = H.feature_columns(wide, ("sentence_id", "is_test", "text"))
        # Counts and lengths as logarithms, small beside the unit-length TF-IDF rows: one step size then fits all terms.
        named = F.array(*[F.struct(F.lit(f"feature:{c}").alias("term"), (F.log(F.col(c) + 1.0) / 32).alias("weight")) for c in columns])
        feats = wide.select("sentence_id", "is_test", F.filter(named, lambda f: f["weight"] != 0).alias("f"))
        weights = weights.unionByName(feats.select("sentence_id", "is_test", F.col("f.term").alias("terms"), F.col("f.weight").alias("values")))
    return [E.list_rows(L.encode_labels(turns.where(F.col("is_test") == test), vocab, strict=False),
                        weights.where(F.col("is_test") == test)) for test in (False, True)] + [vocab]


@register("svm_certified", "WITH c AS (SELECT role, count(*) AS n FROM " + _TURNS + f""" WHERE NOT {Q.is_test_sql('doc_id')}
GROUP BY role) SELECT a.role AS first, b.role AS second, a.n + b.n AS n_rows, true AS certified FROM c a JOIN c b ON a.role < b.role""")
def svm_certified(spark, sf):
    """All pairs' SVMs of the turns in one pass a round; each pair's duality gap is within 5 % of its objective."""
    train, _, vocab = _turn_rows(spark, sf, with_features=False)
    gaps = PW.fit_pairwise(E.as_long(train), tol=_GAP_LIMIT).gaps
    gaps = L.decode_labels(L.decode_labels(gaps, vocab, "first", "_a"), vocab, "second", "_b")
    certified = (F.col("gap") >= -1e-6) & (F.col("gap") <= _GAP_LIMIT * F.col("primal"))
    return gaps.select(F.col("_a").alias("first"), F.col("_b").alias("second"), "n_rows", certified.alias("certified"))


_MARKERS = {0: "qx ", 1: "wz ", 2: "kj "}


@register("svm_separable", f"""
SELECT doc_id AS sentence_id, 'class' || (doc_id % 3) AS labels, 'class' || (doc_id % 3) AS prediction
FROM documents WHERE {Q.is_test_sql('doc_id')}""")
def svm_separable(spark, sf):
    """One-vs-one SVM on texts whose class is written all over them: every prediction must be the label."""
    docs = text_docs(spark, sf)
    third = F.col("sentence_id") % 3
    marker = F.when(third == 0, _MARKERS[0]).when(third == 1, _MARKERS[1]).otherwise(_MARKERS[2])
    # The whole text, then one marker for every four of its characters.
    text = F.coalesce("text", F.lit(""))
    docs = assign_split(docs.select(
        "sentence_id", F.concat(text, F.lit(" "), F.repeat(marker, F.floor(F.length(text) / 4).cast("int") + 1)).alias("text"),
        F.concat(F.lit("class"), third.cast("string")).alias("labels")), 0.2, 200)
    train, test = docs.where(~F.col("is_test")), docs.where("is_test")
    vocab = L.label_vocab(train)
    pm = V.fit_tfidf_model(train, "text", "tfidf")
    model = J.fit_svm(L.encode_labels(pm.transform(train), vocab), features_col="tfidf")
    pred = L.decode_labels(model.transform(pm.transform(test)), vocab, "prediction_id", "prediction")
    return pred.select("sentence_id", "labels", "prediction")


@register("train_select")
def train_select(spark, sf):
    """Grid of logistic regressions on TF-IDF, scored on the test split, best by macro F1."""
    trv, tev, vocab, col = _svm_inputs(spark, sf, with_features=False)
    est, grid = J.lr_grid()
    est.setFeaturesCol(col)
    _, scores, best = J.train_select(trv, tev, vocab, est, grid)
    return scores.select("run_id", r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1"),
                         r6("accuracy").alias("accuracy"), (F.col("run_id") == best).alias("best"))


_SCHEDULE = E.Schedule()


def _epochs_sql(with_features: bool = False) -> str:
    """The epochs of ``_SCHEDULE`` (one full-batch step each) unrolled over the long rows."""
    features = f"""
    UNION ALL SELECT doc.*, 'feature:' || feature, ln(n + 1.0::DOUBLE) / 32 FROM doc JOIN (UNPIVOT (SELECT doc_id,
{_FEATURE_SQL}
        FROM (SELECT doc_id, text, regexp_extract_all(text, {_TOK}) AS tok FROM {_TURNS})) ON {", ".join(H.FEATURE_COLUMNS)}
        INTO NAME feature VALUE n) USING (doc_id) WHERE n <> 0""" if with_features else ""
    out = "WITH " + _TF_CTES.replace("FROM documents)", f"FROM {_TURNS})", 1) + f""",
vocab AS (SELECT role AS label, CAST(row_number() OVER (ORDER BY role) - 1 AS INTEGER) AS label_id
    FROM (SELECT DISTINCT role FROM {_TURNS} WHERE NOT {Q.is_test_sql('doc_id')})),
doc AS (SELECT doc_id, label AS labels, label_id AS y, {Q.is_test_sql('doc_id')} AS is_test FROM {_TURNS} JOIN vocab ON role = label),
xw AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
x AS MATERIALIZED (SELECT doc.*, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM xw JOIN doc USING (doc_id)
    UNION ALL SELECT *, '', 1.0 FROM doc{features}),
n AS (SELECT count(*) AS n FROM doc WHERE NOT is_test),
w0 AS (SELECT '' AS term, 0 AS label_id, 0.0::DOUBLE AS w WHERE false)"""
    for s in range(_SCHEDULE.epochs):
        rate = f"{_SCHEDULE.step_size(s)!r}::DOUBLE"
        out += f""",
z{s} AS MATERIALIZED (SELECT doc_id, c.label_id, any_value(y) AS y, sum(v * coalesce(w, 0)) AS z FROM x CROSS JOIN vocab c
    LEFT JOIN w{s} ON w{s}.term = x.term AND w{s}.label_id = c.label_id WHERE NOT is_test GROUP BY ALL),
e{s} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z{s}),
p{s} AS MATERIALIZED (SELECT doc_id, label_id, e / sum(e) OVER (PARTITION BY doc_id) - (y = label_id)::INT AS p FROM e{s}),
w{s + 1} AS MATERIALIZED (SELECT term, label_id, sum(w) AS w FROM (
    SELECT term, label_id, CASE WHEN term = '' THEN w ELSE w * (1.0::DOUBLE - {rate} * {_SCHEDULE.decay}) END AS w FROM w{s}
    UNION ALL SELECT term, label_id, -{rate} * (sum(v * p) / any_value(n)) FROM x JOIN p{s} USING (doc_id), n GROUP BY ALL)
    GROUP BY ALL)"""
    return out


def _epoch_scores_sql() -> str:
    runs = " UNION ALL ".join(f"SELECT {s} AS epoch, * FROM w{s}" for s in range(1, _SCHEDULE.epochs + 1))
    ctes = _epochs_sql().removeprefix("WITH ") + f""",
ws AS MATERIALIZED ({runs}),
zt AS (SELECT epoch, doc_id, labels, label_id, sum(v * w) AS z FROM x JOIN ws USING (term) WHERE is_test GROUP BY ALL),
pred AS (SELECT epoch, labels, (SELECT label FROM vocab WHERE label_id = best) AS prediction FROM
    (SELECT epoch, labels, arg_max(label_id, (z, -label_id)) AS best FROM zt GROUP BY epoch, doc_id, labels))"""
    return "WITH r AS (" + Q.report_sql(ctes, by=("epoch",)) + """),
s AS (SELECT epoch, max(f1_score) FILTER (label = 'macro avg') AS macro_f1,
    max(f1_score) FILTER (label = 'weighted avg') AS weighted_f1, max(f1_score) FILTER (label = 'accuracy') AS accuracy
    FROM r GROUP BY epoch)
SELECT epoch, macro_f1, weighted_f1, accuracy, epoch = (SELECT epoch FROM s ORDER BY macro_f1 DESC, epoch LIMIT 1) AS best FROM s"""


def _epoch_run(spark, sf, until: int | None = None):
    """The run, the vocabulary, the IDF and the turns."""
    turns = assign_split(I.turn_sentences(spark, sf), 0.2, 200)
    vocab = L.label_vocab(turns.where(~F.col("is_test")))
    docs = H.normalize_text(turns.select("sentence_id", "text", "is_test")).select("sentence_id", "norm_text", "is_test")
    path = scratch_path(spark, "epochs")
    weights, idf = _turn_weights(docs)
    weights.write.parquet(f"{path}/tfidf")
    weights = spark.read.parquet(f"{path}/tfidf")
    parts = [E.list_rows(L.encode_labels(turns.where(F.col("is_test") == test), vocab, strict=False),
                         weights.where(F.col("is_test") == test)) for test in (False, True)]
    return E.train_epochs(*parts, vocab, f"{path}/run", _SCHEDULE, until), vocab, idf, turns


@register("train_epochs", _epoch_scores_sql())
def train_epochs(spark, sf):
    """Ten epochs on the turns' TF-IDF, scored and saved after each; the best by macro F1."""
    run = _epoch_run(spark, sf)[0]
    best = run.best()
    return run.scores().select("epoch", r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1"),
                               r6("accuracy").alias("accuracy"), (F.col("epoch") == best).alias("best"))


@register("train_epochs_weights", _epochs_sql() + f"""
SELECT term, label, round(w, 6) AS weight FROM w{_SCHEDULE.epochs} JOIN vocab USING (label_id)""")
def train_epochs_weights(spark, sf):
    """Every weight of the last epoch, read back from its written table."""
    run, vocab, _, _ = _epoch_run(spark, sf)
    w = run.weights(_SCHEDULE.epochs).select("term", F.posexplode("w").alias("prediction_id", "weight"))
    return L.decode_labels(w, vocab, "prediction_id", "label").select("term", "label", r6("weight").alias("weight"))


def _last_epoch_sql(with_features: bool) -> str:
    return _epochs_sql(with_features) + f""",
zt AS (SELECT doc_id, labels, label_id, sum(v * w) AS z FROM x JOIN w{_SCHEDULE.epochs} USING (term) WHERE is_test GROUP BY ALL)
SELECT labels, (SELECT label FROM vocab WHERE label_id = best) AS prediction FROM
    (SELECT labels, arg_max(label_id, (z, -label_id)) AS best FROM zt GROUP BY doc_id, labels)"""


@register("train_ablation", Q.report_sql(f"""train AS (SELECT role AS labels FROM {_TURNS} WHERE NOT {Q.is_test_sql('doc_id')}),
pred AS (SELECT 0 AS run_id, * FROM ({_last_epoch_sql(False)}) UNION ALL SELECT 1, * FROM ({_last_epoch_sql(True)})),
""" + Q.VOCAB_FROM_TRAIN, by=("run_id",)))
def train_ablation(spark, sf):
    """Reports of the trained classifier without (0) and with (1) the 11 features."""
    from concurrent.futures import ThreadPoolExecutor

    def predicted(run_id: int):
        train, test, vocab = _turn_rows(spark, sf, with_features=bool(run_id))
        run = E.train_epochs(train, test, vocab, scratch_path(spark, "ablation"), _SCHEDULE)
        found = E.predict_lists(test, run.weights(_SCHEDULE.epochs), vocab.count())
        found = L.decode_labels(L.decode_labels(found, vocab), vocab, "label_id", "labels")
        return found.select(F.lit(run_id).alias("run_id"), "labels", "prediction"), vocab

    # The two runs are independent jobs: submit them together.
    with ThreadPoolExecutor(max_workers=2) as ex:
        (without, vocab), (with_features, _) = ex.map(predicted, (0, 1))
    return _report_cols(M.classification_report(without.unionByName(with_features), vocab, by=("run_id",)), by=("run_id",))


@register("score_one_sentence", _epochs_sql() + """,
one AS (SELECT min(doc_id) AS doc_id FROM doc WHERE is_test),
z AS (SELECT doc_id, vocab.label, label_id, sum(v * w) AS z FROM x JOIN one USING (doc_id) JOIN w1 USING (term)
    JOIN vocab USING (label_id) GROUP BY ALL)
SELECT doc_id AS sentence_id, arg_max(label, (z, -label_id)) AS prediction, true AS agrees FROM z GROUP BY doc_id""")
def score_one_sentence(spark, sf):
    """One sentence scored alone, from its raw text, with the saved weights of an epoch; and as it is in the batch."""
    run, vocab, idf, turns = _epoch_run(spark, sf, until=1)
    weights = run.weights(1)
    test = turns.where("is_test").select("sentence_id", "text")
    first = test.agg(F.min_by(F.struct("sentence_id", "text"), "sentence_id").alias("s")).first()["s"]
    one = spark.createDataFrame([(first["sentence_id"], first["text"])], "sentence_id string, text string")

    def scored(rows: DataFrame) -> DataFrame:
        found = TF.weigh(H.normalize_text(rows), idf)
        long = E.long_rows(rows.withColumn("label_id", F.lit(None).cast("int")), found)
        return E.predict_long(long, weights, vocab.count(), weights.count())

    both = scored(one).join(scored(test).select("sentence_id", F.col("prediction_id").alias("batch")), "sentence_id")
    return L.decode_labels(both, vocab).select("sentence_id", "prediction", (F.col("prediction_id") == F.col("batch")).alias("agrees"))


@register("score_saved_model")
def score_saved_model(spark, sf):
    """Fit TF-IDF + logistic regression, save to the shared folder, reload, score the test split."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    train, test = _docs_train_test(spark, sf)
    vocab = L.label_vocab(train)
    # TF-IDF stages from one document-frequency aggregate, then the classifier
    # on the vectors; the fitted stages form one persistable pipeline model.
    pm = V.fit_tfidf_model(train, "text", "tfidf")
    lr = LogisticRegression(featuresCol="tfidf", labelCol="label_id", predictionCol="prediction_id",
                            family="multinomial", maxIter=50, regParam=0.01)
    lrm = J.fit_iterative(lr, L.encode_labels(pm.transform(train), vocab).select("tfidf", "label_id"))
    model = PipelineModel(stages=[*pm.stages, lrm])
    path = scratch_path(spark, "model")
    J.save_model(model, path)
    loaded = J.load_model(path)
    return J.score_batch(loaded, test, vocab).select("sentence_id", "labels", "prediction")


@register("score_saved_model_agreement", "WITH " + Q.DOCS_SPLIT + """
SELECT sentence_id, labels, true AS agrees FROM test""")
def score_saved_model_agreement(spark, sf):
    """The best model of a grid, saved and reloaded, predicts what it predicted in memory."""
    trv, tev, vocab, col = _svm_inputs(spark, sf, with_features=False)
    est, grid = J.lr_grid()
    est.setFeaturesCol(col)
    best, _, _ = J.train_select(trv, tev, vocab, est, grid)
    path = scratch_path(spark, "best-model")
    J.save_model(best, path)
    loaded = J.load_model(path, "classifier")
    again = loaded.copy()
    again.setPredictionCol("again").setRawPredictionCol("raw_again").setProbabilityCol("probability_again")
    both = again.transform(best.transform(tev))
    return both.select("sentence_id", "labels", (F.col("prediction_id") == F.col("again")).alias("agrees"))


_PAIRS = [(i, j) for i in range(64) for j in range(i + 1, 64)]


def _vote_sql(classes: str) -> str:
    """Votes over ``w`` (pairwise winners) of the classes, the first maximum."""
    return (f"SELECT vec_id, ({classes})[list_position(v, list_max(v))] AS prediction_id FROM ("
            f"SELECT vec_id, list_transform({classes}, lambda c: len(list_filter(w, lambda x: x = c))) AS v FROM w)")


@register("ovo_vote", "WITH w AS (SELECT vec_id, [" + ", ".join(
    f"CASE WHEN embedding[{j + 1}]::DOUBLE > embedding[{i + 1}]::DOUBLE + 0.01::DOUBLE THEN {j} ELSE {i} END" for i, j in _PAIRS)
    + "] AS w FROM embeddings) " + _vote_sql("list_transform(range(64), lambda c: c::INTEGER)"))
def ovo_vote(spark, sf):
    """Vote of 64 classes over given pairwise winners: pair (i, j) goes to j when score j beats score i by 0.01."""
    e = I.table(spark, sf, "embeddings")
    emb = F.col("embedding")
    # Winner arrays by first class of the pair: sequence and transform instead of 2,016 columns.
    winners = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(
        F.sequence(i + 1, F.lit(63)), lambda j: F.when(
            F.element_at(emb, j + 1) > F.element_at(emb, i + 1) + 0.01, j).otherwise(i))))
    won = e.select("vec_id", winners.alias("won"))
    return won.select("vec_id", J.ovo_vote("won", list(range(64))).alias("prediction_id"))


# Class ids with gaps: classes that the training rows do not have keep their ids free.
_GAPPED = [0, 2, 3, 7]
_GAP_PAIRS = [(i, j) for n, i in enumerate(_GAPPED) for j in _GAPPED[n + 1:]]


@register("vote_from_margins", "WITH w AS (SELECT vec_id, [" + ", ".join(
    f"CASE WHEN embedding[{j + 1}] - embedding[{i + 1}] > 0 THEN {j} ELSE {i} END" for i, j in _GAP_PAIRS)
    + "] AS w FROM embeddings) " + _vote_sql("[" + ", ".join(f"{c}::INTEGER" for c in _GAPPED) + "]"))
def vote_from_margins(spark, sf):
    """One-vs-one votes from signed pair margins, for class ids with gaps."""
    emb = F.col("embedding")
    winners = F.array(*[F.when(emb[j] - emb[i] > 0, F.lit(j)).otherwise(F.lit(i)) for i, j in _GAP_PAIRS])
    return I.table(spark, sf, "embeddings").select("vec_id", J.ovo_vote(winners, _GAPPED).alias("prediction_id"))


# --------------------------------------------------------------------------- K. encoding, batches
# Sequence length of the encoder the reference fine-tunes (its tokenizer truncates there).
_ENC_LEN = 512
_ENC_CTES = f"""
d AS (SELECT doc_id, regexp_extract_all(text, {_TOK}) AS tok, {Q.is_test_sql('doc_id')} AS is_test FROM documents),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 1 AS INTEGER) AS token_id
      FROM (SELECT DISTINCT unnest(tok) AS token FROM d WHERE NOT is_test)),
x AS (SELECT doc_id, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM d),
e AS (SELECT x.doc_id, list(COALESCE(v.token_id, 1) ORDER BY x.pos) AS ids
      FROM x LEFT JOIN v ON x.token = v.token WHERE x.pos < {_ENC_LEN} GROUP BY x.doc_id),
f AS (SELECT d.doc_id, COALESCE(e.ids, []::INTEGER[]) AS ids FROM d LEFT JOIN e ON d.doc_id = e.doc_id)"""


def _encode_inputs(spark, sf):
    d = assign_split(text_docs(spark, sf), 0.2, 200)
    vocab = K.fit_token_vocab(d.where(~F.col("is_test")))
    return d, vocab


@register("encode_tokens", "WITH " + _ENC_CTES + f"""
SELECT doc_id AS sentence_id,
       list_concat(ids, list_transform(range(greatest({_ENC_LEN} - len(ids), 0)), lambda i: 0)) AS input_ids,
       list_concat(list_transform(ids, lambda i: 1),
                   list_transform(range(greatest({_ENC_LEN} - len(ids), 0)), lambda i: 0)) AS attention_mask
FROM f""")
def encode_tokens(spark, sf):
    """Word ids from the train vocabulary, truncated and padded to 512, with mask (K1)."""
    d, vocab = _encode_inputs(spark, sf)
    return K.encode_tokens(d, vocab, _ENC_LEN).select("sentence_id", "input_ids", "attention_mask")


@register("encode_tokens_batch", "WITH " + _ENC_CTES + f""",
b AS (SELECT doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // 16) AS t FROM f)
SELECT doc_id AS sentence_id,
       list_concat(ids, list_transform(range(greatest(t - len(ids), 0)), lambda i: 0)) AS input_ids,
       list_concat(list_transform(ids, lambda i: 1),
                   list_transform(range(greatest(t - len(ids), 0)), lambda i: 0)) AS attention_mask
FROM b""")
def encode_tokens_batch(spark, sf):
    """As encode_tokens, padded to the longest row of each batch of 16 ids (K2)."""
    d, vocab = _encode_inputs(spark, sf)
    d = d.withColumn("batch", F.floor(F.col("sentence_id") / 16))
    return (K.encode_tokens(d, vocab, _ENC_LEN, pad_to="batch", batch_col="batch")
            .select("sentence_id", "input_ids", "attention_mask"))


def _py_lengths(pdf):
    import pandas as pd
    return pd.DataFrame({"sentence_id": pdf["sentence_id"],
                         "n_chars": pdf["text"].str.len().astype("int64")})


@register("map_batches", "SELECT doc_id AS sentence_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def map_batches(spark, sf):
    """A pandas function over Arrow batches, dropping the label column first (K3)."""
    d = text_docs(spark, sf)
    return K.map_batches(d, _py_lengths, "sentence_id long, n_chars long", drop=("labels",))


# --------------------------------------------------------------------------- L. streaming check
@register("stream_text_features", ORACLE["text_features"])
def stream_text_features(spark, sf):
    """The documents file read as a stream; features written by a checkpointed file sink (H12 on a stream)."""
    from ..streaming.features import stream_text_features as run
    return run(spark, sf)
