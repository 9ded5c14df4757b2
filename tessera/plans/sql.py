"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string runs on the driver's tables registered as views and must give
the same rows as the matching Spark query; floats are rounded to 6 decimals
on both sides.  The fixed stand-in rules of ``inputs`` appear here again.
"""

from __future__ import annotations

SPLIT_SEED = 200
TEST_SIZE = 0.2


def split_hash_sql(id_expr: str, seed: int = SPLIT_SEED) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT"


def is_test_sql(id_expr: str, test_size: float = TEST_SIZE, seed: int = SPLIT_SEED) -> str:
    return f"({split_hash_sql(id_expr, seed)} / 4294967296.0 < {test_size})"


DOCS_SPLIT = f"""
docs AS (
  SELECT doc_id AS sentence_id, text, lang AS labels, {is_test_sql('doc_id')} AS is_test
  FROM documents),
train AS (SELECT * FROM docs WHERE NOT is_test),
test AS (SELECT * FROM docs WHERE is_test)"""

VOCAB_FROM_TRAIN = """
vocab AS (
  SELECT labels AS label, CAST(row_number() OVER (ORDER BY labels) - 1 AS INTEGER) AS label_id
  FROM (SELECT DISTINCT labels FROM train WHERE labels IS NOT NULL))"""

LABELLED = """
lab AS (
  SELECT d.doc_id AS sentence_id, d.text, d.source AS stype,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'ASSERTIVE'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'EXPRESSIVE'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'OTHER'
              WHEN l.quality = 0 AND l.toxic = 0 THEN 'COMMISSIVE' END AS coarse,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'ASSERT'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'THANK'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'COMPLAIN'
              WHEN l.quality = 0 AND l.toxic = 0 THEN 'PROMISE' END AS fine
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

FINE_RULE = """CASE WHEN fine IN ('DISAGREE', 'APOLOGIZE', 'THANK', 'GREET') THEN 'EXCLUDED'
                    WHEN coarse = 'COMMISSIVE' THEN 'COMMISSIVE' ELSE fine END"""
MERGED_RULE = "CASE WHEN coarse IN ('COMMISSIVE', 'OTHER') THEN 'COMOTH' ELSE coarse END"


def event_prediction_sql(run: str = "0") -> str:
    return (f"CASE WHEN event_id % 10 < 4 + 2 * ({run}) THEN event_type "
            f"WHEN event_id % 10 = 9 THEN 'refund' "
            f"WHEN event_id % 2 = 0 THEN 'view' ELSE 'signup' END")


EVENTS_PRED = f"""
pred AS (
  SELECT event_id AS sentence_id, event_type AS labels, {event_prediction_sql()} AS prediction
  FROM events),
train AS (SELECT labels FROM pred)"""

EVENTS_PRED_RUNS = f"""
pred AS (
  SELECT r.run_id, event_id AS sentence_id, event_type AS labels,
         {event_prediction_sql('r.run_id')} AS prediction
  FROM events, (SELECT unnest([0, 1, 2]) AS run_id) r),
train AS (SELECT event_type AS labels FROM events)"""


def report_sql(ctes: str, by: tuple[str, ...] = ()) -> str:
    """Classification report over CTEs ``pred`` (labels, prediction, by...) and ``vocab``."""
    byc = "".join(f"{b}, " for b in by)
    pby = "".join(f"p.{b}, " for b in by)
    keys = f"(SELECT DISTINCT {', '.join(by)} FROM pred)" if by else "(SELECT 1 AS _one)"
    grp = ", ".join(by)
    grp_by = f"GROUP BY {grp}" if by else ""
    return f"""WITH {ctes},
grid AS (SELECT {'k.' + ', k.'.join(by) + ', ' if by else ''}v.label, v.label_id FROM {keys} k, vocab v),
cnt AS (
  SELECT {pby}v.label,
         count(*) FILTER (WHERE p.labels = v.label AND p.prediction = v.label) AS tp,
         count(*) FILTER (WHERE p.labels = v.label) AS sup,
         count(*) FILTER (WHERE p.prediction = v.label) AS prd
  FROM pred p JOIN vocab v ON p.labels = v.label OR p.prediction = v.label
  GROUP BY {pby}v.label),
pc AS (
  SELECT {'g.' + ', g.'.join(by) + ', ' if by else ''}g.label, g.label_id,
         COALESCE(c.tp, 0) AS tp, COALESCE(c.sup, 0) AS sup, COALESCE(c.prd, 0) AS prd
  FROM grid g LEFT JOIN cnt c ON g.label = c.label {''.join(f' AND g.{b} IS NOT DISTINCT FROM c.{b}' for b in by)}),
m AS (
  SELECT {byc}label, label_id,
         CASE WHEN prd > 0 THEN tp::DOUBLE / prd ELSE 0.0 END AS precision,
         CASE WHEN sup > 0 THEN tp::DOUBLE / sup ELSE 0.0 END AS recall,
         CASE WHEN prd + sup > 0 THEN 2.0 * tp / (prd + sup) ELSE 0.0 END AS f1_score,
         sup AS support
  FROM pc),
nl AS (SELECT count(*) AS k FROM vocab),
acc AS (
  SELECT {byc}avg(CASE WHEN labels = prediction THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n
  FROM pred {grp_by}),
agg AS (
  SELECT {byc}avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf, sum(support) AS s,
         sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1_score * support) AS wf
  FROM m {grp_by})
SELECT {byc}label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support, label_id AS row_order FROM m
UNION ALL
SELECT {byc}'accuracy', round(a, 6), round(a, 6), round(a, 6), CAST(n AS BIGINT),
       CAST((SELECT k FROM nl) + 1 AS INTEGER) FROM acc
UNION ALL
SELECT {byc}'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(s AS BIGINT),
       CAST((SELECT k FROM nl) + 2 AS INTEGER) FROM agg
UNION ALL
SELECT {byc}'weighted avg',
       round(CASE WHEN s > 0 THEN wp / s ELSE 0 END, 6), round(CASE WHEN s > 0 THEN wr / s ELSE 0 END, 6),
       round(CASE WHEN s > 0 THEN wf / s ELSE 0 END, 6), CAST(s AS BIGINT),
       CAST((SELECT k FROM nl) + 3 AS INTEGER) FROM agg"""


def sql_str(pattern: str) -> str:
    """A DuckDB string literal holding ``pattern`` (backslashes are literal there)."""
    return "'" + pattern.replace("'", "''") + "'"
