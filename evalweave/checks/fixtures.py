"""Views that give the given tables the shapes of our records.

Every view covers whole tables and grows with them. The text is valid in Spark SQL and
DuckDB alike, except for row expansion, which ``six_runs`` writes per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK, DUCK = "spark", "duck"


def six_runs(dialect: str) -> str:
    """Rows r = 0..5 beside every document."""
    if dialect == SPARK:
        return "documents LATERAL VIEW explode(sequence(0, 5)) t AS r"
    return "documents, unnest(range(6)) AS t(r)"


def padded(n: str, prefix: str) -> str:
    text = f"CAST({n} AS STRING)"
    return f"concat('{prefix}', lpad({text}, greatest(4, CAST(length({text}) AS INT)), '0'))"


def entries(dialect: str = SPARK) -> str:
    return f"""
SELECT doc_id AS ord, {padded('doc_id + 1', 'alt_')} AS id,
       CASE WHEN doc_id % 53 = 3 AND doc_id % 5 <> 0 THEN ''
            ELSE concat('orig_', CAST(doc_id - doc_id % 5 AS STRING)) END AS original_riddle,
       concat('ans ', source) AS original_answer,
       text AS altered_riddle,
       concat('alt ', lang, ' ', CAST(doc_id % 7 AS STRING)) AS altered_answer,
       CASE WHEN doc_id % 23 = 7 THEN NULL
            WHEN doc_id % 4 = 0 THEN 'constraint_addition' WHEN doc_id % 4 = 1 THEN 'meaning_shift'
            WHEN doc_id % 4 = 2 THEN 'context_swap' ELSE 'bias_probe' END AS type,
       CASE WHEN doc_id % 3 = 0 THEN 'fixed' ELSE 'auxiliary' END AS set_name
FROM documents"""


def samples(dialect: str = SPARK) -> str:
    """Samples: every run answers every document once, first documents of a cluster also in the
    original; every event adds one more sample. Run 2 lacks some items."""
    return f"""
SELECT doc_id * 16 + r * 2 AS ord, CAST(r AS BIGINT) AS r, doc_id AS n, TRUE AS alt,
       (n_chars + doc_id * 7 + r * 3) % 30 AS z, 0 AS extra
FROM {six_runs(dialect)} WHERE NOT (r = 2 AND doc_id % 97 = 13)
UNION ALL
SELECT doc_id * 16 + r * 2 + 1, CAST(r AS BIGINT), doc_id, FALSE, (n_chars * 3 + doc_id + r * 11) % 30, 0
FROM {six_runs(dialect)} WHERE doc_id % 5 = 0
UNION ALL
SELECT 1099511627776 + event_id, r, CASE WHEN alt THEN m ELSE m - m % 5 END, alt, z, 1
FROM (SELECT event_id, user_id % 6 AS r, event_type <> 'signup' AS alt,
             event_id * 7919 % (SELECT count(*) FROM documents) AS m,
             CAST(round(value * 100) AS BIGINT) % 30 AS z
      FROM events) v
WHERE NOT (r = 2 AND m % 97 = 13 AND alt)"""


CORRECT = "CASE WHEN alt THEN z % 10 < 1 + r ELSE z % 10 < 8 END"
GAVE = "(alt AND z % 10 >= 1 + r AND z % 3 = 0)"


def outputs(dialect: str = SPARK) -> str:
    """Model outputs; some samples belong to items that do not exist.

    For Spark the samples of events are numbered alone, before any text is made.
    """
    place, numbered = "row_number() OVER (PARTITION BY r, n, alt, extra ORDER BY ord)", samples(dialect)
    if dialect == SPARK:
        # The first column leads the sort, and items differ more than runs.
        numbered = f"""
SELECT *, row_number() OVER (PARTITION BY n, r, alt ORDER BY ord) AS place FROM ({numbered}) e WHERE extra = 1
UNION ALL
SELECT *, 0 FROM ({numbered}) d WHERE extra = 0"""
        place = "place"
    return f"""
SELECT ord, concat('run_', CAST(r AS STRING)) AS run_id, concat('org/model-', CAST(r % 4 AS STRING)) AS model,
       'acme' AS provider, CASE WHEN r % 2 = 0 THEN 'q8' END AS quantization,
       CASE WHEN extra = 1 AND z = 29 THEN concat('gone_', CAST(n AS STRING))
            ELSE {padded('n + 1', 'alt_')} END AS riddle_id,
       CASE WHEN alt THEN 'altered' ELSE 'original' END AS riddle_type,
       CAST(CASE WHEN extra = 0 THEN CASE WHEN n % 11 = 3 THEN 2 ELSE 1 END
                 ELSE 2 + {place} END AS INT) AS sample_index,
       CASE WHEN z = 13 THEN '' ELSE concat('answer ', CAST(z AS STRING)) END AS model_answer,
       concat('text ', CAST(n AS STRING)) AS riddle_text,
       r >= 3 AS reasoning_enabled, CASE WHEN r >= 3 THEN 'high' END AS reasoning_effort,
       50 + n % 100 AS input_tokens,
       CASE WHEN z % 17 <> 0 THEN z * 10 + r END AS output_tokens,
       {CORRECT} AS correct_flag, {GAVE} AS gave_flag, z
FROM ({numbered}) s"""


def details(dialect: str = SPARK) -> str:
    """Evaluated samples of known items."""
    return f"""
SELECT ord, run_id, riddle_id, riddle_type, sample_index, correct_flag AS correct,
       CASE WHEN riddle_type = 'altered' THEN gave_flag END AS gave_original_answer
FROM ({outputs(dialect)}) o WHERE riddle_id LIKE 'alt%'"""


def judgments(dialect: str = SPARK) -> str:
    """Verdicts: none for z = 28, and a second, opposite one for some samples.

    Spark reads the outputs once for both.
    """
    if dialect == SPARK:
        return f"""
SELECT CASE WHEN again THEN ord + 1125899906842624 ELSE ord END AS ord, run_id, riddle_id, riddle_type, sample_index,
       CASE WHEN again THEN NOT correct_flag ELSE correct_flag END AS correct,
       CASE WHEN again THEN FALSE ELSE gave_flag END AS gave_original,
       CASE WHEN again THEN FALSE ELSE z % 7 = 0 END AS competing
FROM ({outputs(dialect)}) o LATERAL VIEW explode(array(FALSE, TRUE)) t AS again
WHERE CASE WHEN again THEN z % 9 = 4 ELSE z <> 28 END"""
    return f"""
SELECT ord, run_id, riddle_id, riddle_type, sample_index,
       correct_flag AS correct, gave_flag AS gave_original, z % 7 = 0 AS competing
FROM ({outputs(dialect)}) o WHERE z <> 28
UNION ALL
SELECT ord + 1125899906842624, run_id, riddle_id, riddle_type, sample_index,
       NOT correct_flag, FALSE, FALSE
FROM ({outputs(dialect)}) o WHERE z % 9 = 4"""


def runs(dialect: str = SPARK) -> str:
    return f"""
SELECT run_id, min(ord) AS run_ord, min(model) AS model, bool_or(reasoning_enabled) AS reasoning_enabled,
       min(reasoning_effort) AS reasoning_effort
FROM ({outputs(dialect)}) o GROUP BY run_id"""


def pool(dialect: str = SPARK) -> str:
    """Pool items of six families over one original per eight documents."""
    return """
SELECT doc_id AS ord, concat('pool_', CAST(doc_id AS STRING)) AS id,
       CASE doc_id % 6 WHEN 0 THEN 'openai/gpt-a' WHEN 1 THEN 'Gemini-b' WHEN 2 THEN 'qwen/q-c'
                       WHEN 3 THEN 'glm-d' WHEN 4 THEN '' ELSE 'acme/x' END AS source,
       CASE WHEN doc_id % 31 = 5 THEN ' ' ELSE
            concat(CASE WHEN doc_id % 2 = 0 THEN 'Orig_' ELSE ' orig_' END,
                   CAST((n_chars + doc_id * 13) % (SELECT CAST(floor(count(*) / 8.0) AS BIGINT) FROM documents) AS STRING))
       END AS original_riddle,
       text AS altered_riddle,
       CASE WHEN doc_id % 11 = 0 THEN TRUE WHEN doc_id % 11 = 1 THEN NULL ELSE FALSE END AS used_in_set,
       CASE WHEN doc_id % 11 = 0 THEN 'benchmark' END AS used_set
FROM documents"""


def validated(dialect: str = SPARK) -> str:
    """Validated items with a review flag from the labels, where there is one."""
    return f"""
SELECT d.doc_id AS ord, {padded('d.doc_id', 'val_')} AS id,
       concat('orig ', CAST(d.doc_id % 50 AS STRING)) AS original_riddle,
       CASE WHEN d.doc_id % 41 = 7 THEN '' ELSE d.text END AS altered_riddle,
       concat('answer ', d.lang) AS altered_answer,
       l.quality = 0 AS needs_review,
       d.doc_id % 4 AS n_accepted,
       CASE WHEN d.doc_id % 9 = 0 THEN FALSE WHEN d.doc_id % 9 < 5 THEN TRUE END AS dedup_retained
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def sanity_answers(dialect: str = SPARK) -> str:
    """Answers of nine solvers; keys repeat, and some answers are empty."""
    return """
SELECT event_id AS ord, concat('solver_', CAST(user_id % 9 AS STRING)) AS solver,
       user_id % 9 AS solver_ord, k AS riddle_idx,
       concat('riddle ', CAST(k AS STRING), ' v', CAST(event_id % 3 AS STRING)) AS riddle,
       concat('expected ', CAST(k AS STRING)) AS expected_answer,
       CASE WHEN cents % 13 = 0 THEN '' ELSE concat('a', CAST(cents AS STRING)) END AS model_answer,
       cents
FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e"""


def responses(dialect: str = SPARK) -> str:
    """Replies in five shapes: fenced object, bare object, plain text, empty, list."""
    quoted = "concat('\"', source, ' ', CAST(doc_id AS STRING), '\"')"
    return f"""
SELECT doc_id AS ord, doc_id, source,
       CASE doc_id % 5
         WHEN 0 THEN concat('```json', chr(10), '{{"answer": ', {quoted}, ', "reasoning": " why "}}', chr(10), '```')
         WHEN 1 THEN concat(' {{"answer": ', CAST(doc_id AS STRING), ', "correct": ',
                            CASE doc_id % 3 WHEN 0 THEN '"false"' WHEN 1 THEN '0' ELSE 'true' END,
                            ', "gave_original": [', CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '' END, ']}} ')
         WHEN 2 THEN text
         WHEN 3 THEN ''
         ELSE concat('[', CAST(doc_id AS STRING), ']') END AS raw,
       CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error
FROM documents"""


VIEWS = {
    f.__name__: f
    for f in (
        entries, samples, outputs, details, judgments, runs, pool, validated, sanity_answers, responses,
    )
}


class Fixtures:
    """The views as DataFrames over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def query(self, sql: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.query(VIEWS[name](SPARK))


def with_views(*names: str) -> str:
    """A WITH clause of the named views for DuckDB."""
    return "WITH " + ",\n".join(f"fx_{n} AS ({VIEWS[n](DUCK)})" for n in names)
