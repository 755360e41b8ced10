"""Registered queries: sources and sinks S01-S25 (round trips through files
written under the session's shared checkpoint folder)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as D
from ..sources import io as S
from ..session import bounded_rows, ensure_checkpoint_dir
from ..sources.tables import table
from . import experiments as X
from .q_core import DISTANT_SQL
from .registry import query, rounded

#: Most columns of a wide table.
MAX_COLUMNS = 10_000


@query("s01_read_or_build", """SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""")
def s01(spark, d):
    c = table(spark, d, "conversations")

    def build():
        return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    # one place for all calls: a second call over the same files reads what the first one built
    return S.read_or_build(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/codeweave-out/prepared-turns", build, [c], "turn counts 1")


def _s04_sql():
    from .q_structure import d12
    import inspect  # noqa: F401
    from .registry import ORACLES
    return ORACLES["d12_d13_record_entries"]


def _s19_sql():
    from .q_aggregate import TURN_SQL
    return f"""WITH {TURN_SQL}
SELECT t.conv_id AS doc_id, t.turn AS segment_id, c.text,
  coalesce(string_agg(CASE WHEN pred THEN label END, ',' ORDER BY label), '') AS label, round(max(score), 6) AS probability
FROM turns t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY t.conv_id, t.turn, c.text"""


S04_SQL = _s04_sql()
S19_SQL = _s19_sql()


def _turns_sql():
    from .q_structure import BODY_SQL, RAW_SQL
    return f"WITH {RAW_SQL}, {BODY_SQL} SELECT id, CAST(turn_no AS INTEGER) AS turn_no, speaker, utterance FROM turns"


@query("s02_s03_transcript_files", _turns_sql())
def s02(spark, d):
    from .q_structure import raw_transcripts
    hdr, turns = D.parse_transcripts(raw_transcripts(spark, d))
    t = turns.join(hdr, "id").select("id", "turn_no", "speaker", "utterance",
                                     F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start"),
                                     F.col("duration_s").cast("string").alias("duration"))
    path = S.scratch_path(spark, "transcripts")
    S.write_transcripts(t, path)
    back = S.read_transcripts(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), "turn_no", "speaker", "utterance")


@query("s04_s05_record_json", S04_SQL)
def s04(spark, d):
    from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
    from .q_structure import patient_rows
    e = D.record_entries(patient_rows(spark, d)).select("id", "entry_no", "date", "gp", "lab_results", "medication")
    path = S.scratch_path(spark, "records")
    S.write_json_by_id(e.withColumn("date", F.date_format("date", "yyyy-MM-dd")), path)
    schema = StructType([StructField("entry_no", LongType()), StructField("date", StringType()),
                         StructField("gp", StringType()), StructField("lab_results", StringType()),
                         StructField("medication", StringType()), StructField("id", LongType())])
    back = S.read_json(spark, path, schema, date_cols=["date"])
    return back.select("id", "entry_no", F.date_format("date", "yyyy-MM-dd").alias("date"), "gp", "lab_results", "medication")


ID_PAT = r"/(\d+)(?:[?#].*)?$"


@query("s06_ids_from_names", f"""SELECT DISTINCT regexp_extract(url, '{ID_PAT}', 1) AS id FROM pages
WHERE regexp_extract(url, '{ID_PAT}', 1) <> ''""")
def s06(spark, d):
    return S.ids_from_names(table(spark, d, "pages"), "url", ID_PAT)


@query("s07_name_filter", """SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https://m.') AND contains(url, '/en/')""")
def s07(spark, d):
    return S.name_filter(table(spark, d, "pages").select("page_id", "url"), "url", "https://m.", "/en/")


@query("s08_read_csv_strings", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR) AS p_size FROM part""")
def s08(spark, d):
    path = S.scratch_path(spark, "vocab_csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size") \
        .write.mode("overwrite").option("header", True).csv(path)
    return S.read_all_string_csv(spark, path)


@query("s09_normalise_headers", """SELECT c_custkey AS customer_key, c_mktsegment AS market_segment FROM customer""")
def s09(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias(" Customer Key"),
                                           F.col("c_mktsegment").alias("Market \t Segment"))
    return S.normalise_headers(c)


@query("s10_matrix_to_links", """SELECT DISTINCT p_type AS topic, upper(left(lower(split_part(p_name, ' ', 1)), 1)) AS code
FROM part""")
def s10(spark, d):
    p = table(spark, d, "part").select("p_type", F.lower(F.split("p_name", " ").getItem(0)).alias("w"))
    words = [r["w"] for r in bounded_rows(p.select("w").distinct().orderBy("w"), MAX_COLUMNS, "matrix columns")]
    wide = p.groupBy("p_type").pivot("w", words).agg(F.lit(1)).withColumn("*", F.lit(1))
    return S.matrix_to_links(wide, "p_type")


@query("s11_wide_codes", """SELECT CAST(max(o_orderkey) AS VARCHAR) AS record_id, o_orderpriority AS code FROM orders
GROUP BY o_orderpriority, o_orderstatus""")
def s11(spark, d):
    o = table(spark, d, "orders")
    wide = (o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"])
            .agg(F.concat(F.max("o_orderkey").cast("string"), F.lit(".0"))))
    return S.wide_codes_to_long(wide, "o_orderpriority")


@query("s12_codes_per_record", """SELECT o_custkey AS record_id, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS codes
FROM orders GROUP BY o_custkey""")
def s12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderpriority").alias("code"))
    c = S.codes_per_record(o)
    return c.select("record_id", F.concat_ws(",", "codes").alias("codes"))


@query("s13_read_chunk_pairs", "SELECT text, CAST(item_id AS VARCHAR) AS label FROM benchmark")
def s13(spark, d):
    b = table(spark, d, "benchmark").select(
        F.to_json(F.array(F.array("text", F.col("item_id").cast("string")))).alias("js"))
    return S.read_nested_pairs(b, "js", ["text", "label"])


@query("s15_json_utf8_roundtrip", "SELECT doc_id, text FROM documents")
def s15(spark, d):
    path = S.scratch_path(spark, "docs_json")
    table(spark, d, "documents").select("doc_id", "text").write.mode("overwrite").json(path)
    return spark.read.schema("doc_id bigint, text string").json(path)


@query("s16_invert_mapping", """SELECT p_type AS topic, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS codes
FROM part GROUP BY p_type""")
def s16(spark, d):
    p = table(spark, d, "part")
    per = p.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("ts"))
    js = per.select(F.to_json(F.create_map("p_brand", "ts")).alias("js"))
    inv = S.invert_mapping(js, "code", "js")
    return inv.select("topic", F.concat_ws(",", "codes").alias("codes"))


S17_SQL = f"""WITH {DISTANT_SQL},
cls AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS k FROM nb_cls),
long AS (SELECT t.id, c.k, CASE WHEN g.id IS NOT NULL THEN 1 ELSE 0 END AS gold, coalesce(sc.score, 0.0) AS pred
  FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN cls c LEFT JOIN tids g ON g.id = t.id AND g.label = c.label
  LEFT JOIN scores sc ON sc.id = t.id AND sc.label = c.label)"""


def _wide(spark, d):
    s = X.distant_setup(spark, d)
    p = X.distant_nb(s)
    classes = [r["label"] for r in bounded_rows(s.desc_w.select(F.col("id").alias("label")).distinct().orderBy("label"), MAX_COLUMNS, "classes")]
    return S.wide_predictions(s.gold, p, s.test_ids, classes), len(classes)


@query("s17_wide_predictions", S17_SQL + """
SELECT id, max(CASE WHEN k = 0 THEN gold END) AS gold_for_class_0, max(CASE WHEN k = 1 THEN gold END) AS gold_for_class_1,
  max(CASE WHEN k = 2 THEN gold END) AS gold_for_class_2, max(CASE WHEN k = 3 THEN gold END) AS gold_for_class_3,
  round(max(CASE WHEN k = 0 THEN pred END), 6) AS predictions_for_class_0,
  round(max(CASE WHEN k = 1 THEN pred END), 6) AS predictions_for_class_1,
  round(max(CASE WHEN k = 2 THEN pred END), 6) AS predictions_for_class_2,
  round(max(CASE WHEN k = 3 THEN pred END), 6) AS predictions_for_class_3 FROM long GROUP BY id""")
def s17(spark, d):
    return rounded(_wide(spark, d)[0])


@query("s18_read_wide_predictions", S17_SQL + """
SELECT id, k AS class, gold, round(pred, 6) AS pred FROM long""")
def s18(spark, d):
    w, n = _wide(spark, d)
    path = S.scratch_path(spark, "wide_pred")
    w.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.schema(w.schema).option("header", True).csv(path)
    return rounded(S.long_predictions(back, n))


@query("s25_strip_class", S17_SQL + """
SELECT id, k AS class, gold, round(pred, 6) AS pred FROM long WHERE k <> 0""")
def s25(spark, d):
    w, n = _wide(spark, d)
    return rounded(S.long_predictions(w, n).filter(F.col("class") != 0))


@query("s19_error_analysis", S19_SQL)
def s19(spark, d):
    t = X.turn_scores(spark, d)
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    cp = t.join(conv, ["conv_id", "turn"]).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment_id"),
                                                  "text", "label", "pred", "score")
    return rounded(S.error_analysis(cp))


@query("s22_nested_export", """SELECT conv_id AS id, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def s22(spark, d):
    c = table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("turn_no"), F.col("role").alias("speaker"),
                     F.col("text").alias("utterance"))
    rec = turns.select("id").distinct()
    n = S.nested_export(rec, turns)
    path = S.scratch_path(spark, "nested")
    n.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", F.size("transcript.conversation").cast("bigint").alias("n_turns"))
