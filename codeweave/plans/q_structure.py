"""Registered queries: transcript and record structuring D01-D18.

Raw transcripts are synthesised by Spark from ``conversations`` (one per
conv_id): header lines derived from the id and turn count, then one
``Role: text`` line per turn whose internal newlines become continuation
lines; ', ' is turned into a ' [pause] ' info span and, in assistant turns, a
sentence end before a newline into an unclosed '[' so every bracket rule and the
same-speaker merge fire on real text.
Patient tables are synthesised from orders (entries) and lineitem (headings).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import stopword_list
from ..operators import structure as D
from ..sources.tables import table
from .registry import query
from .sqlkit import stop_sql

ROLE_SQL = "CASE role WHEN 'user' THEN 'Patient' WHEN 'assistant' THEN 'GP' ELSE 'Info' END"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _role(c):
    return F.when(c == "user", "Patient").when(c == "assistant", "GP").otherwise("Info")


def raw_transcripts(spark, d):
    c = table(spark, d, "conversations")
    pause = F.replace("text", F.lit(", "), F.lit(" [pause] "))
    inj = F.when(F.col("role") == "assistant", F.replace(pause, F.lit(".\n"), F.lit(". [\n"))).otherwise(pause)
    lines = c.select("conv_id", "turn", F.concat(_role(F.col("role")), F.lit(": "), inj).alias("line"))
    g = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("_t"),
                                     F.count(F.lit(1)).alias("_n"))
    cid = F.col("conv_id")
    hdr = F.concat_ws("\n",
                      F.concat(F.lit("Date: "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), cid.cast("int")), "dd-MM-yy")),
                      F.concat(F.lit("Time: "), F.lpad((cid % 24).cast("string"), 2, "0"), F.lit(":"),
                               F.lpad((cid % 60).cast("string"), 2, "0")),
                      F.concat(F.lit("Duration: "), F.col("_n").cast("string"), F.lit(":"),
                               F.lpad((cid % 60).cast("string"), 2, "0")),
                      F.concat(F.lit("ID: "), cid.cast("string")))
    return g.select(cid.alias("id"), F.concat_ws("\n", hdr, F.concat_ws("\n", F.transform("_t", lambda e: e["line"]))).alias("raw"))


RAW_SQL = f"""raw AS (
  SELECT conv_id AS id, concat_ws(chr(10),
    'Date: ' || strftime(DATE '2024-01-01' + CAST(conv_id AS INTEGER), '%d-%m-%y'),
    'Time: ' || lpad(CAST(conv_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0'),
    'Duration: ' || CAST(count(*) AS VARCHAR) || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0'),
    'ID: ' || CAST(conv_id AS VARCHAR),
    string_agg({ROLE_SQL} || ': ' || CASE WHEN role = 'assistant'
      THEN replace(replace(text, ', ', ' [pause] '), '.' || chr(10), '. [' || chr(10))
      ELSE replace(text, ', ', ' [pause] ') END,
               chr(10) ORDER BY turn)) AS raw
  FROM conversations GROUP BY conv_id),
ll AS (SELECT id, list_filter(string_split(replace(raw, chr(13) || chr(10), chr(10)), chr(10)), lambda x: len(x) > 0) AS l
  FROM raw)"""

HEADER_PARTS_SQL = f"""hd AS (SELECT id,
  regexp_replace({STRIP.format(x="replace(replace(l[1], 'Date:', ''), 'File:', '')")}, '[^0-9]', '', 'g') AS d0,
  {STRIP.format(x="replace(l[2], 'Time:', '')")} AS t0,
  string_split({STRIP.format(x="replace(l[3], 'Duration:', '')")}, ':') AS du,
  l[4] AS idl FROM ll),
hp AS (SELECT id, d0, t0, du, idl,
  CASE WHEN len(d0) = 6 THEN '20' || substring(d0, 5, 2) || substring(d0, 3, 2) || substring(d0, 1, 2) ELSE d0 END AS d1,
  CASE WHEN len(t0) <> 6 AND contains(t0, ':') THEN lpad(CAST(TRY_CAST(replace(t0, ':', '') AS BIGINT) AS VARCHAR), 6, '0')
       WHEN len(t0) = 5 THEN substring(t0, 1, 4) || '0' || substring(t0, 5, 1) ELSE t0 END AS t1 FROM hd),
hq AS (SELECT id, CASE WHEN len(d1) = 8 THEN d1 END AS date8, CASE WHEN len(t1) = 6 THEN t1 END AS time6, du, idl FROM hp)"""

BODY_SQL = f"""body AS (SELECT id, pos - 4 AS line_no, line FROM (
  SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM ll) WHERE pos >= 4),
sp0 AS (SELECT id, line_no, {STRIP.format(x='line')} AS s FROM body),
sp1 AS (SELECT id, line_no, s, instr(s, ':') AS ci FROM sp0),
sp2 AS (SELECT id, line_no,
  CASE WHEN ci > 0 AND regexp_matches(substring(s, 1, ci - 1), '\\p{{L}}') THEN {STRIP.format(x='substring(s, 1, ci - 1)')} END AS new_sp,
  CASE WHEN ci > 0 AND regexp_matches(substring(s, 1, ci - 1), '\\p{{L}}') THEN {STRIP.format(x='substring(s, ci + 1)')}
       ELSE s END AS content FROM sp1),
sp AS (SELECT id, line_no, content, last_value(new_sp IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker FROM sp2),
st AS (SELECT id, line_no, speaker, generate_subscripts(m, 1) AS k, unnest(m) AS m FROM (
  SELECT id, line_no, speaker, regexp_extract_all({STRIP.format(x='content')}, '{D.BRACKET_STEP}') AS m FROM sp)),
st2 AS (SELECT *, instr(m, '[') AS lb, ends_with(m, ']') AS closes FROM st),
pp AS (
  SELECT id, line_no, k, 0 AS sub, 'info' AS speaker, substring(m, 1, len(m) - 1) AS text FROM st2 WHERE closes AND lb = 0
  UNION ALL SELECT id, line_no, k, 0, speaker, substring(m, 1, lb - 1) FROM st2 WHERE lb > 1
  UNION ALL SELECT id, line_no, k, 1, 'info', CASE WHEN closes THEN substring(m, lb + 1, len(m) - lb - 1)
                                                  ELSE substring(m, lb + 1) END FROM st2 WHERE lb > 0
  UNION ALL SELECT id, line_no, k, 0, speaker, m FROM st2 WHERE lb = 0 AND NOT closes AND len(m) > 1),
parts AS (SELECT id, line_no, row_number() OVER (PARTITION BY id, line_no ORDER BY k, sub) - 1 AS part_no, speaker, text
  FROM pp),
mg AS (SELECT *, CASE WHEN part_no = 0 AND lag(line_no) OVER w IS NOT NULL
                      AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w THEN 0 ELSE 1 END AS st
  FROM parts WINDOW w AS (PARTITION BY id ORDER BY line_no, part_no)),
mt AS (SELECT *, sum(st) OVER (PARTITION BY id ORDER BY line_no, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
  AS turn_no FROM mg),
turns AS (SELECT id, CAST(turn_no AS BIGINT) AS turn_no, max(speaker) AS speaker,
  string_agg(text, ' ' ORDER BY line_no, part_no) AS utterance FROM mt GROUP BY id, turn_no)"""


def _lines(spark, d):
    r = raw_transcripts(spark, d)
    return r.select("id", D.nonempty_lines("raw").alias("l"))


@query("d01_nonempty_lines", f"""WITH {RAW_SQL}
SELECT id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line FROM ll""")
def d01(spark, d):
    return _lines(spark, d).select("id", F.posexplode("l").alias("line_no", "line")).select(
        "id", F.col("line_no").cast("bigint"), "line")


@query("d02_d06_header_fields", f"""WITH {RAW_SQL}, {HEADER_PARTS_SQL}
SELECT id, date8, time6,
  strftime(coalesce(try_strptime(date8 || time6, '%Y%m%d%H%M%S'), try_strptime(date8, '%Y%m%d')), '%Y-%m-%d %H:%M:%S') AS start_ts,
  CASE WHEN len(du) = 3 THEN TRY_CAST(du[1] AS BIGINT) * 3600 + TRY_CAST(du[2] AS BIGINT) * 60 + TRY_CAST(du[3] AS BIGINT)
       WHEN len(du) = 2 THEN TRY_CAST(du[1] AS BIGINT) * 60 + TRY_CAST(du[2] AS BIGINT) END AS duration_s,
  CASE WHEN contains(idl, 'ID') THEN {STRIP.format(x="replace(idl, 'ID:', '')")}
       WHEN contains(idl, 'Date') THEN {STRIP.format(x="replace(idl, 'Date:', '')")} END AS record_id
FROM hq""")
def d02(spark, d):
    l = _lines(spark, d)
    g = lambda i: F.get(F.col("l"), i)
    h = l.select("id", D.parse_date(g(0)).alias("date8"), D.parse_time(g(1)).alias("time6"),
                 D.duration_seconds(g(2)).alias("duration_s"), D.record_id(g(3)).alias("record_id"))
    return h.select("id", "date8", "time6",
                    F.date_format(D.start_timestamp("date8", "time6"), "yyyy-MM-dd HH:mm:ss").alias("start_ts"),
                    "duration_s", "record_id")


EVENTS_HDR = """SELECT event_id,
  CASE WHEN len(d0) = 6 THEN '20' || substring(d0, 5, 2) || substring(d0, 3, 2) || substring(d0, 1, 2) ELSE d0 END AS d1,
  CASE WHEN len(t0) <> 6 AND contains(t0, ':') THEN lpad(CAST(TRY_CAST(replace(t0, ':', '') AS BIGINT) AS VARCHAR), 6, '0')
       WHEN len(t0) = 5 THEN substring(t0, 1, 4) || '0' || substring(t0, 5, 1) ELSE t0 END AS t1
FROM (SELECT event_id, regexp_replace(strftime(ts, '%d-%m-%y'), '[^0-9]', '', 'g') AS d0,
             CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M') WHEN event_id % 3 = 1 THEN strftime(ts, '%H%M%S')
                  ELSE substring(strftime(ts, '%H%M%S'), 1, 5) END AS t0 FROM events)"""


def _events_header(spark, d):
    e = table(spark, d, "events")
    t0 = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "HH:mm"))
          .when(F.col("event_id") % 3 == 1, F.date_format("ts", "HHmmss"))
          .otherwise(F.substring(F.date_format("ts", "HHmmss"), 1, 5)))
    return e.select("event_id", F.concat(F.lit("Date: "), F.date_format("ts", "dd-MM-yy")).alias("dl"),
                    F.concat(F.lit("Time: "), t0).alias("tl"))


@query("d04_event_start_timestamps", f"""WITH h AS ({EVENTS_HDR}),
q AS (SELECT event_id, CASE WHEN len(d1) = 8 THEN d1 END AS date8, CASE WHEN len(t1) = 6 THEN t1 END AS time6 FROM h)
SELECT event_id, date8, time6, strftime(coalesce(try_strptime(date8 || time6, '%Y%m%d%H%M%S'),
  try_strptime(date8, '%Y%m%d')), '%Y-%m-%d %H:%M:%S') AS start_ts FROM q""")
def d04(spark, d):
    h = _events_header(spark, d).select("event_id", D.parse_date("dl").alias("date8"), D.parse_time("tl").alias("time6"))
    return h.select("event_id", "date8", "time6",
                    F.date_format(D.start_timestamp("date8", "time6"), "yyyy-MM-dd HH:mm:ss").alias("start_ts"))


@query("d07_speaker_split", """WITH s AS (SELECT conv_id, turn, regexp_replace(
  CASE WHEN role = 'system' THEN text ELSE role || ': ' || text END, '^\\s+|\\s+$', '', 'g') AS s FROM conversations),
c AS (SELECT conv_id, turn, s, instr(s, ':') AS ci FROM s)
SELECT conv_id, turn,
  CASE WHEN ci > 0 AND regexp_matches(substring(s, 1, ci - 1), '\\p{L}')
       THEN regexp_replace(substring(s, 1, ci - 1), '^\\s+|\\s+$', '', 'g') END AS speaker,
  CASE WHEN ci > 0 AND regexp_matches(substring(s, 1, ci - 1), '\\p{L}')
       THEN regexp_replace(substring(s, ci + 1), '^\\s+|\\s+$', '', 'g') ELSE s END AS content FROM c""")
def d07(spark, d):
    c = table(spark, d, "conversations")
    line = F.when(F.col("role") == "system", F.col("text")).otherwise(F.concat("role", F.lit(": "), "text"))
    return c.select("conv_id", "turn", D.speaker_split(line).alias("s")).select(
        "conv_id", "turn", F.col("s.speaker").alias("speaker"), F.col("s.content").alias("content"))


def _body(spark, d):
    l = _lines(spark, d)
    return l.select("id", F.posexplode(F.slice("l", 5, 1 << 30)).alias("line_no", "line"))


@query("d08_d09_line_parts", f"""WITH {RAW_SQL}, {BODY_SQL}
SELECT id, CAST(line_no AS BIGINT) AS line_no, CAST(part_no AS BIGINT) AS part_no, speaker, text FROM parts""")
def d08(spark, d):
    p = D.line_parts(_body(spark, d))
    return p.select("id", F.col("line_no").cast("bigint"), F.col("part_no").cast("bigint"), "speaker", "text")


@query("d10_d11_parse_transcripts", f"""WITH {RAW_SQL}, {BODY_SQL}
SELECT id, turn_no, speaker, utterance FROM turns""")
def d11(spark, d):
    _, turns = D.parse_transcripts(raw_transcripts(spark, d))
    return turns.select("id", F.col("turn_no").cast("bigint"), "speaker", "utterance")


TURNS_SQL = f"""ct AS (SELECT conv_id, turn, {ROLE_SQL} AS speaker, text FROM conversations)"""


def _turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", _role(F.col("role")).alias("speaker"), "text")


@query("d14_gp_speech", f"""WITH {TURNS_SQL}
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM ct
WHERE contains(lower(speaker), 'gp') OR contains(lower(speaker), 'doc') GROUP BY conv_id""")
def d14(spark, d):
    t = D.role_filter(_turns(spark, d), patient=False, gp=True, info=False)
    return D.joined_text(t, "conv_id", "turn", "text")


@query("d15_apply_to_turns", f"""WITH {TURNS_SQL}
SELECT conv_id, turn, upper(speaker) AS speaker, lower(text) AS utterance FROM ct""")
def d15(spark, d):
    t = _turns(spark, d)
    arr = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", F.col("text").alias("utterance")))).alias("t"))
    m = arr.select("conv_id", F.col("t.turn").alias("turns_no"),
                   D.apply_to_turns(F.col("t"), F.upper, F.lower).alias("m"))
    z = m.select("conv_id", F.inline(F.arrays_zip(F.col("turns_no").alias("turn"), F.col("m").alias("x"))))
    return z.select("conv_id", "turn", F.col("x.speaker").alias("speaker"), F.col("x.utterance").alias("utterance"))


@query("d16_clean_turns", f"""SELECT conv_id, turn, array_to_string(list_filter(list_filter(
  list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: len(x) > 0),
  lambda x: NOT list_contains({stop_sql('c')}, x)), lambda x: NOT list_contains({stop_sql('e')}, x)), ' ') AS text
FROM conversations""")
def d16(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.preprocess("text", stopword_list("c"), stopword_list("e")).alias("text"))


@query("d17_duration_histogram", """WITH s AS (SELECT CAST(round(value * 100) AS BIGINT) AS secs FROM events),
p AS (SELECT lpad(CAST(secs // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(secs % 3600 // 60 AS VARCHAR), 2, '0') || ':'
             || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') AS dur FROM s),
x AS (SELECT CAST(split_part(dur, ':', 1) AS BIGINT) * 3600 + CAST(split_part(dur, ':', 2) AS BIGINT) * 60
             + CAST(split_part(dur, ':', 3) AS BIGINT) AS secs FROM p),
m AS (SELECT min(secs) AS lo, max(secs) AS hi FROM x)
SELECT CAST(least(floor((secs - lo) / ((hi - lo) / 10.0)), 9) AS INTEGER) AS bin, count(*) AS n FROM x, m GROUP BY bin""")
def d17(spark, d):
    e = table(spark, d, "events").select(F.round(F.col("value") * 100).cast("bigint").alias("secs"))
    dur = e.select(F.concat_ws(":", F.lpad((F.col("secs") / 3600).cast("bigint").cast("string"), 2, "0"),
                               F.lpad(((F.col("secs") % 3600) / 60).cast("bigint").cast("string"), 2, "0"),
                               F.lpad((F.col("secs") % 60).cast("string"), 2, "0")).alias("dur"))
    secs = dur.select(D.duration_seconds("dur").alias("secs"))
    return D.duration_histogram(secs, "secs", 10)


@query("d18_parse_list_literal", """SELECT p_partkey, len(l) AS n, l[1] AS first, l[2] AS second FROM (
  SELECT p_partkey, [p_brand, 'it''s ' || p_type] AS l FROM part)""")
def d18(spark, d):
    p = table(spark, d, "part")
    lit = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', \"it's "), F.col("p_type"), F.lit('"]'))
    a = p.select("p_partkey", D.parse_list_literal(lit).alias("l"))
    return a.select("p_partkey", F.size("l").alias("n"), F.get("l", 0).alias("first"), F.get("l", 1).alias("second"))


PT_ROWS_SQL = """pr AS (
  SELECT o_custkey AS id, o_orderdate AS dt, o_orderkey AS ok, 0 AS ln, 0 AS k2, 0 AS k3, 0.0 AS k4,
         strftime(o_orderdate, '%d-%b-%Y') AS c1, strftime(o_orderdate, '%d-%b-%Y') AS c2, o_orderpriority AS c3,
         CAST(NULL AS VARCHAR) AS c4 FROM orders
  UNION ALL
  SELECT o_custkey, o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CASE l_returnflag WHEN 'R' THEN 'Lab-Results' WHEN 'A' THEN 'Medication' ELSE '' END,
         CASE l_returnflag WHEN 'R' THEN 'Lab-Results' WHEN 'A' THEN 'Medication' ELSE '' END,
         'qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), NULL
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rows AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY dt, ok, ln, k2, k3, k4) AS row_no, c1, c2, c3, c4 FROM pr
  UNION ALL SELECT DISTINCT o_custkey, 0, 'Date', 'Date', 'Text', NULL FROM orders)"""


def patient_rows(spark, d):
    from pyspark.sql import Window
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    date_s = F.date_format("o_orderdate", "dd-MMM-yyyy")
    entries = o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("dt"), F.col("o_orderkey").alias("ok"),
                       F.lit(0).alias("ln"), F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("k3"),
                       F.lit(0.0).alias("k4"), date_s.alias("c1"), date_s.alias("c2"), F.col("o_orderpriority").alias("c3"),
                       F.lit(None).cast("string").alias("c4"))
    head = F.when(F.col("l_returnflag") == "R", "Lab-Results").when(F.col("l_returnflag") == "A", "Medication").otherwise("")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("dt"), F.col("o_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"),
        F.col("l_extendedprice").alias("k4"), head.alias("c1"), head.alias("c2"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("bigint").cast("string")).alias("c3"),
        F.lit(None).cast("string").alias("c4"))
    r = entries.unionByName(lines)
    r = r.select("id", F.row_number().over(Window.partitionBy("id").orderBy("dt", "ok", "ln", "k2", "k3", "k4")).alias("row_no"),
                 "c1", "c2", "c3", "c4")
    hdr = o.select(F.col("o_custkey").alias("id")).distinct().select(
        "id", F.lit(0).alias("row_no"), F.lit("Date").alias("c1"), F.lit("Date").alias("c2"), F.lit("Text").alias("c3"),
        F.lit(None).cast("string").alias("c4"))
    return r.unionByName(hdr)


@query("d12_d13_record_entries", f"""WITH {PT_ROWS_SQL},
sel AS (SELECT id, arg_min(CASE WHEN coalesce(len(c2), 0) > 0 AND c2 <> c1 THEN 1
                                WHEN coalesce(len(c3), 0) > 0 AND c3 <> c1 THEN 2
                                WHEN coalesce(len(c4), 0) > 0 AND c4 <> c1 THEN 3 END, row_no) AS idx
        FROM rows WHERE len(regexp_replace(c1, '^\\s+|\\s+$', '', 'g')) > 0 GROUP BY id),
r0 AS (SELECT r.id, r.row_no, regexp_replace(r.c1, '^\\s+|\\s+$', '', 'g') AS first,
  regexp_replace(coalesce(CASE s.idx WHEN 1 THEN r.c2 WHEN 2 THEN r.c3 WHEN 3 THEN r.c4 END, ''), '^\\s+|\\s+$', '', 'g') AS third
  FROM rows r LEFT JOIN sel s USING (id)),
r1 AS (SELECT *, try_strptime(first, '%d-%b-%Y') IS NOT NULL AS is_date, CAST(try_strptime(first, '%d-%b-%Y') AS DATE) AS date,
  row_number() OVER (PARTITION BY id ORDER BY row_no) AS rn FROM r0),
r2 AS (SELECT * FROM r1 WHERE NOT (first = 'Date' AND rn = 1) AND (len(first) > 0 OR len(third) > 0)),
r3 AS (SELECT id, row_no, third, is_date, date,
  sum(CAST(is_date AS INTEGER)) OVER w AS entry_no,
  last_value(CASE WHEN is_date THEN 'gp' WHEN len(first) > 0 THEN lower(translate(first, '- ', '__')) END IGNORE NULLS) OVER w
    AS heading
  FROM r2 WINDOW w AS (PARTITION BY id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r4 AS (SELECT * FROM r3 WHERE entry_no > 0),
t AS (SELECT id, entry_no, heading, string_agg(third, ' ' ORDER BY row_no) AS text FROM r4
  WHERE heading IN ('gp', 'lab_results', 'medication', 'history') AND len(third) > 0 GROUP BY id, entry_no, heading)
SELECT d.id, CAST(d.entry_no AS BIGINT) AS entry_no, strftime(d.date, '%Y-%m-%d') AS date,
  coalesce(max(CASE WHEN heading = 'gp' THEN text END), '') AS gp,
  max(CASE WHEN heading = 'lab_results' THEN text END) AS lab_results,
  max(CASE WHEN heading = 'medication' THEN text END) AS medication
FROM (SELECT id, entry_no, date FROM r4 WHERE is_date) d LEFT JOIN t USING (id, entry_no)
GROUP BY d.id, d.entry_no, d.date""")
def d12(spark, d):
    e = D.record_entries(patient_rows(spark, d))
    return e.select("id", F.col("entry_no").cast("bigint"), F.date_format("date", "yyyy-MM-dd").alias("date"),
                    "gp", "lab_results", "medication")
