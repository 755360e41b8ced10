"""Hand-made micro-fixtures for rules the driver's tables cannot trigger
(expected values from the documented rules)."""
from pyspark.sql import functions as F

from codeweave.functions import text as T
from codeweave.operators import aggregate as A
from codeweave.operators import chunk as C
from codeweave.operators import classify as M
from codeweave.operators import evaluate as E
from codeweave.operators import sample as S
from codeweave.operators import structure as D


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_header_dates_times_durations(spark):
    assert one(spark, D.parse_date(F.lit("Date: 05-03-14"))) == "20140305"
    assert one(spark, D.parse_date(F.lit("File: 2014-03-05"))) == "20140305"
    assert one(spark, D.parse_date(F.lit("Date: 5-3-14"))) is None
    assert one(spark, D.parse_time(F.lit("Time: 12:34"))) == "001234"
    assert one(spark, D.parse_time(F.lit("Time: 12345"))) == "123405"
    assert one(spark, D.duration_seconds(F.lit("Duration: 12:30"))) == 750
    assert one(spark, D.duration_seconds(F.lit("Duration: 1:02:03"))) == 3723
    ts = one(spark, D.start_timestamp(F.lit("20140305"), F.lit(None).cast("string")))
    assert str(ts).startswith("2014-03-05 00:00")


def test_speaker_split(spark):
    r = one(spark, D.speaker_split(F.lit("12:30 we met")))
    assert r["speaker"] is None and r["content"] == "12:30 we met"
    r = one(spark, D.speaker_split(F.lit(" GP : hello there ")))
    assert (r["speaker"], r["content"]) == ("GP", "hello there")


def _parts(spark, speaker, line):
    r = one(spark, D.bracket_parts(F.lit(speaker), F.lit(line)))
    return [(p["speaker"], p["text"]) for p in r]


def test_bracket_parts(spark):
    assert _parts(spark, "GP", "ok [door] bye") == [("GP", "ok "), ("info", "door"), ("GP", " bye")]
    assert _parts(spark, "GP", "noise] yes") == [("info", "noise"), ("GP", " yes")]
    assert _parts(spark, "GP", "yes [nois") == [("GP", "yes "), ("info", "nois")]
    assert _parts(spark, "GP", "a") == []  # one character dropped at the plain-text branch


def test_merge_turns(spark):
    raw = spark.createDataFrame([(1, "Date: 05-03-14\nTime: 12:34\nDuration: 1:00\nID: x1\nGP: aa\nGP: bb\nPatient: cc\n[x][y]")],
                                "id long, raw string")
    hdr, turns = D.parse_transcripts(raw)
    got = [(r["speaker"], r["utterance"]) for r in turns.orderBy("turn_no").collect()]
    assert got == [("GP", "aa bb"), ("Patient", "cc"), ("info", "x"), ("info", "y")]
    h = hdr.first()
    assert h["record_id"] == "x1" and h["duration_s"] == 60


def test_record_entries(spark):
    rows = spark.createDataFrame([
        (1, 0, "Date", "Date", "Text", None),
        (1, 1, "05-Mar-2014", "05-Mar-2014", "Dr A", None),
        (1, 2, "Lab-Results", "Lab-Results", "hb 12", None),
        (1, 3, "", "", "wbc 5", None),
        (1, 4, "Unknown Head", "Unknown Head", "dropped", None)], "id long, row_no int, c1 string, c2 string, c3 string, c4 string")
    e = D.record_entries(rows).first()
    assert e["lab_results"] == "hb 12 wbc 5" and e["gp"] == "Dr A" and str(e["date"]) == "2014-03-05"


def test_text_rules(spark):
    assert one(spark, T.remove_questions(T.remove_brackets(F.lit("Why now? Rest [1] well")))) == " Rest  well"
    assert one(spark, T.repair_sentence_breaks(F.lit("end.Next"))) == "end. Next"
    assert one(spark, T.code_categories(F.array(F.lit("-30"), F.lit("u99"), F.lit(" B80")))) == ["U", ""]
    assert one(spark, T.extract_codes(F.lit("see A01, -30, x9"))) == ["A01", "-30"]
    assert one(spark, T.extract_codes(F.lit(None).cast("string"))) == []
    wanted = ["Causes", "Signs and symptoms"]
    assert one(spark, T.heading_wanted(F.lit("Signs"), wanted)) is True
    assert one(spark, T.heading_wanted(F.lit("Causes of X"), wanted)) is False
    p = one(spark, T.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert abs(sum(p) - 1) < 1e-12 and p[2] > p[1] > p[0]


def _pack(spark, sizes, max_tokens):
    units = [" ".join(["w"] * n) for n in sizes]
    df = spark.createDataFrame([(1, units)], "id long, units array<string>")
    return [(r["chunk_id"], r["n_units"], r["text"][:1] == " ")
            for r in C.pack_units(df, ["id"], "units", max_tokens).orderBy("chunk_id").collect()]


def test_packing(spark):
    assert _pack(spark, [200, 300, 100], 490) == [(0, 1, True), (1, 2, False)]
    assert _pack(spark, [245, 245], 490) == [(0, 1, True), (1, 1, False)]
    # an over-long first unit: empty first chunk dropped, unit stands alone
    assert _pack(spark, [600, 10], 490) == [(0, 1, False), (1, 1, False)]


def test_multilabel_split_partitions(spark):
    dl = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A"), (4, "B"), (5, "B"), (6, "C"), (7, "A")],
                               "id long, label string")
    s = S.multilabel_split(dl, 1, 0.2).collect()
    ids = [r["id"] for r in s]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6, 7] and len(ids) == len(set(ids))
    strata = {r["id"]: r["stratum"] for r in s}
    assert strata[6] != "C"  # single-document class moves into the next stratum
    assert strata[1] == "B"  # rarest label wins


def test_balanced_negatives_never_own_label(spark):
    it = spark.createDataFrame([(i, "L%d" % (i % 3)) for i in range(30)], "item_id long, label string")
    ex = spark.createDataFrame([("L0", "L1")], "label string, excluded string")
    pairs, report = S.balanced_negatives(it, ex, 3)
    lab = {r["item_id"]: r["label"] for r in it.collect()}
    neg = pairs.filter("polarity = 0").collect()
    assert len(neg) == 30
    for r in neg:
        assert lab[r["item_id"]] != r["label"]
        if r["label"] == "L0":
            assert lab[r["item_id"]] != "L1"
    assert report.count() == 0


def test_merge_chunks_any_max(spark):
    cp = spark.createDataFrame([(1, "L", False, 0.2), (1, "L", True, 0.7)], "doc_id long, label string, pred boolean, score double")
    r = A.merge_chunks(cp, "doc_id").first()
    assert r["pred"] is True and abs(r["score"] - 0.7) < 1e-12


def test_overlapping_windows(spark):
    u = spark.createDataFrame([(1, i, "s%d" % i) for i in range(8)], "id long, pos int, t string")
    w = {r["i"]: r["text"] for r in A.overlapping_windows(u, "id", "pos", "t", 6).collect()}
    assert w == {6: "s1 s2 s3 s4 s5 s6 s7", 7: "s2 s3 s4 s5 s6 s7"}


def test_knn_exact_match_takes_all(spark):
    tr = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [0.7, 0.7])],
                               "id long, label string, vec array<double>")
    te = spark.createDataFrame([(10, [2.0, 0.0])], "id long, vec array<double>")
    r = {x["label"]: x["score"] for x in M.knn_cosine(tr, te, 3, "vec", block_rows=2).collect()}
    assert abs(r["a"] - 1.0) < 1e-12 and r.get("b", 0.0) == 0.0


def test_zero_division_class_kept(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "B")], "id long, label string")
    pred = spark.createDataFrame([(1, "A")], "id long, label string")
    pc = {r["label"]: r for r in E.per_class(gold, pred).collect()}
    assert pc["B"]["precision"] == 0 and pc["B"]["recall"] == 0 and pc["B"]["f1"] == 0
    assert abs(E.macro(E.per_class(gold, pred)).first()["f1"] - 0.5) < 1e-12


def test_auc_matches_pairwise(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "id long, label string")
    sc = spark.createDataFrame([(1, "A", .9), (2, "A", .4), (3, "A", .4), (4, "A", .1)], "id long, label string, score double")
    ids = gold.select("id")
    a = {r["label"]: r["auc"] for r in E.roc_auc(gold, sc, ids).collect()}
    # positives {.9,.4} vs negatives {.4,.1}: pairs won 1+1+0.5+1 = 3.5 of 4
    assert abs(a["A"] - 0.875) < 1e-12


def test_record_text_column_is_found_in_a_later_row(spark):
    from codeweave.operators.structure import record_entries
    rows = spark.createDataFrame([(1, 0, "Date", "Date", "Date", None), (1, 1, "01-Jan-2020", "", "Dr A", None),
                                  (1, 2, "Lab-Results", "", "hb 12", None)],
                                 "id long, row_no long, c1 string, c2 string, c3 string, c4 string")
    r = record_entries(rows).first()
    assert (r["gp"], r["lab_results"]) == ("Dr A", "hb 12")


def test_list_literals_with_both_quotes(spark):
    from codeweave.operators.structure import parse_list_literal
    df = spark.createDataFrame([("""["I'm ok", 'b']""",), ("""['a\\'s', "q\\"x"]""",), ("[]",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_list_literal("s")).collect()] == [["I'm ok", "b"], ["a's", 'q"x'], [], None]


def test_import_reads_no_file_of_pyspark():
    """Queries and oracles load where pyspark has no jar folder."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import glob, zipfile; glob.glob = zipfile.ZipFile = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_long_conversations_and_chunks_keep_their_keys(spark):
    """Turn 100 of a conversation is not turn 0 of the next; accents stay inside words."""
    from pyspark.sql import functions as F

    from codeweave.functions.text import tokens
    from codeweave.operators.vectorize import fit_vocabulary, term_counts
    df = spark.createDataFrame([(1, 100, "alpha"), (2, 0, "beta"), (3, 0, "")], "conv_id long, turn long, text string")
    c = term_counts(df.select(F.concat_ws(":", "conv_id", "turn").alias("tid"), "text"), "tid", "text")
    assert sorted((r["id"], r["term"]) for r in c.collect()) == [("1:100", "alpha"), ("2:0", "beta")]
    import math

    import pytest
    one = fit_vocabulary(c, 10, 3).first()
    assert one["idf"] == pytest.approx(math.log(4 / 2) + 1)
    assert spark.createDataFrame([("ciónado él",)], "t string").select(tokens("t")).first()[0] == ["ciónado", "él"]


def test_stopword_set_m_must_be_given():
    import pytest

    from codeweave.functions.stopwords import stopword_list
    with pytest.raises(ValueError):
        stopword_list("mce")
    assert "aspirin" in stopword_list("mc", ["aspirin"])
