"""Ordered scans: the same result in one block and in many, also when one group is spread over all."""
import random

from pyspark.sql import functions as F

from codeweave.operators.scan import running


def test_running_equals_plain_loop(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i if i % 50 else None, r.choice([None, None, "x", "y", "z"]), r.choice([None, 1, 2])) for i in range(1, 900)]
    rows = list({(g, o): (g, o, s, n) for g, o, s, n in rows}.values())
    want, state = {}, {}
    for g, o, s, n in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or 0)):
        total, last, before = state.get(g, (0, None, None))
        total, last = total + (n or 0), s if s is not None else last
        want[g, o] = (total, last, before)
        state[g] = (total, last, s)
    df = spark.createDataFrame(rows, "g string, o long, s string, n long").repartition(3)
    for blocks in (1, 17):
        got = running(df, ["g"], ["o"], {"total": F.col("n")}, {"filled": F.col("s")}, {"before": F.col("s")}, blocks=blocks).collect()
        assert {(x["g"], x["o"]): (x["total"], x["filled"], x["before"]) for x in got} == want
        assert len(got) == len(rows)


def test_running_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, o long")
    assert running(df, ["g"], ["o"], {"n": F.lit(1)}).collect() == []


def transcript_lines(spark):
    r = random.Random(6)
    rows = []
    for i in range(4):
        for n in range(r.randint(1, 40) if i else 400):  # one long transcript
            who = r.choice(["GP: ", "Patient: ", "", "", "note: "])
            rows.append((f"d{i}", n, who + r.choice(["yes", "no [cough] then", "[unclear", "well] so", "a", "12:30 came"])))
    return spark.createDataFrame(rows, "id string, line_no long, line string")


def test_turns_of_a_long_transcript_need_no_task_of_its_own(spark):
    from codeweave.operators import structure as D
    lines = transcript_lines(spark)

    def rows(long_group):
        return sorted(map(tuple, D.merge_turns(D.line_parts(lines, long_group), long_group).collect()), key=repr)
    assert rows(0) == rows(None) and len(rows(None)) > 100


def test_entries_of_a_long_record(spark):
    from codeweave.operators import structure as D
    r = random.Random(8)
    rows = [(f"p{i}", n, c1, c1 if r.random() < 0.2 else "x", r.choice(["text", "", "more text"]), "z") for i in range(3) for n in range(150)
            for c1 in [r.choice(["Date", "01-Jan-2020", "05-Mar-2021", "Problem", "History", "", "", "Unknown"])]]
    df = spark.createDataFrame(rows, "id string, row_no long, c1 string, c2 string, c3 string, c4 string")

    def entries(long_group):
        return sorted(map(tuple, D.record_entries(df, long_group).collect()), key=repr)
    assert entries(0) == entries(None) and len(entries(None)) > 50
