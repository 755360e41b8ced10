"""The ranking kept by a stream equals the ranking of everything that arrived, also after a restart."""
from codeweave.operators.udf import keyword_scorer
from codeweave.streaming.ranking import current_ranking, start_ranking_stream

LABELS, CUES = ["en", "de"], ["the", "der"]


def test_ranking_over_arrivals_and_restart(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(ids):
        rows = [(i, f"x {'the ' * (1 + i % 7)}end. y {'der ' * (1 + i % 5)}end.") for i in ids]
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(src)

    def run():
        start_ranking_stream(spark, src, "id long, text string", sink, check, keyword_scorer(CUES), LABELS, k=6, max_tokens=2, salts=3, files_per_batch=1, digits=6).awaitTermination()
        return sorted((r["label"], r["rank"], r["id"], r["chunk_id"]) for r in current_ranking(spark, sink, 6).collect())

    def want(n):
        out = []
        for label, mod, chunk in (("en", 7, 0), ("de", 5, 1)):
            scored = sorted(((-(1 + i % mod), i) for i in range(n)))
            out += [(label, r, i, chunk) for r, (_, i) in enumerate(scored[:6], 1)]
        return sorted(out)
    arrive(range(20))
    arrive(range(20, 45))
    assert [x[:3] for x in run()] == [x[:3] for x in want(45)]
    arrive(range(45, 80))  # a new run resumes from the checkpoint: only the new file is read, state is kept
    assert [x[:3] for x in run()] == [x[:3] for x in want(80)]
