"""What grows with the corpus does not pass the driver."""

from __future__ import annotations

from colloquy.llm import components, minhash


def test_near_duplicates_are_found_without_broadcasts(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    real = minhash.cut
    for module in (minhash, components):
        monkeypatch.setattr(module, "cut", seen)
    words = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(k, f"{words} {k // 3}") for k in range(30)], "doc_id long, text string")
    out = minhash.near_dedup(docs, percent=80)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() < 30 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not any("Broadcast" in p for p in plans)
