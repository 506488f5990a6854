"""Sizes of plans: each exchange of a plan costs the driver a thread, a relation and a new look at the whole plan."""

from attestra.llm import p04_defects, p06_truncated


def test_no_plan_of_defects_is_large(spark, data, monkeypatch):
    seen, spool = {}, p06_truncated.spool

    def counted(df, name="stage"):
        seen[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        return spool(df, name)

    for module in (p04_defects, p06_truncated):
        monkeypatch.setattr(module, "spool", counted)
    counted(p04_defects.votes(spark, data), "votes")
    assert {"values", "limits", "votes"} <= seen.keys()
    assert max(seen.values()) <= 20, seen
