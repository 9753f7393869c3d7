"""What the audit trail and the review of fields move between tasks."""

from panelcheck.operators import evidence as E


def exchanged(spark, df):
    """Rows that the query wrote to exchanges."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return sum(found)


def test_only_fields_that_a_trail_can_name_are_exchanged(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logs = [(k, "extracted_field" if k % 2 else "inspection", None if k == 9 else k) for k in range(20)]
        audit = spark.createDataFrame([*logs, logs[3]], "id bigint, entity_type string, entity_id bigint")
        insp = spark.createDataFrame([(k,) for k in (0, 2, 40)], "id bigint")
        ids = [None, 1, 1, *range(5, 5000)]
        fields = spark.createDataFrame([(i, None if i is None else i % 7) for i in ids], "id bigint, inspection_id bigint")
        out = E.relevant_logs(audit, insp, fields)
        want = sorted([(k, e) for k, t, e in [*logs, logs[3]] for i in (ids if t == "extracted_field" else (0, 2, 40)) if e is not None and e == i])
        assert sorted((r.id, r.entity_id) for r in out.collect()) == want
        assert exchanged(spark, out) < 200
        assert E.relevant_logs(audit.limit(0), insp, fields).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "4m")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")


def test_reviewed_fields_stay_with_their_inspection(spark, fx):
    from panelcheck.operators import review as R
    from panelcheck.operators import rules as Ru
    from panelcheck.plans.catalog.review import actions

    fields = fx.extracted_fields().select("inspection_id", "field_type", "field_seq", *Ru.FIELD_COLUMNS)
    acts = actions(fx, "correct")
    place, back = lambda df: sorted(map(str, df.collect())), R.apply_reviews(fields, acts, by="inspection_id")
    assert place(back) == place(R.apply_reviews(fields, acts))
    # twice the same field, one without an id, an action that touches no override
    some = spark.createDataFrame([(1, 10, "pass", False, "old")] * 2 + [(1, 11, "fail", False, None), (None, None, "pass", False, None)],
                                 "inspection_id bigint, id bigint, verdict string, reviewed_by_officer boolean, officer_override_value string")
    done = spark.createDataFrame([(10, 1, "correct", " new "), (10, 2, "confirm", None), (11, 3, "retract", None), (None, 4, "confirm", None)], "field_id bigint, action_seq bigint, action string, override_value string")
    assert place(R.apply_reviews(some, done, by="inspection_id")) == place(R.apply_reviews(some, done))
    assert len(R.apply_reviews(some, done, by="inspection_id").filter("officer_override_value = 'new' AND reviewed_by_officer").collect()) == 2


def test_status_after_review_writes_no_fields(spark, folder, tmp_path, monkeypatch):
    """All reviewed fields were exchanged by their id, written and exchanged again by their inspection."""
    from __spark_entry__ import queries
    from panelcheck.sources import files as FI

    monkeypatch.setattr(FI, "new_folder", lambda s, name: f"{tmp_path}/{name}")
    assert queries()["v5_status_after_review"](spark, folder).count() > 0
    assert list(tmp_path.iterdir()) == []
