from datetime import datetime

from sievework.operators import gates


def test_promotions_need_a_person_and_the_next_step(spark):
    overlays = spark.createDataFrame([(1, "CANDIDATE"), (2, "SHADOW"), (3, "ACTIVE")], "overlay_id long, state string")
    asked = [(0, 1, "shadow", False), (1, 1, "ACTIVE", True), (2, 1, "active", None), (3, 2, "ACTIVE", False), (4, 2, "Active", True), (5, 2, "SHADOW", True), (6, 9, "SHADOW", True), (7, None, None, None), (8, 3, "SHADOW", True), (9, 1, None, True)]
    got = [r.verdict for r in gates.promotion_verdicts(spark.createDataFrame(asked, "request_id long, overlay_id long, target string, approved boolean"), overlays).orderBy("request_id").collect()]
    assert got == ["ok", "only_to_shadow", "approval_required", "approval_required", "ok", "only_to_active", "not_found", "not_found", "ok", "only_to_shadow"]


def test_a_day_has_so_many_requests(spark):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    keys = spark.createDataFrame([("a", "two", None), ("b", "two", at(1, 5)), ("c", "none", None)], "key_id string, tier string, expires_at timestamp_ntz")
    asked = [(1, "a", at(1, 1)), (2, "a", at(1, 1)), (3, "a", at(1, 1)), (4, "a", at(2, 1)), (5, "b", at(1, 4)), (6, "b", at(1, 5)), (7, "c", at(1, 1)), (8, "d", at(1, 1)), (9, None, at(1, 1)), (10, "a", None)]
    requests = spark.createDataFrame(asked, "request_id long, key_id string, ts timestamp_ntz")
    got = {r.request_id: r.verdict for r in gates.admissions(requests, keys, {"two": 2}).collect()}
    assert got == {1: "ok", 2: "ok", 3: "over_limit", 4: "ok", 5: "ok", 6: "expired", 7: "over_limit", 8: "unknown_key", 9: "unknown_key", 10: "ok"}
    assert gates.admissions(requests.limit(0), keys, {"two": 2}).count() == 0


def test_models_that_a_job_may_use(spark):
    table = [("~m", 9.0, 100, True, 1.0, 1.0), ("m:batch", 9.0, 100, True, 1.0, 1.0), ("a", None, 100, True, 1.0, 1.0), ("b", 8.0, 100, None, 1.0, 1.0), ("c", 4.0, 14, True, 1.0, 1.0), ("d", 4.0, 15, True, 1.0, 1.0), ("e", 4.0, 100, True, 0.0, 0.0), ("f", 4.0, None, True, 1.0, 1.0), ("g", 4.0, 15, True, 1.0, 1.0)]
    models = spark.createDataFrame(table, "model_id string, intelligence double, context_length int, structured boolean, prompt_price double, completion_price double")
    got = [(r.job, r.place, r.model_id) for r in gates.model_ranking(models, (("x", 100, True), ("y", 0, False)), most=3).orderBy("job", "place").collect()]
    assert got == [("x", 1, "d"), ("x", 2, "g"), ("y", 1, "b"), ("y", 2, "c"), ("y", 3, "d")]
