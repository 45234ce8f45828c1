"""Dimension batches, keys and ids."""

import pytest
from pyspark.sql import functions as F

from answerlens.operators import dimensions as dims
from answerlens.operators import facts as fx
from answerlens.operators.ids import next_id, with_sequential_ids
from answerlens.sources.dimensions import brand_names, read_brands, read_prompts


def prompts(spark, *entries):
    return spark.createDataFrame(list(entries), "id long, text string, stage string")


def brands(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "ord int, brand_name string")


def batch(spark, entries, columns):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], f"seq long, {columns}")


def state(df):
    return sorted(tuple(r) for r in df.collect())


def reasons(change):
    return {r.seq: r.reason for r in change.rejected.collect()}


def test_add_prompts(spark):
    new = batch(
        spark,
        [("Best CRM software for freelancers?", "research"), ("  best CRM software for freelancers?  ", "research"),
         ("How to pick one?", " Comparison "), ("x", "invalid_stage_name"), ("   ", "research"), (None, None), ("y", None)],
        "text string, stage string",
    )
    change = dims.add_prompts(prompts(spark), new)
    assert state(change.result) == [
        (1, "Best CRM software for freelancers?", "research"), (2, "How to pick one?", "comparison"),
    ]
    assert reasons(change) == {
        1: "duplicate", 3: "invalid_stage", 4: "empty_text", 5: "empty_text", 6: "invalid_stage",
    }


def test_add_prompts_after_deleting_the_last_reuses_its_id(spark):
    change = dims.delete_prompts(prompts(spark, (1, "a", "research"), (5, "b", "research")), spark.createDataFrame([(5,)], "id long"))
    added = dims.add_prompts(change.result, batch(spark, [("c", "research"), ("A", "research")], "text string, stage string"))
    assert state(added.result) == [(1, "a", "research"), (2, "c", "research")]
    assert reasons(added) == {1: "duplicate"}


def test_update_prompts(spark):
    existing = prompts(spark, (1, "one", "research"), (2, "two", "research"), (3, "three", "research"))
    updates = batch(
        spark,
        [(1, " TWO ", "comparison"), (2, "Two", "comparison"), (3, "new", "research"), (999, "z", "research"),
         (3, "again", "research"), (3, "", "research"), (3, "q", "nowhere")],
        "id long, text string, stage string",
    )
    change = dims.update_prompts(existing, updates)
    assert state(change.result) == [(1, "one", "research"), (2, "Two", "comparison"), (3, "again", "research")]
    assert reasons(change) == {0: "duplicate", 3: "not_found", 5: "empty_text", 6: "invalid_stage"}


def test_updates_claiming_one_text(spark):
    existing = prompts(spark, (1, "one", "research"), (2, "two", "research"))
    change = dims.update_prompts(
        existing, batch(spark, [(2, "same", "research"), (1, "SAME", "research")], "id long, text string, stage string")
    )
    assert state(change.result) == [(1, "one", "research"), (2, "same", "research")]
    assert reasons(change) == {1: "duplicate"}


def test_delete_prompts(spark):
    change = dims.delete_prompts(prompts(spark, (1, "a", "research"), (2, "b", "research")), spark.createDataFrame([(1,), (9,)], "id long"))
    assert state(change.result) == [(2, "b", "research")]
    assert state(change.rejected) == [(9, "not_found")]
    assert dims.delete_all(change.result).collect() == []


def test_add_brands(spark):
    change = dims.add_brands(brands(spark, "HubSpot"), batch(spark, [("  hubspot  ",), (" Zoho CRM",), ("",), ("zoho crm",)], "brand_name string"))
    assert state(change.result) == [(0, "HubSpot"), (1, "Zoho CRM")]
    assert reasons(change) == {0: "duplicate", 2: "empty_name", 3: "duplicate"}


def test_rename_brands(spark):
    existing = brands(spark, "HubSpot", "Zoho CRM", "asana", "hubspot")
    renames = batch(
        spark,
        [("HUBSPOT ", "HubSpot Pro"), ("asana", "ASANA"), ("Zoho CRM", "Asana"), ("Salesforce", "SF"), ("zoho crm", "Z"), ("asana", " ")],
        "old_name string, new_name string",
    )
    change = dims.rename_brands(existing, renames)
    assert state(change.result) == [(0, "HubSpot Pro"), (1, "Z"), (2, "ASANA"), (3, "HubSpot Pro")]
    assert reasons(change) == {2: "duplicate", 3: "not_found", 5: "empty_name"}


def test_delete_brands(spark):
    change = dims.delete_brands(brands(spark, "HubSpot", "Zoho"), spark.createDataFrame([(" HUBSPOT",), ("x",)], "brand_name string"))
    assert state(change.result) == [(1, "Zoho")]
    assert state(change.rejected) == [("x", "not_found")]


def test_existence(spark):
    responses = spark.createDataFrame([(1, 1, "g")], "id long, prompt_id long, platform string")
    flagged = dims.prompts_with_responses(prompts(spark, (1, "a", "research"), (99, "b", "research")), responses)
    assert {r.id: r.has_responses for r in flagged.collect()} == {1: True, 99: False}
    mentions = spark.createDataFrame([("HubSpot",), ("HubSpot",)], "brand_name string")
    named = dims.brands_with_mentions(brands(spark, "HubSpot", " hubspot", "Unknown"), mentions)
    assert {r.brand_name: r.has_mentions for r in named.collect()} == {"HubSpot": True, " hubspot": True, "Unknown": False}


def test_history_is_kept(spark):
    """Deleting a brand or prompt leaves its facts in place."""
    responses = spark.createDataFrame([(1, 1, "g")], "id long, prompt_id long, platform string")
    left = dims.delete_prompts(prompts(spark, (1, "a", "research")), spark.createDataFrame([(1,)], "id long")).result
    assert fx.responses_with_stage(responses, left.unionByName(prompts(spark, (7, "z", "research")))).first().stage is None


def test_sequential_ids(spark):
    # A third of the values lies close together, the others far apart.
    key = "if(id % 3 = 0, id - 600, (id * 7919 % 3000) * 1000000000000 + id)"
    frame = spark.range(3000).selectExpr(f"{key} AS k")
    numbered = with_sequential_ids(frame, "k", next_id(spark.createDataFrame([(41,)], "id long")))
    found = [r.id for r in numbered.orderBy("k").collect()]
    assert found == list(range(42, 3042))


def test_sequential_ids_of_one_and_no_row(spark):
    one = spark.createDataFrame([(2**60,)], "k long")
    assert with_sequential_ids(one, "k", next_id(one.limit(0).selectExpr("k AS id"))).first().id == 1
    assert with_sequential_ids(one.limit(0), "k", next_id(one.selectExpr("k AS id"))).collect() == []


def test_prompt_file(spark, tmp_path):
    path = tmp_path / "prompts.json"
    assert read_prompts(spark, str(path)).collect() == []
    path.write_text(" \n")
    assert read_prompts(spark, str(path)).collect() == []
    path.write_text('[{"id": 1, "text": "a", "stage": "research"},\n {"id": 2, "text": "é"}]', encoding="utf-8")
    assert state(read_prompts(spark, str(path))) == [(1, "a", "research"), (2, "é", None)]
    for wrong in ("invalid json content {", '{"id": 1}', '[{"id": 1}'):
        path.write_text(wrong)
        with pytest.raises(Exception, match="JSON|MALFORMED"):
            read_prompts(spark, str(path)).collect()


def test_brand_file(spark, tmp_path):
    path = tmp_path / "brands.json"
    assert read_brands(spark, str(path)).collect() == []
    path.write_text('["Trello", 5, null, "Asana", {"a": 1}, "Trello"]')
    found = read_brands(spark, str(path))
    assert brand_names(found, 10) == ["Trello", "Asana", "Trello"]
    assert brand_names(found, 2) is None
    for wrong in ("nonsense", '"Trello"', '["Trello"'):
        path.write_text(wrong)
        with pytest.raises(Exception, match="JSON|MALFORMED"):
            read_brands(spark, str(path)).collect()


def test_numbering_sorts_the_key_only(spark):
    rows = spark.range(100).selectExpr("id AS k", "repeat('text', 100) AS t")
    plan = with_sequential_ids(rows, "k", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan.split("Window")[0]
