"""Metrics and insights on small facts."""

import pytest

from answerlens.operators import facts as fx
from answerlens.operators import metrics
from answerlens.plans.insights import insight_report
from answerlens.session import tune

SEEDS = ["Trello", "Asana", "ClickUp", "Notion"]
G_RESPONSES = [(1, 1, "gemini"), (2, 4, "gemini")]
G_MENTIONS = [(1, "HubSpot", 1, "recommended"), (1, "Zoho CRM", 2, "neutral"), (2, "HubSpot", 1, "recommended")]
G_CITATIONS = [(1, "https://g2.com/hubspot", "g2.com")]
G_PROMPTS = [(1, "a", "research"), (4, "b", "recommendation")]


class Model:
    def __init__(self, spark, responses=G_RESPONSES, mentions=G_MENTIONS, citations=G_CITATIONS, prompts=G_PROMPTS, brands=SEEDS):
        self.tables = (
            spark.createDataFrame(responses, "id long, prompt_id long, platform string"),
            spark.createDataFrame(mentions, "response_id long, brand_name string, position int, sentiment string"),
            spark.createDataFrame(citations, "response_id long, source_url string, source_domain string"),
            spark.createDataFrame(prompts, "id long, text string, stage string"),
        )
        self.brands = spark.createDataFrame(list(enumerate(brands)), "ord int, brand_name string")

    def facts(self, stage=None, platform=None):
        return fx.filtered_facts(*self.tables, stage, platform)

    def share(self, **filters):
        return metrics.mention_share(self.facts(**filters), self.brands)

    def insights(self, **filters):
        return [r.insight for r in insight_report(*self.tables, self.brands, **filters).orderBy("seq").collect()]


def test_share(spark, rows):
    assert rows(Model(spark).share()) == [
        ("HubSpot", 2, 2, 100.0), ("Zoho CRM", 1, 2, 50.0),
        ("Trello", 0, 2, 0.0), ("Asana", 0, 2, 0.0), ("ClickUp", 0, 2, 0.0), ("Notion", 0, 2, 0.0),
    ]


def test_position_sentiment_domains(spark, rows):
    facts = Model(spark).facts()
    assert rows(metrics.average_position(facts)) == [("HubSpot", 1.0, 2), ("Zoho CRM", 2.0, 1)]
    assert rows(metrics.sentiment_breakdown(facts)) == [("HubSpot", 2, 0, 0), ("Zoho CRM", 0, 1, 0)]
    assert rows(metrics.citation_domains(facts)) == [("g2.com", 1)]


def test_stage_breakdown(spark, rows):
    model = Model(spark)
    found = rows(metrics.stage_breakdown(model.facts(), model.brands))
    assert found == [(stage, brand, 0.0) for stage in ("recommendation", "research") for brand in SEEDS]


def test_kpi(spark, rows):
    model = Model(spark)
    assert rows(metrics.kpi_summary(model.facts(), model.brands)) == [(3, "HubSpot", "100.0%", 1)]
    nothing = model.facts(platform="other")
    assert rows(metrics.kpi_summary(nothing, model.brands)) == [(0, "N/A", "0%", 0)]


def test_insights(spark):
    first, second, third, fourth = Model(spark).insights()
    assert "**HubSpot** leads visibility with a **100.0% mention share**" in first
    assert "**HubSpot**" in second and "**#1.0**" in second
    assert "**g2.com** (1 citations)" in third
    assert "**Trello** captures **0.0% share**" in fourth


def test_insights_without_citations_or_stage(spark):
    lines = Model(spark, citations=[]).insights(stage="research")
    assert "without explicit external markdown URL citations" in lines[2] and len(lines) == 4
    assert len(Model(spark, prompts=[(1, "a", "research"), (4, "b", "research")]).insights()) == 3


def test_insights_without_mentions(spark):
    assert len(Model(spark, mentions=[]).insights()) == 1
    assert Model(spark).insights(platform="other")[0].startswith("No brand mention data")


@pytest.mark.parametrize("none", [None, "", "All"])
def test_no_filter(spark, none):
    assert Model(spark).facts(stage=none, platform=none).responses.count() == 2


def test_filters(spark, rows):
    model = Model(spark)
    assert rows(model.share(stage="research"))[:2] == [("HubSpot", 1, 1, 100.0), ("Zoho CRM", 1, 1, 100.0)]
    assert rows(model.facts(stage="recommendation", platform="gemini").mentions, "response_id") == [(2,)]
    assert model.facts(stage="comparison").responses.count() == 0


def test_share_rounds_half_to_even(spark, rows):
    responses = [(i, i, "x") for i in range(16)]
    model = Model(spark, responses, [(3, "A", 1, "neutral")], [], [], ["A"])
    assert rows(model.share(), "mention_share_pct") == [(6.2,)]


def test_share_above_hundred(spark, rows):
    model = Model(spark, [(1, 7, "x"), (2, 7, "x")], [(1, "A", 1, "neutral"), (2, "A", 2, "neutral")], [], [], [])
    assert rows(model.share()) == [("A", 2, 1, 200.0)]


def test_stage_share_rounds_exactly(spark, rows):
    # 7 of 2,000 is 0.35 %, which in binary is a little less than the tie.
    responses = [(i, i, "x") for i in range(2000)]
    mentions = [(i, "A", 1, "neutral") for i in range(7)]
    model = Model(spark, responses, mentions, [], [(i, "t", "research") for i in range(2000)], ["A"])
    assert rows(metrics.stage_breakdown(model.facts(), model.brands)) == [("research", "A", round(7 / 2000 * 100, 1))]


def test_missing_prompt_has_no_stage(spark, rows):
    model = Model(spark, prompts=[(1, "a", "research")], brands=["HubSpot"])
    assert rows(metrics.stage_breakdown(model.facts(), model.brands)) == [
        ("research", "HubSpot", 100.0), (None, "HubSpot", 0.0),
    ]


def test_stage_is_unknown_only_without_any_prompt(spark, rows):
    model = Model(spark, prompts=[], brands=["HubSpot"])
    assert rows(fx.responses_with_stage(model.tables[0], model.tables[3]), "text", "stage") == [("", "unknown")] * 2
    assert rows(metrics.stage_breakdown(model.facts(), model.brands)) == [("unknown", "HubSpot", 100.0)]
    assert model.facts(stage="unknown").responses.count() == 2
    assert Model(spark).facts(stage="unknown").responses.count() == 0


def test_repeated_prompt_id_repeats_its_responses(spark, rows):
    model = Model(spark, prompts=[(1, "a", "research"), (1, "b", "comparison"), (4, "c", "research")])
    assert model.facts().responses.count() == 3
    assert rows(metrics.average_position(model.facts())) == [("HubSpot", 1.0, 3), ("Zoho CRM", 2.0, 2)]
    assert rows(model.share())[0] == ("HubSpot", 2, 2, 100.0)


def test_no_mentions_no_rows(spark):
    model = Model(spark, mentions=[])
    assert model.share().count() == 0
    assert metrics.average_position(model.facts()).count() == 0
    assert metrics.stage_breakdown(model.facts(), model.brands).count() == 0


def test_unknown_sentiment_keeps_the_brand(spark, rows):
    model = Model(spark, mentions=[(1, "A", 1, "other")])
    assert rows(metrics.sentiment_breakdown(model.facts())) == [("A", 0, 0, 0)]


def test_names_differ_by_case(spark, rows):
    model = Model(spark, mentions=[(1, "hubspot", 1, "neutral")], brands=["HubSpot", "HubSpot"])
    assert rows(model.share(), "brand_name", "mention_count") == [("hubspot", 1), ("HubSpot", 0)]


def test_equal_shares_follow_seed_order_then_name(spark, rows):
    mentions = [(1, b, 1, "neutral") for b in ("Zed", "Alpha", "Notion", "Trello")]
    assert [r[0] for r in rows(Model(spark, mentions=mentions).share())][:4] == ["Trello", "Notion", "Alpha", "Zed"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_metric_scans_leave_texts_alone(spark):
    from workload.catalog import QUERIES

    for name in ("mention_share", "stage_breakdown", "insights"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "o_orderpriority" not in plan and "c_name" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan and "Pandas" not in plan


def test_hot_response_is_split(spark):
    """A join on one response that holds most mentions reads that response in several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        mentions = spark.range(0, 400000, 1, 8).selectExpr(
            "if(id % 3 = 0, 5, id % 1000) AS response_id", "concat('b', id % 50) AS brand_name",
            "int(id % 7) AS position", "'neutral' AS sentiment",
        )
        responses = spark.range(1000).selectExpr("id", "id AS prompt_id", "'x' AS platform")
        prompts = spark.range(1000).selectExpr("id", "'t' AS text", "'research' AS stage")
        facts = fx.filtered_facts(responses, mentions, mentions.selectExpr("response_id", "'u' AS source_url", "'d' AS source_domain"), prompts)
        result = metrics.sentiment_breakdown(facts)
        assert sum(r.neutral for r in result.collect()) == 400000
        assert "skew" in plan_of(result).lower()
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("given, wanted", [("64MB", 8 << 20), ("16k", 16 << 10)])
def test_tuned_sessions_bound_what_a_task_reads(spark, given, wanted):
    """Small partitions are put together to 8 MB at most, or to less where the session says so."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, given)
        tune(spark)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == wanted
    finally:
        spark.conf.set(key, before)
