"""What the physical plans look like."""

import re

import pytest
from samples import table, txn
from txnwatch.operators import rules
from txnwatch.operators.specs import WINDOW_RULES
from txnwatch.plans.evaluate import evaluate
from txnwatch.schemas import TRANSACTION


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "txns")
    table(spark, [txn(at=i, merchant_id=f"M{i}") for i in range(9)]).write.parquet(path)
    return spark.read.schema(TRANSACTION).parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text).group(1)))


def test_row_rules_filter_in_the_scan(stored):
    text = plan(rules.high_value_single(stored))
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,30000.0)]" in text
    assert read_columns(text) == {"card_id", "amount", "event_time"} and "Exchange" not in text


def test_prefilters_reach_the_scan(stored):
    text = plan(rules.cnp_spike(stored))
    assert "EqualTo(channel,ONLINE)" in text
    assert read_columns(text) == {"txn_id", "card_id", "amount", "channel", "event_time"}


def test_rows_are_shuffled_before_they_are_multiplied(stored):
    text = plan(rules.velocity_check(stored))
    assert text.count("Exchange") == 2 and "Expand" not in text
    # one copy per window happens above both shuffles
    assert text.index("Generate posexplode") < text.index("Exchange")
    assert re.search(r"hashpartitioning\(card_id#\d+, \d+\), REPARTITION_BY_NUM", text)
    assert re.search(r"hashpartitioning\(card_id#\d+, \w+#\d+L", text)


def test_distinct_counts_hold_no_sets(stored):
    for rule, column in ((rules.rapid_merchant_switch, "merchant_id"), (rules.multi_card_terminal, "card_id")):
        text = plan(rule(stored))
        assert "collect_" not in text and "ObjectHashAggregate" not in text
        assert re.search(rf"hashpartitioning\(\w+#\d+, {column}#\d+, \w+#\d+L", text)
        assert text.count("FileScan") == 1


def test_declines_are_limited_before_the_shuffle(stored):
    text = plan(rules.declined_then_approved(stored))
    assert "Partial" in text and "collect_list" not in text
    # Both cuts, per pane and per window, are made twice: before their shuffle and after it. In the text the
    # later operator comes first: the limits per window, the copies into windows, the limits per pane.
    places = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    copies = text.index("Generate explode")
    assert sum(at < copies for at in places) == 2 and sum(at > copies for at in places) == 2
    between = text[places[0] : places[1]], text[places[2] : places[3]]
    assert all("Exchange hashpartitioning" in part for part in between)


def test_rules_share_plans(stored):
    text = plan(evaluate(stored, rules=WINDOW_RULES))
    assert text.count("REPARTITION_BY_NUM") == 2  # one per key: card and terminal
    one_by_one = sum(plan(getattr(rules, n)(stored)).count("Exchange") for n in WINDOW_RULES)
    assert text.count("Exchange") < one_by_one / 1.5


def test_dormant_join_is_sized_by_the_planner(spark, stored, tmp_path):
    stored.select("card_id").distinct().write.parquet(str(tmp_path / "d"))
    listed = spark.read.parquet(str(tmp_path / "d"))
    small = plan(rules.dormant_card(stored, listed))
    assert "BroadcastHashJoin" in small and "LeftSemi" in small
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "BroadcastHashJoin" not in plan(rules.dormant_card(stored, listed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_messages_are_parsed_once(spark, tmp_path):
    from txnwatch.sources import ingest

    (tmp_path / "m").mkdir()
    raw = spark.read.schema("value string").text(str(tmp_path / "m"))
    assert plan(ingest.good_rows(ingest.parse(raw))).count("from_json") == 1


def test_all_rules_share_scans(spark, stored, tmp_path):
    stored.select("card_id").distinct().write.parquet(str(tmp_path / "d"))
    listed = spark.read.parquet(str(tmp_path / "d"))
    text = plan(evaluate(stored, dormant=listed))
    # row rules with the card list as a flag; per card totals, all distinct counts, declines; terminals; the list
    assert text.count("FileScan") == 6 and text.count("ReadSchema: struct<card_id:string>") == 1
    assert "ReadSchema: struct<card_id:string,merchant_id:string,country:string,event_time:timestamp>" in text
