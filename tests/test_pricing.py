import json
from decimal import Decimal

from helpers import events, usage

from turnledger.operators.costs import resolve_rates, with_cost, with_rates
from turnledger.plans.reports import by_tool, daily_report, sessions_report
from turnledger.sources.price_list import PRICE_LIST
from turnledger.schema import TOKEN_COLS
from turnledger.sources.pricing import PRICES, Pricing, bundled_pricing, load_pricing, pricing_from_table

MODELS = [
    "claude-opus-4-5",
    "claude-opus-4-5-20260101",
    "claude-opus-4-20250101",
    "gpt-5-mini-2025",
    "gpt-5",
    "o3-pro",
    "GPT-5",
    "house-model",
    "gpt-4",
    "",
]


def longest(model):
    return max((p for p in PRICE_LIST if model.startswith(p)), key=len, default=None)


def test_join_and_inline_lookup_agree_with_brute_force(spark):
    pricing = bundled_pricing(spark)
    models = spark.createDataFrame([(m,) for m in MODELS], "model string")
    joined = {r["model"]: r["rates"] for r in resolve_rates(models, pricing.table()).collect()}
    inline = {r["model"]: r["rates"] for r in with_rates(models, pricing).collect()}
    assert joined == inline
    for model in MODELS:
        prefix = longest(model)
        assert (joined[model] or {"matched_prefix": None})["matched_prefix"] == prefix
        if prefix:
            assert tuple(joined[model])[1:] == tuple(Decimal(r) for r in PRICE_LIST[prefix])


def test_large_tables_are_joined(spark):
    small = bundled_pricing(spark)
    large = Pricing(spark, small.updated, None, small.table())
    df = events(spark, [usage("a", "t", "s", 1, (10, 20, 30, 40, 50), model="claude-opus-5-x")])
    assert (
        with_cost(df, large).select("micros", "matched_prefix").collect()
        == with_cost(df, small).select("micros", "matched_prefix").collect()
        == [(Decimal("10") * 5 + 20 * 25 + Decimal("187.5") + 20 + 50 * 25, "claude-opus-5")]
    )


def test_price_file(spark, tmp_path):
    path = tmp_path / "prices.json"
    rates = {"input": 2.5, "output": 10, "cache_write": 0, "cache_read": 0.125}
    path.write_text(json.dumps({"updated": "2026-01-01", "note": "n", "models": {"m'1": rates}}, indent=1))
    pricing = load_pricing(spark, str(path))
    assert pricing.updated == "2026-01-01"
    df = events(spark, [usage("a", "t", "s", 1, (2, 1, 5, 8, 1), model="m'1-x")])
    assert with_cost(df, pricing).first()["micros"] == Decimal("26.0")


def test_unreadable_price_file_prices_nothing(spark, tmp_path):
    pricing = load_pricing(spark, str(tmp_path / "absent.json"))
    assert pricing.updated == "unknown" and pricing.table().count() == 0
    df = events(spark, [usage("a", "t", "s", 1, (1, 1, 1, 1, 1))])
    report = daily_report(df, pricing)
    assert report.rows.first()["cost_usd"] is None
    assert [r["model"] for r in report.unknown_models.collect()] == ["gpt-5"]


def test_unpriced_part_makes_totals_unknown(spark):
    day = 86_400
    rows = [
        usage("a", "x", "s", day, (1_000_000, 0, 0, 0, 0)),
        usage("b", "x", "s", day, (5, 0, 0, 0, 0), 1, model="house"),
        usage("c", "y", "s2", day, (1_000_000, 0, 0, 1_000_000, 0), 2),
        usage("d", "y", "s2", 2 * day, (0, 0, 0, 0, 0), 3, model="house"),
    ]
    turns, pricing = events(spark, rows), bundled_pricing(spark)
    report = daily_report(turns, pricing)
    assert [(r["date"], r["tool"], r["cost_usd"]) for r in report.rows.collect()] == [
        ("1970-01-02", "x", None),
        ("1970-01-02", "y", 1.375),
        ("1970-01-03", "y", None),
    ]
    total = report.totals.first()
    assert (total["date"], total["input_tokens"], total["cost_usd"]) == ("TOTAL", 2_000_005, None)
    tools = {r["tool"]: r for r in by_tool(turns, pricing).collect()}
    # A priced part stays as a floor; without any priced day there is no floor to show.
    assert (tools["y"]["cost_floor_usd"], tools["y"]["has_unpriced"]) == (1.375, True)
    assert (tools["x"]["cost_floor_usd"], tools["x"]["has_unpriced"]) == (None, True)
    assert tools["y"]["active_days"] == 2 and tools["x"]["bar"] < 1 == tools["y"]["bar"]


def test_no_rows_total_zero(spark):
    report = daily_report(events(spark, []), bundled_pricing(spark))
    assert report.rows.count() == 0
    total = report.totals.first()
    assert (total["total_tokens"], total["cost_usd"]) == (0, 0.0)


def test_sidechain_turns_roll_into_their_session(spark):
    turns = [
        ("opus", False, (3, 11, 0, 90, 0)),
        ("sonnet", True, (1, 7, 25, 0, 0)),
        ("haiku", True, (0, 2, 25, 5, 1)),
    ]
    rows = [
        usage(f"k{i}", "claude_code", "one", 500 - i, tokens, i, model=f"claude-{m}-4-5", is_sidechain=side)
        for i, (m, side, tokens) in enumerate(turns)
    ]
    (got,) = sessions_report(events(spark, rows), bundled_pricing(spark)).rows.collect()
    assert [got[c] for c in TOKEN_COLS] == [4, 20, 50, 95, 1]
    assert (got["turns"], got["sidechain_turns"]) == (3, 2)
    assert got["models"] == ["claude-haiku-4-5", "claude-opus-4-5", "claude-sonnet-4-5"]
    assert (got["first_ts"], got["last_ts"]) == (498, 500)


def test_missing_and_repeated_rates(spark):
    table = spark.createDataFrame(
        [
            ("m-", Decimal(1), Decimal(2), None, Decimal(4)),
            ("m-a", Decimal(5), Decimal(6), Decimal(7), Decimal(8)),
            ("m-a", Decimal(5), Decimal(7), Decimal(1), Decimal(1)),
            (None, Decimal(1), Decimal(1), Decimal(1), Decimal(1)),
        ],
        PRICES,
    )
    small = pricing_from_table("now", table)
    large = Pricing(spark, "now", None, small.table())
    rows = [
        usage("a", "t", "s", 1, (1, 1, 0, 0, 0), model="m-a1"),
        usage("b", "t", "s", 2, (1, 1, 0, 0, 0), model="m-b"),
        usage("c", "t", "s", 3, (1, 1, 0, 0, 0), model="other"),
    ]
    got = [
        {r["model"]: r["micros"] for r in with_cost(events(spark, rows), p).collect()} for p in (small, large)
    ]
    # Without one of its rates a cost is unknown, in both plans alike.
    assert got[0] == got[1] == {"m-a1": Decimal(12), "m-b": None, "other": None}


def test_price_file_without_a_rate(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps({"updated": "x", "models": {"m": {"input": 1, "output": 2, "cache_read": 3}}}))
    df = events(spark, [usage("a", "t", "s", 1, (1, 1, 1, 1, 1), model="m")])
    assert with_cost(df, load_pricing(spark, str(path))).first()["micros"] is None
