import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from helpers import events, usage
from pyspark.sql import functions as F

from turnledger.functions.dates import day_bounds, last_days, local_day, week_label
from turnledger.functions.paths import file_stem, plain_path, project_from_path, project_label
from turnledger.plans import recipes, reports
from turnledger.plans.adhoc import as_json, query, register_views, write_json
from turnledger.plans.coverage import coverage, ledger_meta, under_roots
from turnledger.schema import MANIFEST, SCAN_STATE, TOKEN_COLS
from turnledger.session import shared_dir
from turnledger.sources.files import Source
from turnledger.sources.pricing import bundled_pricing


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_local_days_match_the_zone_rules(spark):
    zone = ZoneInfo("America/New_York")
    rng = random.Random(1)
    stamps = [rng.randrange(0, 2_000_000_000) for _ in range(2000)]
    # Around both clock changes of 2024, second by second near midnight.
    stamps += [1_710_046_800 + d for d in range(-7_200, 18_000, 599)]
    stamps += [1_730_606_400 + d for d in range(-7_200, 18_000, 599)]
    got = apply(spark, stamps, lambda c: local_day(c, "America/New_York"), "bigint")
    assert got == [dt.datetime.fromtimestamp(s, zone).date() for s in stamps]


def test_week_labels(spark):
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(6_575)]
    got = apply(spark, days, week_label, "date")
    assert got == [d.strftime("%Y-W%W") for d in days]


def test_day_bounds_contain_the_days():
    low, high = day_bounds("2024-03-10", "2024-03-10")
    for zone in ("Pacific/Kiritimati", "Etc/GMT+12", "UTC"):
        start = dt.datetime(2024, 3, 10, tzinfo=ZoneInfo(zone)).timestamp()
        assert low <= start and start + 86_399 < high
    assert day_bounds(None, None) == (None, None)
    assert last_days("2024-03-07", 7) == "2024-03-01"


def test_paths(spark):
    assert apply(spark, ["file:///a/b%20c%2Bd+e%25.jsonl"], plain_path) == ["/a/b c+d+e%.jsonl"]
    assert apply(spark, ["/a/b.jsonl", "/a/b.txt", "b.jsonl"], file_stem) == ["b", "b.txt", "b"]
    paths = {
        "/h/projects/-home-dev/s/x.jsonl": "/home/dev",
        "/h/projects/plain-name/x.jsonl": "plain-name",
        "/projects/a/projects/-b/x.jsonl": "/b",
        "/h/other/x.jsonl": "other",
        "/myprojects/-a/x.jsonl": "/a",
        "x.jsonl": None,
    }
    assert apply(spark, list(paths), project_from_path) == list(paths.values())
    labels = {"/a/b": "b", "c:\\d\\e": "e", "/a/": "/a/", "solo": "solo"}
    assert apply(spark, list(labels), project_label) == list(labels.values())
    roots = ["/a_b", "/c/"]
    inside = {"/a_b/x": True, "/axb/x": False, "/a_bc/x": False, "/c/x": True, "/cx": False}
    assert apply(spark, list(inside), lambda c: under_roots(c, roots)) == list(inside.values())


def month_of_turns(spark):
    day = 86_400
    return events(
        spark,
        [
            usage(f"k{i}", "t", f"s{i % 3}", i * day, (i, 2 * i, 0, 3 * i, 1 if i else 0), i)
            for i in range(30)
        ],
    )


def test_cache_band_keeps_the_last_days(spark):
    days = reports.by_day(month_of_turns(spark))
    rows = reports.cache_band(days).collect()
    assert len(rows) == 21 and rows[0]["date"] == "1970-01-10"
    cache = sum(3 * i for i in range(9, 30))
    total = sum(6 * i + 1 for i in range(9, 30))
    assert rows[0]["overall_cached"] == pytest.approx(cache / total)
    assert rows[-1]["fresh_share"] == pytest.approx(29 / (6 * 29 + 1))
    # The empty first day is an active day but gives no row.
    assert len(reports.cache_band(days, 30).collect()) == 29


def test_breakdown_drops_empty_classes(spark):
    sessions = reports.session_totals(month_of_turns(spark), bundled_pricing(spark))
    rows = reports.session_breakdown(sessions).collect()
    assert {r["component"] for r in rows} == {"cache read", "input", "output", "reasoning"}
    per_session = {}
    for r in rows:
        per_session[r["session_id"]] = per_session.get(r["session_id"], 0) + r["token_share"]
    assert all(v == pytest.approx(1) for v in per_session.values())


def test_sessions_limit_must_be_a_number(spark):
    for bad in ("ten", True, None):
        with pytest.raises(ValueError, match="limit must be a number"):
            reports.sessions_report(month_of_turns(spark), bundled_pricing(spark), limit=bad)


def test_empty_ratio_is_null(spark):
    turns = events(spark, [usage("a", "t", "s", 0, (0, 5, 0, 0, 0))])
    row = recipes.cache_ratio_by_day(turns).first()
    assert (row["cache_ratio"], row["cached"], row["fresh"]) == (None, 0, 0)


def test_adhoc_queries(spark, tmp_path):
    turns = month_of_turns(spark)
    register_views(spark, turns, turns, spark.createDataFrame([], SCAN_STATE), tz="Asia/Tokyo")
    result = query(spark, "SELECT line_no, local_day(ts) AS day FROM turn_usage ORDER BY line_no;", cap=10)
    assert result.columns == ["line_no", "day"]
    assert len(result.fetch()) == 10 and result.truncated() and result.total_rows() == 30
    exact = query(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a -- done", cap=1)
    assert not exact.truncated() and exact.fetch()[0]["x"] == 1
    empty = query(spark, "SELECT source_file, size FROM scan_state WHERE size < 0")
    assert empty.columns == ["source_file", "size"] and empty.fetch() == []
    for refused in (
        "DROP VIEW turn_usage",
        "INSERT INTO usage_events VALUES (1)",
        "SELECT 1; DROP VIEW turn_usage",
        "CREATE TABLE x AS SELECT 1",
        "DELETE FROM usage_events",
    ):
        with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
            query(spark, refused)
    with pytest.raises(ValueError):
        query(spark, "  ")
    whole = query(spark, "SELECT line_no FROM turn_usage", cap=None)
    assert len(whole.fetch()) == whole.total_rows() == 30 and not whole.truncated()
    nested = query(
        spark,
        "WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) "
        "SELECT x FROM b WHERE x < (SELECT max(line_no) FROM turn_usage)",
    )
    assert [r["x"] for r in nested.fetch()] == [1]
    spark.range(3).createOrReplaceTempView("elsewhere")
    for refused in (
        "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')",
        "SELECT `reflect`('java.lang.System', 'getenv', 'HOME') FROM turn_usage",
        "SELECT 1 FROM turn_usage WHERE (SELECT max(try_reflect('java.lang.Math', 'abs', -1)) FROM scan_state) = '1'",
        "SELECT value FROM text.`/etc/hostname`",
        "SELECT * FROM elsewhere",
        "SELECT (SELECT max(id) FROM elsewhere) FROM turn_usage",
        "SELECT 1 FROM turn_usage WHERE EXISTS (SELECT 1 FROM text.`/etc/hostname`)",
        "WITH a AS (SELECT * FROM elsewhere) SELECT * FROM a",
    ):
        with pytest.raises(PermissionError):
            query(spark, refused)
    with pytest.raises(ValueError, match="time zone"):
        register_views(spark, turns, turns, tz="Nowhere/Else")

    json_rows = as_json(spark.sql("SELECT 1 AS a, cast(null AS string) AS b"))
    assert json_rows.first()["value"] == '{"a":1,"b":null}'
    write_json(spark.sql("SELECT 1 AS a, cast(null AS string) AS b"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"a":1,"b":null}'


def test_sums_are_exact_and_stop_at_64_bits(spark):
    counts = [2**53, 2**53 - 1, 1, 0, 10**13, 67_108_863, 67_108_864]
    rows = [usage(f"k{i}", "opencode", "s", i, (counts[i % 7], 2**53, 1, 0, i), i) for i in range(2100)]
    turns = events(spark, rows)
    report = reports.daily_report(turns, bundled_pricing(spark))
    row, total = report.rows.first(), report.totals.first()
    want = [300 * sum(counts), min(2100 * 2**53, 2**63 - 1), 2100, 0, sum(range(2100))]
    assert [row[c] for c in TOKEN_COLS] == [total[c] for c in TOKEN_COLS] == want
    assert row["total_tokens"] == total["total_tokens"] == 2**63 - 1
    assert recipes.output_by_tool(turns).first()["output"] == 2**63 - 1
    days = reports.by_day(turns)
    assert reports.cache_band(days).count() == 1 and reports.trend(days).count() == 1
    assert reports.by_tool(turns, bundled_pricing(spark)).first()["total_tokens"] == 2**63 - 1
    none = reports.daily_report(events(spark, []), bundled_pricing(spark)).totals.first()
    assert [none[c] for c in TOKEN_COLS] == [0] * 5


@pytest.fixture
def views(spark):
    turns = month_of_turns(spark)
    register_views(spark, turns, turns, spark.createDataFrame([], SCAN_STATE))
    spark.range(3).createOrReplaceTempView("elsewhere")
    spark.range(3).createOrReplaceGlobalTempView("usage_events")
    spark.udf.register("own_code", lambda x: x)
    return spark


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT * FROM IDENTIFIER('else' || 'where')",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME')",
        "SELECT * FROM json.`/etc/hostname`",
        "SELECT * FROM turn_usage JOIN parquet.`/tmp` USING (line_no)",
        "SELECT * FROM global_temp.usage_events",
        "SELECT * FROM turn_usage, LATERAL (SELECT * FROM elsewhere)",
        "SELECT line_no IN (SELECT id FROM elsewhere) FROM turn_usage",
        "FROM elsewhere |> SELECT id",
        "TABLE elsewhere",
        "SELECT * FROM range(3)",
        "WITH elsewhere AS (SELECT 1 AS id) SELECT * FROM (WITH b AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM b)",
        "SELECT own_code(1)",
        "SELECT sum(own_code(line_no)) OVER () FROM turn_usage",
        "SELECT Java_Method('java.lang.Math', 'abs', -1) FROM turn_usage",
        "SELECT max(line_no) FROM turn_usage HAVING reflect('java.lang.Math', 'abs', -1) = '1'",
    ],
)
def test_statements_that_read_elsewhere_are_refused(views, statement):
    with pytest.raises(PermissionError):
        query(views, statement)


@pytest.mark.parametrize(
    "statement,first",
    [
        ("SELECT 'reflect(' AS x", "reflect("),
        ("SELECT 'text.`/etc/hostname`' AS x, \"'UnresolvedRelation [elsewhere]\" AS y", "text.`/etc/hostname`"),
        ("SELECT count(*) AS x FROM Turn_Usage t JOIN usage_events e USING (dedupe_key)", 30),
        ("WITH elsewhere AS (SELECT 7 AS id) SELECT id AS x FROM elsewhere", 7),
        ("SELECT * FROM VALUES (3), (4) AS v(x)", 3),
        ("WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT max(x) AS x FROM n", 5),
        ("SELECT (SELECT max(line_no) FROM turn_usage) AS x", 29),
        ("SELECT count(*) AS x FROM turn_usage WHERE EXISTS (SELECT 1 FROM usage_events)", 30),
        ("SELECT count(*) AS x FROM (SELECT explode(sequence(1, 3)) FROM turn_usage)", 90),
        ("SELECT max(local_day(ts) > DATE'1900-01-01') AS x FROM turn_usage", True),
    ],
)
def test_statements_over_the_relations_run(views, statement, first):
    assert query(views, statement).fetch()[0]["x"] == first


def test_coverage(spark):
    rows = [
        usage("a", "codex", "s", 1, (1, 1, 1, 1, 1), model="gpt-5"),
        usage("b", "codex", "s", 2, (1, 1, 1, 1, 1), model="house"),
    ]
    state = spark.createDataFrame(
        [("/l/codex/a", 1, 1, 1, 50), ("/l/codex_old/b", 1, 1, 1, 70)], SCAN_STATE
    )
    manifest = spark.createDataFrame(
        [("codex", "/l/codex/a", 1, 1), ("codex", "/l/codex/c", 1, 1)], MANIFEST
    )
    sources = [Source("codex", ("/l/codex",))]
    pricing = bundled_pricing(spark)
    got = [
        tuple(r)
        for r in coverage(events(spark, rows), state, manifest, sources, pricing, {"codex": True}).collect()
    ]
    assert got == [
        ("claude_code", 0, 0, [], [], False, []),
        ("codex", 2, 1, ["gpt-5", "house"], ["house"], True, ["/l/codex"]),
        ("opencode", 0, 0, [], [], False, []),
    ]
    assert tuple(ledger_meta(events(spark, rows), state, pricing).first())[:2] == (2, 70)
    never = ledger_meta(events(spark, []), spark.createDataFrame([], SCAN_STATE), pricing).first()
    assert tuple(never)[:2] == (0, None)


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
