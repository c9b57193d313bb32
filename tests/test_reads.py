"""Usage in windows, subscription periods, the cost overview and AI token rating, against plain Python."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from meterwise.operators import ai_rating, analytics, periods


def ts(text):
    return datetime.fromisoformat(text)


def test_usage_in_windows_equals_a_scan(spark):
    rng = random.Random(3)
    t0 = ts("2026-01-01 00:00:00")
    buckets = [("hot" if rng.random() < 0.5 else f"a{rng.randint(0, 3)}", t0 + timedelta(minutes=rng.randint(0, 9 * 1440)), rng.randint(0, 99)) for _ in range(3000)]
    buckets += [("hot", t0 + timedelta(days=2), None), (None, t0, 5)]
    spans = [("hot", "2026-01-02 00:00:00", "2026-01-05 00:00:00"), ("hot", "2026-01-02 07:30:00", "2026-01-02 09:00:00"),
             ("hot", "2026-01-03 23:59:00", "2026-01-06 00:01:00"), ("a0", "2026-01-01 12:00:00", "2026-01-02 12:00:00"),
             ("a1", "2026-01-04 00:00:00", "2026-01-04 00:00:00"), ("a1", "2026-01-06 00:00:00", "2026-01-04 00:00:00"),
             ("nobody", "2026-01-01 00:00:00", "2026-01-09 00:00:00"), (None, "2026-01-01 00:00:00", "2026-01-09 00:00:00")]
    windows = [(k, ts(s), ts(e)) for k, s, e in spans]
    b = spark.createDataFrame(buckets, "account string, bucket_start timestamp_ntz, total_bytes long")
    w = spark.createDataFrame(windows + windows[:2], "account string, s timestamp_ntz, e timestamp_ntz")
    got = {(r.account, r.s, r.e): r.n for r in periods.usage_in_windows(b, w, "account", "s", "e", "n").collect()}
    assert got == {(k, s, e): sum(n or 0 for a, t, n in buckets if k is not None and a == k and s <= t < e) for k, s, e in windows}
    none = periods.usage_in_windows(b, w.where("false"), "account", "s", "e", "n")
    assert none.collect() == []


def test_periods_follow_the_anchor_through_short_months(spark):
    subs = [("a", "2026-01-31 10:00:00"), ("b", "2026-03-05 00:00:00"), ("b", "2026-01-02 00:00:00"), ("later", "2026-04-01 00:00:00"), ("edge", "2026-02-20 08:00:00")]
    s = spark.createDataFrame([(k, ts(t)) for k, t in subs], "account_uuid string, subscription_start timestamp_ntz")
    accounts = spark.createDataFrame([(k,) for k in ("a", "b", "later", "none", "edge")], "account_uuid string")
    got = {r.account_uuid: (str(r.period_start), str(r.period_end), r.period_source) for r in periods.account_periods(accounts, s, "2026-03-20 08:00:00").collect()}
    month = ("2026-03-01 00:00:00", "2026-04-01 00:00:00", "calendar")
    assert got == {"a": ("2026-02-28 10:00:00", "2026-03-31 10:00:00", "subscription"), "b": ("2026-03-05 00:00:00", "2026-04-05 00:00:00", "subscription"),
                   "edge": ("2026-03-20 08:00:00", "2026-04-20 08:00:00", "subscription"), "later": month, "none": month}


def test_overview_compares_equal_parts_of_two_months(spark):
    rows = [("USD", "x", "2026-01-05", "10"), ("USD", "y", "2026-01-20", "90"), ("USD", "x", "2026-02-05", "30"), ("USD", "y", "2026-02-10", "30"), ("JPY", None, "2026-02-28", "7")]
    daily = spark.createDataFrame([(c, s, ts(d), Decimal(v)) for c, s, d, v in rows], "currency string, service_name string, day timestamp_ntz, cost decimal(38,2)")
    budgets = spark.createDataFrame([("USD", Decimal("120"))], "currency string, budget decimal(18,2)")
    got = {(r.currency, r.month.month): r for r in analytics.cost_overview(daily, budgets).collect()}
    feb = got["USD", 2]
    assert (feb.cost, feb.previous_cost, feb.change, feb.change_ratio, feb.budget_used) == (60, 10, 50, 5.0, 0.5)
    assert (feb.forecast, feb.budget_forecast, feb.top_service, feb.top_cost, feb.services) == (60 / 10 * 28, 60 / 10 * 28 / 120, "x", 30, 2)
    assert (got["USD", 1].previous_cost, got["USD", 1].change_ratio, got["USD", 1].top_service) == (None, None, "y")
    assert (got["JPY", 2].budget, got["JPY", 2].budget_used, got["JPY", 2].top_service, got["JPY", 2].forecast) == (None, None, None, 7.0)


def test_tokens_are_rated_at_the_price_of_their_day(spark):
    use = [("m", "u", "2026-01-01 05:00:00", 1_000_000, 0, 0), ("m", "u", "2026-01-09 23:00:00", 1, 1, 1), ("m", "v", "2026-01-10 00:00:00", 0, 2_000_000, 1_000_000),
           ("n", "v", "2026-01-01 00:00:00", 5, None, 5), (None, None, "2026-02-01 00:00:00", 1, 1, 1)]
    usage = spark.createDataFrame([(m, u, ts(t), *n) for m, u, t, *n in use], "model string, user string, used_at timestamp_ntz, input_tokens long, cached_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", ts("2026-01-01"), Decimal("3"), Decimal("0.5"), Decimal("9")), ("m", ts("2026-01-10"), Decimal("2"), None, Decimal("8"))],
                                   "model string, effective_from timestamp_ntz, input_price decimal(12,6), cached_price decimal(12,6), output_price decimal(12,6)")
    rated = ai_rating.rate_tokens(ai_rating.daily_tokens(usage, ["user"]), prices)
    got = {(r.month.month, r.dim, r.item): (r.cost, r.unpriced_tokens) for r in ai_rating.token_costs(rated, ["user", "model"]).collect()}
    assert got == {(1, "user", "u"): (Decimal("3.000013"), 0), (1, "user", "v"): (Decimal("12"), 10), (1, "model", "m"): (Decimal("15.000013"), 0),
                   (1, "model", "n"): (None, 10), (2, "user", None): (None, 3), (2, "model", None): (None, 3)}
    assert ai_rating.token_costs(rated.where("false"), ["user"]).collect() == []
