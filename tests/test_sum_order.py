"""Sums of doubles whose rounding shows the order in which they are added."""

from marlstone.plans.scores import live_returns


def test_live_returns_add_in_order_of_events(spark):
    values = [1e16, 1.0, -1e16, 1000.0]  # 1000 in this order; 1001 if 1.0 is added after -1e16
    rows = [(k, u, x) for u in range(40) for k, x in enumerate(values)]
    for events in (sorted(rows, key=lambda r: (r[0] % 2, r[0])), rows[::-1], rows):
        got = live_returns(spark.createDataFrame(events, "event_id long, user_id long, value double").repartition(7)).collect()
        assert len(got) == 40 and {r.return_5m for r in got} == {0.25}
