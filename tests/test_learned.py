"""The verdict over all tests: its steps are worked out once, stored without their shuffles, and removed."""

import os

from tidemark.operators import events
from tidemark.plans import learned, models, state
from tidemark.plans.bindings import Tables


def test_verdict_steps(spark, sf_dir, tmp_path, monkeypatch):
    calls, returns = [], events.forward_returns
    monkeypatch.setattr(events, "forward_returns", lambda *a, **k: calls.append(a) or returns(*a, **k))
    seen = {}

    class Watched(learned.Landed):
        def __init__(self, spark, what):
            super().__init__(spark, what)
            self.path = f"{tmp_path}/{what}"

        def stored(self, df):
            out = super().stored(df)
            seen[self.path] = len(os.listdir(self.path))
            return out

    monkeypatch.setattr(learned, "Landed", Watched, raising=False)
    t = Tables(spark, sf_dir)
    r = learned.overall_verdict(t).first()
    assert len(calls) == 1
    assert len(seen) == 2 and not any(os.path.exists(p) for p in seen)
    base, wins, told = state.base_rate_differential(t).first(), models.win_rate_boosted(t).first(), learned.gbt_walk_forward(t).collect()
    assert (r.control, r.win_rate_pct) == (base.control, wins.win_rate_pct)
    assert r.accuracy_pct == round(100 * sum(x.accuracy for x in told) / len(told), 2)
    validated = base.meaningful and wins.viable and sum(x.accuracy for x in told) / len(told) > 0.55
    assert ("VALIDATED" in r.verdict) == bool(validated)
