"""Reports make their candidates and their plan once."""

from casefile.plans.catalog import load
from casefile.sources import views

SMALL = "/root/testdata/sf0.001"


def test_reports_make_candidates_once(spark, monkeypatch):
    calls, made = [], views.candidates
    monkeypatch.setattr(views, "candidates", lambda *a: calls.append(1) or made(*a))
    for name in ("manifest_rows", "build_report"):
        load().queries[name].run(spark, SMALL)
        assert len(calls) == 1, name
        calls.clear()
