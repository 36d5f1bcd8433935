from __future__ import annotations

from casefile.sources import views

FOLDER = "/root/testdata/sf0.001"


def test_lines_of_a_small_file(spark):
    """One small file of customers is read in one task; the patterns are looked for in as many as shuffles have."""
    assert views.table(spark, FOLDER, "customer").rdd.getNumPartitions() == 1
    rows = views.matter_lines(spark, FOLDER).select("matter_id").rdd.glom().map(len).collect()
    assert len(rows) == 4 and min(rows) > 0
