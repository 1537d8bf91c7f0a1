import random

import pytest

from textloom.operators import reports as R


@pytest.mark.parametrize("rows_of_a_range", [7, 1000, 10**6])
def test_numbers_and_totals_do_not_depend_on_the_ranges(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(R, "RANGE_ROWS", rows_of_a_range)
    rnd = random.Random(2)
    rows = [(rnd.randrange(40), i, rnd.randrange(9), str(rnd.randrange(300))) for i in range(500)]
    table = spark.createDataFrame(rows, "a int, b long, v int, s string").repartition(5)
    want = {r[1]: n for n, r in enumerate(sorted(rows), 1)}
    assert {r["b"]: r["rank"] for r in R.numbered(table, ["a", "b"]).collect()} == want
    by_text = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[1])), 1)}
    assert {r["b"]: r["rank"] for r in R.numbered(table, ["s", "b"]).collect()} == by_text
    total, sums = 0, {}
    for r in sorted(rows):
        total += r[2]
        sums[r[1]] = total
    assert {r["b"]: r["total"] for r in R.running_total(table, ["a", "b"], "v").collect()} == sums
    assert R.numbered(table.limit(0), ["a", "b"]).count() == 0
