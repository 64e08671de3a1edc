"""All runs of a log are merged."""

from proofsheet.plans import catalog
from proofsheet.plans.views import edits

SF = "/root/testdata/sf0.01"


def test_every_run_is_merged(spark):
    rows = edits(spark, SF).select("run_id", "filename").distinct().collect()
    runs = {}
    for r in rows:
        runs.setdefault(r.filename, []).append(r.run_id)
    want = {(f"run{r.run_id}", r.filename if r.run_id == min(runs[r.filename]) else f"run{r.run_id}__{r.filename}") for r in rows}
    got = [(r.source_run, r.filename) for r in catalog.queries()["merge_runs"](spark, SF).collect()]
    assert len({r.run_id for r in rows}) > 3 and len(got) == len(rows) and set(got) == want
