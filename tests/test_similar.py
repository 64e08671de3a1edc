"""Clusters, places and tracks over all rows, by brute force."""

import math
from collections import defaultdict
from statistics import median

from proofsheet.plans import catalog
from proofsheet.plans.views import photos, vectors

SF = "/root/testdata/sf0.001"


def km(a, b):
    la, lo, lb, lob = (math.radians(x) for x in (*a, *b))
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2)))


def test_every_member_of_a_cluster(spark):
    rows = vectors(spark, SF).select("vec_id", "label", "embedding").collect()
    want = {}
    for a in rows:
        cos = [sum(x * y for x, y in zip(a.embedding, b.embedding, strict=True)) for b in rows if b.label == a.label and b.vec_id != a.vec_id]
        if cos:
            want[a.vec_id] = (median(cos), min(cos))
    got = {r.vec_id: (r.mid, r.low) for r in catalog.queries()["cluster_precision"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 2e-5 for k in got for x, y in zip(got[k], want[k], strict=True))


def test_every_photo_has_a_place(spark):
    at = {r.photo_id: (40 + (r.photo_id * 7 % 97) * 0.01, 2 + (r.photo_id * 13 % 101) * 0.01) for r in photos(spark, SF).select("photo_id").collect()}
    up = {k: k for k in at}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(at)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if abs(at[a][0] - at[b][0]) < 0.05 and km(at[a], at[b]) <= 3.0:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.photo_id: r.place_id for r in catalog.queries()["gps_clusters"](spark, SF).collect()}
    assert got == {k: find(k) for k in at}
    assert sum(r.n for r in catalog.queries()["location_summary"](spark, SF).collect()) == len(at)
    length = defaultdict(float)
    for k in keys:
        if k - 5 in at:
            length[k % 5] += km(at[k - 5], at[k])
    assert {r.track: round(r.km, 3) for r in catalog.queries()["track_length"](spark, SF).collect()} == {k: round(v, 3) for k, v in length.items()}
