"""Reports on duplicates from class rows against the same from all pairs, with shared paths and a large class."""

import random

from pyspark.sql import functions as F

from vitrine.operators import duplicates as DUP

ITEMS = "id long, path string, size long, mtime long, content_hash string, found_hash string, on_disk boolean, deleted_at string"


def items(spark):
    rnd = random.Random(1)
    rows = [(i, f"/lib/{rnd.choice('abc')}/{rnd.choice('XYx')}/{rnd.randint(0, 30)}.jpg", rnd.randint(1, 4), rnd.randint(0, 1), rnd.choice([None, "", f"h{rnd.randint(0, 20)}"]), rnd.choice([None, "", f"h{rnd.randint(0, 20)}"]), rnd.random() < 0.8, "gone" if rnd.random() < 0.1 else None) for i in range(400)]
    rows += [(1000 + i, f"/lib/a/big/{i}.jpg", 7, 0, "big", None, True, None) for i in range(50)]
    return spark.createDataFrame(rows, ITEMS)


def test_reports_equal_those_from_pairs(spark):
    i = items(spark)
    scan = DUP.scanned(i, "/lib/a", True)
    pairs = [tuple(r) for r in DUP.pairs(i, scan).select("id", "path", "other_id", "other_path", "other_size", "basis").collect()]
    found = DUP.members(i, scan)
    count = {}
    for p in pairs:
        count[p[0], p[5]] = count.get((p[0], p[5]), 0) + 1
    assert {(r["id"], r["basis"]): r["duplicates"] for r in DUP.duplicate_files(found).collect()} == count and len(count) > 60
    inside = lambda p: p.startswith("/lib/a/")
    sizes = {}
    for p in pairs:
        sizes[p[3]] = max(sizes.get(p[3], 0), p[4])
    folders = {}
    for path, size in sizes.items():
        f = folders.setdefault(path.rsplit("/", 1)[0], [0, 0, 0, 0])
        f[0], f[1], f[2 + (not inside(path))] = f[0] + 1, f[1] + size, f[2 + (not inside(path))] + 1
    assert {r["folder"]: [r["paths"], r["bytes"], r["inside"], r["outside"]] for r in DUP.folder_summaries(found, "/lib/a", True).collect()} == folders
    low = {}
    for p in pairs:
        low[p[3].lower()] = max(low.get(p[3].lower(), (0, False)), (p[4], inside(p[3])))
    r = DUP.inside_outside(found, "/lib/a").first()
    assert (r["files_inside"], r["files_outside"]) == (len({p[0] for p in pairs if inside(p[3])}), len({p[0] for p in pairs if not inside(p[3])}))
    assert r["bytes_inside"] + r["bytes_outside"] == sum(v[0] for v in low.values())
    partner = {}
    for p in pairs:
        partner.setdefault(p[0], []).append(p[2])
    path = {p[0]: p[1] for p in pairs}
    here = lambda k: path[k].rsplit("/", 1)[0].lower() == "/lib/a/x"
    shown = {k for k, v in partner.items() if not (len(v) == 1 and partner.get(v[0]) == [k]) or (here(k) if here(k) != here(v[0]) else k < v[0])}
    assert {r["id"] for r in DUP.collapsed(found, "/lib/a/x").collect()} == shown
    marked = i.where("id % 3 = 0").select("id")
    others = {p[2]: (p[3], p[4]) for p in pairs if p[2] % 3 == 0}
    assert tuple(DUP.marked_totals(found, marked).first()) == (len(others), len({p.rsplit("/", 1)[0] for p, _ in others.values()}), sum(s for _, s in others.values()))
    left = {}
    for p in pairs:
        if p[0] % 3 and p[2] % 3:
            left[p[0]] = left.get(p[0], 0) + 1
    assert {r["id"]: r["duplicates"] for r in DUP.left_after_deletion(found, marked).collect()} == left
    empty = DUP.members(i.where(F.lit(False)), scan.where(F.lit(False)))
    assert DUP.duplicate_files(empty).count() == 0 and DUP.inside_outside(empty, "/lib").first()["files_inside"] == 0
