import random

from siltstone.operators.merkle import merkle_diff
from tests.conftest import rows

SNAP = "collection string, snapshot_no int, delivery_no int, state string, extra string"
FILE = "collection string, snapshot_no int, delivery_no int, relative_path string, content_hash string, ordinal int, leaf string"


def brute(snaps, files):
    """Compare all paths of neighbouring snapshots one by one."""
    last = {}
    for c, n, d, state, _ in snaps:
        if state == "complete" and c is not None:
            last[c, n] = max(last.get((c, n), d), d)
    held = {k: {} for k in last}
    for c, n, d, p, h, *_ in files:
        if p is not None and last.get((c, n)) == d:
            held[c, n][p] = max(filter(None, [held[c, n].get(p), h and h.lower()]), default=None)
    out = set()
    for c in {k[0] for k in last}:
        known, before = {}, None
        for n in sorted(x for y, x in last if y == c):
            now = held[c, n]
            if before is not None:
                out |= {(c, n, p, "new") for p in now.keys() - before.keys()}
                out |= {(c, n, p, "deleted") for p in before.keys() - now.keys()}
            for p in list(known):
                if p not in now:
                    del known[p]
            for p, h in now.items():
                if h is not None:
                    if before is not None and p in before and known.get(p) not in (None, h):
                        out.add((c, n, p, "changed"))
                    known[p] = h
            before = now
    return sorted(out, key=repr)


def test_random_histories(spark):
    rng = random.Random(3)
    snaps, files = [], []
    for c in ("a", "b", "c"):
        live = {f"p{i}": f"{i:04X}" for i in range(120)}
        for n in range(1, 8):
            for p in list(live):
                r = rng.random()
                if r < 0.05:
                    del live[p]
                elif r < 0.12:
                    live[p] = f"{rng.randrange(65536):04x}"
                elif r < 0.16:
                    live[p] = None
            live |= {f"q{n}-{i}": f"{i:04x}" for i in range(rng.randrange(4))}
            state = rng.choice(["complete", "complete", "complete", "partial", "failed"])
            snaps.append((c, n * 2, 1, state, "x"))
            files += [(c, n * 2, 1, p, h if h is None or rng.random() < 0.5 else h.upper(), 9, "z") for p, h in live.items()]
            if rng.random() < 0.3:
                snaps.append((c, n * 2, 2, "complete", "x"))
                files += [(c, n * 2, 2, p, h, 9, "z") for p, h in live.items() if rng.random() < 0.9]
    files += rng.sample(files, 60)
    snaps += snaps[:4] + [("a", 99, 1, "complete", None), (None, 1, 1, "complete", None), ("a", None, 1, "complete", None)]
    files += [("a", 2, 1, None, "ff", 0, ""), (None, 2, 1, "p", "ff", 0, "")]
    got = merkle_diff(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(files, FILE))
    want = brute([s for s in snaps if None not in s[:3]], files)
    assert rows(got, "collection", "snapshot_no", "relative_path", "change_kind") == want


def test_empty_tables_and_emptied_snapshot(spark):
    none = merkle_diff(spark.createDataFrame([], SNAP), spark.createDataFrame([], FILE))
    assert none.count() == 0 and none.columns == ["collection", "snapshot_no", "relative_path", "change_kind"]
    snaps = [("a", 1, 1, "complete", ""), ("a", 2, 1, "complete", ""), ("a", 3, 1, "complete", "")]
    files = [("a", 1, 1, "x" * 5000, "ab", 0, ""), ("a", 3, 1, "x" * 5000, "ab", 0, "")]
    got = merkle_diff(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(files, FILE))
    assert [r[1::2] for r in rows(got, "collection", "snapshot_no", "relative_path", "change_kind")] == [(2, "deleted"), (3, "new")]
    assert merkle_diff(spark.createDataFrame(snaps, SNAP), spark.createDataFrame([], FILE)).count() == 0
