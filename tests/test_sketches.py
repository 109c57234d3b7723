"""Sketches keep every node that has a link, wherever its batch ends, and leave out most others."""

import numpy as np
import pyarrow as pa

from corpusq.plans import linkage


def _rows(rng):
    out = []
    for key in range(60):
        base = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))
        for node in range(int(rng.integers(2, 7))):
            keep = base[rng.random(len(base)) < rng.choice([0.5, 0.8, 0.95])]
            s = np.unique(np.concatenate((keep, rng.integers(0, 1 << 62, 20).astype(np.uint64))))
            component = 1000 * key + int(rng.integers(0, 4))
            out.append((key, 0, int(key % 2), 2 if key % 2 == 0 else min(node % 2, 1), 100 * key + node, component, s))
    return sorted(out, key=lambda r: r[:5])


def test_no_link_is_left_out():
    rows = _rows(np.random.default_rng(5))
    t = pa.table({
        "key": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([r[1] for r in rows], pa.int32()), "j": pa.array([r[2] for r in rows], pa.int32()),
        "side": pa.array([r[3] for r in rows], pa.int32()), "node": pa.array([r[4] for r in rows], pa.int64()), "component": pa.array([r[5] for r in rows], pa.int64()),
        "n": pa.array([len(r[6]) for r in rows], pa.int64()), "sketch": pa.array([linkage.sketch(r[6]).tobytes() for r in rows], pa.binary()),
    })
    linked = set()
    for x in rows:
        for y in rows:
            if x[:3] == y[:3] and x[4] < y[4] and x[5] != y[5] and (x[3] == 2 or x[3] != y[3]):
                both = len(np.intersect1d(x[6], y[6]))
                if 100 * both >= 80 * (len(x[6]) + len(y[6]) - both):
                    linked |= {x[4], y[4]}
    found = [
        {n for b in linkage._chances(80)(iter(t.to_batches(max_chunksize=size))) for n in b.column(4).to_pylist()}
        for size in (1, 7, 1000)
    ]
    assert linked and found[0] == found[1] == found[2] and linked <= found[0]
    assert len(found[0]) < len(rows) / 2
