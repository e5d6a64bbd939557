"""K-means for many numbers of centres in shared passes.

All ``k`` advance together: a scan over the weighted points finds, for every k, each point's nearest centre, and returns
sums per (k, centre), a few thousand rows whatever the number of points. Centres start from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Points of the sample that the first centres come from (those drawn by weight), and most passes.
SAMPLE = 10_000
PASSES = 30


def _distances(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((at[:, None, :] - centres[None, :, :]) ** 2).sum(2)


def spread(sample: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres one after the other, each drawn among the points by weight times squared distance to those before; the
    first j are the start for j centres. Fewer if there are fewer distinct points."""
    chosen = [sample[np.argmax(weight)]]
    near = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and (near * weight).max() > 0:
        p = near * weight
        chosen.append(sample[rng.choice(len(sample), p=p / p.sum())])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _sums(centres: dict[int, np.ndarray]):
    """Task over (lat, lon, weight): per k and centre the sums of weight, weighted coordinates and cost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(c), 4)) for k, c in centres.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                at = np.column_stack([part.column(c).to_numpy() for c in ("lat", "lon")])
                w = part.column("weight").to_numpy()
                for k, c in centres.items():
                    d = _distances(at, c)
                    own = d.argmin(1)
                    for j, x in enumerate((w, w * at[:, 0], w * at[:, 1], w * d[np.arange(len(at)), own])):
                        total[k][:, j] += np.bincount(own, x, len(c))
        rows = [(k, j, *map(float, x)) for k, t in total.items() for j, x in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["k", "c", "w", "lat", "lon", "cost"])
    return run


def _pass(points: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """The means that the points nearest to each centre have, and the cost, for every k, from one scan."""
    parts = points.mapInArrow(_sums(centres), "k long, c long, w double, lat double, lon double, cost double")
    got = parts.groupBy("k", "c").agg(*(F.sum(x).alias(x) for x in ("w", "lat", "lon", "cost"))).collect()  # a row per centre
    moved, cost = {k: c.copy() for k, c in centres.items()}, dict.fromkeys(centres, 0.0)
    for r in got:
        cost[r["k"]] += r["cost"]
        if r["w"] > 0:
            moved[r["k"]][r["c"]] = r["lat"] / r["w"], r["lon"] / r["w"]
    return moved, cost


def fit_many(points: DataFrame, ks: Sequence[int], seed: int = 42, passes: int = PASSES, tolerance: float = 1e-9) -> dict[int, tuple[np.ndarray, float]]:
    """k -> (centres, cost) for weighted points (lat, lon, weight), costs never rising with k; {} without points.

    If a k ends worse than a smaller one, it starts again from that one's centres and the sample's point farthest from
    them, which cannot cost more; such rounds are shared by all k that need them.
    """
    # by weight: the smallest of -log(u) / weight with a hashed u
    u = (F.pmod(F.xxhash64("lat", "lon", F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = points.where("weight > 0").withColumn("_u", -F.log(u) / F.col("weight")).orderBy("_u", "lat", "lon").limit(SAMPLE).select("lat", "lon", "weight").collect()
    if not drawn:
        return {}
    sample = np.array([(r["lat"], r["lon"]) for r in drawn], float)
    first = spread(sample, np.ones(len(sample)), max(ks), np.random.default_rng(seed))
    now = {k: first[:k] for k in ks}
    for _ in range(passes):
        moved, cost = _pass(points, now)
        if all(np.abs(moved[k] - now[k]).max() <= tolerance for k in ks):
            break
        now = moved
    else:
        cost = _pass(points, now)[1]
    while True:
        worse, best = {}, None
        for k in sorted(ks):
            if best is not None and cost[k] > cost[best] * (1 + 1e-9):
                near = _distances(sample, now[best]).min(1)
                extra = sample[np.argsort(-near, kind="stable")[:k - len(now[best])]]
                worse[k] = np.concatenate([now[best], extra])[:max(k, len(now[best]))]
            else:
                best = k
        if not worse:
            least = dict(zip(sorted(ks), np.minimum.accumulate([cost[k] for k in sorted(ks)]).tolist()))  # equal costs differ by rounding
            return {k: (now[k], least[k]) for k in ks}
        moved, _ = _pass(points, worse)
        again = _pass(points, moved)[1]
        for k in worse:
            now[k], cost[k] = moved[k], again[k]
