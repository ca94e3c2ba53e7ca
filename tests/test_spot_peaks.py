import numpy as np

from spark_rca.functions.numeric import gpd_fit, tail_level
from spark_rca.streaming.spot import Spot


def test_all_peaks_are_kept():
    rng = np.random.default_rng(31)
    v = rng.exponential(size=4200)
    spot = Spot(q=1e-5, level=0.5)
    spot.fit(v)
    upper, _, alarm = spot.step(spot.thr["1"] + 0.01)
    excess = np.append((v - spot.thr["1"])[v > spot.thr["1"]], 0.01)
    assert not alarm and len(spot.peaks["1"]) == spot.count["1"] == len(excess) > 2000
    g, sigma = gpd_fit(np.array(spot.peaks["1"]))
    assert np.allclose(np.sort(spot.peaks["1"]), np.sort(excess)) and upper == tail_level(1e-5, len(v) + 1, len(excess), spot.thr["1"], g, sigma, 1)
