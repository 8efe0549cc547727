import math

import numpy as np
import pytest

from tidegauge import registry
from tidegauge.kernels import control, groups, series, spectral, tails

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(0)
P, Y = np.arange(400), RNG.normal(size=400)


def test_tails():
    assert tails.t_isf(0.025, 10) == pytest.approx(2.228139, abs=1e-5) and tails.t_sf(-1.0, 3) == pytest.approx(0.8044989, abs=1e-6)
    assert tails.poisson_sf(5, 2.0) == pytest.approx(1 - sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(5)))
    assert tails.binomial_sf(3, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3, 11)))
    assert tails.kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-3) and tails.kuiper_sf(1.747) == pytest.approx(0.05, abs=1e-3) and tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_run_lengths_are_the_published_ones():
    assert control.ewma_run_length() == pytest.approx(560, rel=0.01) and control.cusum_run_length() == pytest.approx(465, rel=0.01)


def test_autocorrelation():
    a = np.zeros(20_000)
    for i in range(1, len(a)):
        a[i] = 0.5 * a[i - 1] + RNG.normal()
    assert series.tau(np.arange(len(a)), a) == pytest.approx(3, rel=0.2) and series.tau(P, np.ones(400)) == 1.0
    gap = np.concatenate([np.arange(100), np.arange(150, 300)])
    assert [x.tolist() for x in series.pairs(np.array([0, 1, 3]), np.array([5.0, 6.0, 7.0]), 2)] == [[6.0], [7.0]] and series.tau(gap, RNG.normal(size=250)) < 2


def test_stability():
    step = Y + np.where(P >= 200, 2.0, 0)
    assert series.changepoints(P, Y) == [] and abs(series.changepoints(P, step)[0] - 200) <= 5
    assert [series.diagnose(P, x, False) for x in (Y, step, Y + 0.01 * P)] == ["stable", "level_shifted", "drifting"]
    assert series.kpss(Y)[1] == 0.1 and series.kpss(np.cumsum(Y))[1] == 0.01
    assert series.trend(P, 3 + 0.5 * P + Y)["low"] < 0.5 < series.trend(P, 3 + 0.5 * P + Y)["high"]
    assert series.variance_ratio(P, Y * (1 + P / 100)) > 2 and series.shape(np.exp(Y), 3)["skew"] > 1
    run = series.excursion(Y[:100], np.concatenate([Y[100:120], Y[120:130] + 5, Y[130:140]]), 100.0)
    assert (run["start"], run["end"]) == (20, 29) and run["p"] < 1e-9
    assert math.isnan(series.dispersion(P[:3], np.zeros(3))) and series.dispersion(P, RNG.poisson(4, 400).astype(float)) == pytest.approx(1, abs=0.3)


def test_spectrum():
    peak = spectral.spectrum(P * 1000, Y + np.sin(2 * np.pi * P / 25), 1000.0, 1)[0]
    assert peak["period"] == pytest.approx(25_000, rel=0.02) and peak["fap"] < 1e-6
    t = P.astype(float)
    assert spectral.fap(spectral.level(0.01, 400, 0.5, t), 400, 0.5, t) == pytest.approx(0.01, rel=1e-3)
    assert spectral.power(t, np.ones(400), np.array([0.1]))[0] == 0 and spectral.power(t, 1e9 + np.sin(t), np.array([1 / (2 * np.pi)]))[0] == pytest.approx(1, abs=1e-4)
    low, edge = spectral.apply_filter(P, np.sin(2 * np.pi * P / 100) + np.sin(2 * np.pi * P / 4), "low", 1.0, None, 20.0)
    assert np.abs(low - np.sin(2 * np.pi * P / 100))[~edge].max() < 0.1
    half, edge = spectral.apply_filter(P, np.sin(2 * np.pi * P / 20), "low", 1.0, None, 20.0)
    assert np.abs(half[~edge]).max() ** 2 == pytest.approx(0.5, abs=0.03)
    for wrong in (("low", 1.0, None), ("band", 5.0, 10.0), ("high", 1.0, None)):
        with pytest.raises(ValueError):
            spectral.check_filter(*wrong, 1.0, 100.0)


def test_control_chart():
    assert control.chart(P, Y, P < 100)["verdict"] == "in_control" and control.chart(P, Y + np.where(P > 200, 3, 0), P < 100)["verdict"] == "out_of_control"
    assert control.chart(P, Y, P < 20)["verdict"] == "insufficient_baseline"


def test_fleets():
    x = RNG.normal(size=(20, 60))
    assert groups.outliers(x) == []
    x[3] += 6
    x[7, 40:] += np.linspace(0, 9, 20)
    assert [(i, k) for i, k, _ in groups.outliers(x)] == [(3, "persistent"), (7, "drifting")]
    f = np.concatenate([RNG.normal(size=(15, 4)), RNG.normal(size=(15, 4)) + 8])
    assert groups.adjusted_rand(groups.clusters(f), np.repeat([0, 1], 15)) == 1.0 and groups.clusters(RNG.normal(size=(30, 4))).max() == 0


def test_verdicts():
    assert groups.level_test(1.0, np.array([1, 1.2, 0.9, 1.1]))["p"] > 0.05 > groups.level_test(5.0, np.array([1, 1.2, 0.9, 1.1]))["p"]
    assert groups.judge_counts(100, 10, 100, 10)["p"] > 0.5 and groups.judge_counts(200, 10, 100, 10)["p"] < 1e-6 < groups.judge_counts(200, 10, 100, 10, 30.0)["p"]
    cycles = RNG.normal(10, 1, size=(7, 48))
    assert groups.seasonal(RNG.normal(10, 1, 48), cycles)["verdict"] == "usual" and groups.seasonal(RNG.normal(14, 1, 48), cycles)["verdict"] == "unusual"
    assert groups.seasonal(np.full(48, np.nan), cycles)["verdict"] == "insufficient_history" and groups.departure(10, 10, 1000) < 1e-6


@pytest.mark.parametrize("name", ["changepoints", "spectrum_peaks", "fleet_outliers", "littles_law_check", "seasonal_compare", "filter_bandpass", "control_chart", "excursion", "spectrogram", "diagnose"])
def test_queries_run(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    if name == "spectrum_peaks":
        assert all(abs(max((r for r in rows if r["event_type"] == k), key=lambda r: r["power"])["period"] - 86_400_000) < 9e6 for k in {r["event_type"] for r in rows})
    if name == "fleet_outliers":
        assert {r["instance"] for r in rows if r["kind"] == "persistent"} == {7}
    if name == "littles_law_check":
        assert rows and all(0.5 < r["ratio"] < 1.5 for r in rows if r["verdict"] != "insufficient_data")
