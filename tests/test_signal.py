import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import dsp
from quillon.operators import signal, windows
from quillon.sources import files, wfdb


def long(spark, *signals):
    return spark.createDataFrame([(r, i, float(v)) for r, s in signals for i, v in enumerate(s)], "record string, idx int, value double")


def test_windows_are_complete(spark):
    df = long(spark, ("a", range(5000)), ("b", range(10)))
    got = windows.sliding(df, 1000, 500).groupBy("record", "segment", "start").count().collect()
    assert sorted((r.record, r.segment, r.start, r["count"]) for r in got) == [("a", k, 500 * k, 1000) for k in range(9)]
    arr = spark.createDataFrame([(list(range(10)),), ([1],)], "s array<int>").select(windows.array_windows(F.col("s"), 4, 3).alias("w"))
    assert [len(r.w) for r in arr.collect()] == [3, 0]


def test_correlation_and_lag(spark):
    x, y = [0.0, 1.0, 0.0, -1.0], np.zeros(20)
    df = spark.createDataFrame([("same", v, v) for v in x] + [("neg", v, -v) for v in x] + [("flat", v, 1.0) for v in x], "g string, a double, b double")
    assert {r.g: round(r.correlation, 9) for r in windows.correlation(df, ["g"], "a", "b").collect()} == {"same": 1.0, "neg": -1.0, "flat": 0.0}
    y[5], z = 1, np.roll(np.eye(20)[5], 2)
    a, b = long(spark, ("r", y)), long(spark, ("r", z))
    assert windows.max_lag_correlation(a, b, ["record"], 3).first().max_lag_correlation > 0.99


def test_features_of_a_constant_and_a_known_signal(spark):
    f = {r.record: r for r in windows.segment_features(long(spark, ("c", [2, 2, 2, 2]), ("v", [1, -2, 3, -4, 10])), ["record"]).collect()}
    assert (f["c"].skewness, f["c"].kurtosis, f["c"].zero_crossing_rate, f["c"].area) == (0.0, 0.0, 0.0, 6.0)
    v = np.array([1, -2, 3, -4, 10.0])
    assert f["v"].rms == pytest.approx(np.sqrt((v**2).mean())) and f["v"].zero_crossing_rate == 1.0
    assert f["v"].area == pytest.approx(((v[1:] + v[:-1]) / 2).sum())


def test_filter_keeps_the_band_and_drops_the_rest():
    t = np.arange(10000) / 500
    b, a = dsp.butter_bandpass(0.5, 40, 500)
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 150 * t)
    y = dsp.filtfilt(b, a, slow + fast)
    assert np.abs(y - slow)[3000:-3000].max() < 0.01
    z = np.exp(2j * np.pi * np.array([0.5, 40]) / 500)
    assert np.allclose(np.abs(np.polyval(b, z) / np.polyval(a, z)), 0.5**0.5, atol=1e-3)
    assert np.allclose(np.abs(np.roots(a)) < 1, True)
    with pytest.raises(ValueError):
        dsp.butter_bandpass(40, 0.5, 500)


def test_peaks_and_resampling():
    x = np.array([0, 1, 0, 5, 0, 1, 0, 4, 4, 4, 0.0])
    assert dsp.find_peaks(x).tolist() == [1, 3, 5, 8]
    assert dsp.find_peaks(x, distance=3).tolist() == [3, 8]
    assert dsp.find_peaks(x, prominence=2).tolist() == [3, 8]
    t = np.arange(1000) / 500
    y = dsp.resample(np.sin(2 * np.pi * 3 * t), 100, 500)
    assert len(y) == 200 and np.abs(y - np.sin(2 * np.pi * 3 * np.arange(200) / 100))[20:-20].max() < 0.01


def test_reconstruction_of_itself(spark):
    df = spark.createDataFrame([(1, [float(v) for v in range(48)])], "r int, y array<double>").withColumn("z", F.col("y"))
    got = signal.reconstruction_metrics(df).first()
    assert got.rmse == 0 and got.prd == 0 and got.correlation == pytest.approx(1)


def test_bad_records_become_dead_letters(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [])], "record string, signal array<double>")
    good, bad = signal.guarded(df, lambda x: {"top": float(x.max())}, "top double")
    assert [r.top for r in good.collect()] == [2.0]
    assert [(r.record, r.error[:10]) for r in bad.collect()] == [("b", "ValueError")]


def test_recordings_from_disk(spark, tmp_path):
    text = "rec1 2 500 4\nrec1.mat 16x1+24 1000(5)/mV 16 0 1 2 0 I\nrec1.mat 16x1+24 0/mV 16 7 1 2 0 II\n#Age: 64\n#Sex: Female\n#Dx: 164889003,426783006\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "rec1.hea").write_text(text)
    (tmp_path / "d" / "rec1.mat").write_bytes(wfdb.write_mat4(np.array([[5, 1005, 2005, 5], [7, 8, 9, 7]])))
    (tmp_path / "bad.hea").write_text("nonsense")
    heads = wfdb.headers(spark, str(tmp_path))
    got = {r.record_id: r for r in heads.collect()}
    assert got["bad"].error and got["rec1"].adc_gains == [1000.0, 1.0] and got["rec1"].baselines == [5.0, 7.0] and got["rec1"].sex == "Female" and got["rec1"].age == 64
    sig = {r.lead: list(r.signal) for r in wfdb.signals(spark, str(tmp_path), heads).collect()}
    assert sig == {"I": [0, 1, 2, 0], "II": [0, 1, 2, 0]}


def test_chunks_and_manifest(spark, tmp_path):
    df = spark.range(10)
    assert files.write_chunks(df, str(tmp_path / "t"), {"step": 1})["rows"] == 10
    assert files.read_chunks(spark, str(tmp_path / "t"), parameters={"step": 1}).count() == 10
    with pytest.raises(ValueError, match="other parameters"):
        files.read_chunks(spark, str(tmp_path / "t"), parameters={"step": 2})
    files.write_chunks(df.coalesce(1), str(tmp_path / "m"), {}, rows_per_file=4)
    assert [files.read_chunks(spark, str(tmp_path / "m"), chunks=k).count() for k in (0, 1, 2, 9)] == [0, 4, 8, 10]
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), {"seed": 1}, lambda: made.append(1) or df).count() == 10
    assert made == [1]
    with pytest.raises(ValueError, match="publication"):
        files.public_copy(df, str(tmp_path / "p"), ["patient_id"])


def test_segment_table(spark):
    from quillon.plans import ingest

    t = np.arange(500) / 100
    rows = [(r, lead, (np.sin(2 * np.pi * f * t) + 0.1 * k).tolist()) for k, (r, f) in enumerate((("a", 2.0), ("b", 3.0))) for lead in ("I", "II")] + [("short", "I", [0.0] * 50), ("short", "II", [0.0] * 50)]
    sigs = spark.createDataFrame(rows, "record_id string, lead string, signal array<double>")
    heads = spark.createDataFrame([("a", "1, 9", None), ("b", None, None), ("short", "1", None)], "record_id string, diagnosis string, error string")
    out = ingest.segment_table(sigs, heads, 100.0, ["I", "II"], ["9"], 2.0, 1.0, high=20.0)
    assert len(out.columns) == 7 + 2 * 13 + 4 * 13
    got = sorted((r.patient_id, r.segment_ref, r.utility_label, r.lead_I_n_peaks, r.start_sample, r.end_sample) for r in out.collect())
    assert [g[:3] for g in got] == [("a", k, "Atrial") for k in range(4)] + [("b", k, "Non-Atrial") for k in range(4)]
    assert all(g[3] == (4 if g[0] == "a" else 6) and g[5] - g[4] == 200 for g in got)


def _two_recordings(spark):
    t = np.arange(500) / 100
    rows = [(r, lead, (np.sin(2 * np.pi * f * t) + 0.1 * k).tolist()) for k, (r, f) in enumerate((("a", 2.0), ("b", 3.0))) for lead in ("I", "II")]
    return spark.createDataFrame([*rows, ("short", "I", [0.0] * 50), ("short", "II", [0.0] * 50), ("half", "I", t.tolist())], "record_id string, lead string, signal array<double>")


def test_record_table(spark):
    from quillon.plans import ingest

    heads = spark.createDataFrame([("a", "1, 9", None), ("b", None, None), ("half", "1", "bad")], "record_id string, diagnosis string, error string")
    got = {r.patient_id: r for r in ingest.record_table(_two_recordings(spark), heads, 100.0, ["I", "II"], ["9"], high=20.0).collect()}
    assert set(got) == {"a", "b"} and len(got["a"].asDict()) == 4 + 2 * 13 + 4 * 13 + 5
    assert [(got[r].utility_label, got[r].n_r_peaks, round(got[r].mean_rr, 2), round(got[r].mean_hr_bpm)) for r in "ab"] == [("Atrial", 10, 0.5, 120), ("Non-Atrial", 15, 0.33, 180)]


def test_targets_are_lead_major_and_errors_are_rows(spark):
    from quillon.plans import ingest

    sigs = _two_recordings(spark)
    got = {r.record_id: r for r in ingest.targets(sigs, 100, 50, ["I", "II"], 1, high=20.0).collect()}
    b, a = dsp.butter_bandpass(0.5, 20.0, 100, 4)
    x = dsp.filtfilt(b, a, np.sin(2 * np.pi * 3 * np.arange(500) / 100)[:, None] + 0.1)[:, 0]
    x = dsp.resample(((x - x.mean()) / x.std())[100:300], 50, 100)
    assert np.allclose(got["b"].target, np.concatenate([x, x]), atol=1e-5) and got["b"].error is None
    assert {r: got[r].error for r in ("short", "half")} == {"short": "segment 1 is unavailable", "half": "a lead is missing"}
    features = spark.createDataFrame([(r, k) for r in ("a", "b", "half", "gone") for k in (0, 1)] + [("c", 0)], "patient_id string, segment_ref int")
    kept, bad = ingest.cohort(features, sigs, 0, 100, 50, ["I", "II"], 1, high=20.0)
    assert sorted(r.patient_id for r in kept.collect()) == ["a", "b"]
    assert {r.patient_id: r.error for r in bad.collect()} == {"half": "a lead is missing", "gone": "recording not found"}
    kept, bad = ingest.cohort(features, sigs, 2, 100, 50, ["I", "II"], 1, high=20.0)
    assert kept.count() + bad.count() == 2


def test_reconstruction_table(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(2, 3, 40))
    z = y + 0.3 * rng.normal(size=y.shape)
    z[0, 1] = np.roll(y[0, 1], 2)
    y[1, 2] = 0
    rows = [(r, f"l{k}", y[r, k].tolist(), z[r, k].tolist()) for r in range(2) for k in range(3)]
    leads = spark.createDataFrame(rows, "record int, lead string, y array<double>, z array<double>")
    table = signal.reconstruction_table(leads, ["l0", "l1", "l2"], "l1", 3)
    got = {r.record: r for r in table.collect()}
    for r in range(2):
        e = y[r] - z[r]
        assert got[r].rmse == pytest.approx(np.sqrt((e**2).mean())) and got[r].prd_percent == pytest.approx(100 * np.linalg.norm(e) / np.linalg.norm(y[r]))
        assert got[r].snr_db == pytest.approx(20 * np.log10(np.linalg.norm(y[r]) / np.linalg.norm(e)))
        assert got[r].lead_l0_correlation == pytest.approx(np.corrcoef(y[r, 0], z[r, 0])[0, 1])
    assert got[0].main_max_lag_correlation > 0.99 > got[0].main_correlation
    assert got[1].lead_l2_correlation == 0 and got[1].lead_l2_prd_percent is None
    one = signal.reconstruction_summary(table).first()
    assert one.n_test == 2 and one.rmse_median == pytest.approx((got[0].rmse + got[1].rmse) / 2)


def test_runs_over_models_seeds_and_columns(spark):
    from quillon.operators import models

    rng = np.random.default_rng(0)
    rows = [(10 * r + k, f"r{r}", k, float(r % 2 + rng.normal()), float(rng.normal()), "Positive" if r % 2 else "Negative") for r in range(24) for k in range(6)]
    df = spark.createDataFrame(rows, "key long, record string, ref int, a double, b double, label string")
    got = models.utility_runs(df, "record", {"one": ["a"], "both": ["a", "b"]}, "label", ["logistic"], [1]).collect()
    assert sorted((r.subset, r.seed, r.model) for r in got) == [(s, k, "logistic") for s in ("both", "one") for k in (1,)]
    segs = df.select("key", "record", "ref", F.array("a", "b").alias("v"))
    got = models.linkability_runs(segs, "key", "record", "ref", "v", ["logistic"], [1], most=100).collect()
    assert sorted((r.model, r.seed) for r in got) == [("logistic", 1)]


@pytest.mark.parametrize("low,high,fs,chunk", [(0.5, 40.0, 500.0, 300), (5.0, 40.0, 250.0, 1 << 15), (1.0, 20.0, 100.0, 7)])
def test_chunks_are_filtered_as_whole_recordings(spark, low, high, fs, chunk):
    rng = np.random.default_rng(1)
    whole = {"a": rng.normal(size=2003) + 5, "b": np.cumsum(rng.normal(size=chunk if chunk < 1000 else 900)), "c": rng.normal(size=3), "d": np.array([2.0])}
    df = spark.createDataFrame([(r, k, float(v)) for r, x in whole.items() for k, v in enumerate(x)], "record string, idx int, value double").repartition(5)
    got = {}
    for r in signal.bandpass_in_chunks(df, low, high, fs, 4, chunk).collect():
        got.setdefault(r.record, {})[r.idx] = r.value
    b, a = dsp.butter_bandpass(low, high, fs, 4)
    for r, x in whole.items():
        y = dsp.filtfilt(b, a, x)
        assert sorted(got[r]) == list(range(len(x)))
        # At a thousandth of fs the direct form itself is good to some 1e-4 only.
        assert np.allclose([got[r][k] for k in range(len(x))], y, atol=(1e-9 if low / fs > 0.005 else 1e-3) * max(1, np.abs(y).max()))


def test_modes_are_the_filter():
    x = np.random.default_rng(2).normal(size=1000)
    for low, high, fs, order in ((5.0, 40.0, 250.0, 4), (1.0, 20.0, 100.0, 3), (0.5, 4.0, 10.0, 1)):
        b, a = dsp.butter_bandpass(low, high, fs, order)
        m = dsp.Modes(low, high, fs, order)
        y, end = m.run(x)
        assert np.allclose(y, dsp.lfilter(b, a, x[:, None], np.zeros((2 * order, 1)))[:, 0], atol=1e-10)
        for cut in (1, 128, 500):  # two parts, linked by the state
            (p, s), (q, t) = m.run(x[:cut]), m.run(x[cut:])
            assert np.allclose(np.concatenate([p, q + m.answer(s, len(q))]), y, atol=1e-10) and np.allclose(m.carried(s, len(q)) + t, end, atol=1e-10)
        assert np.allclose(m.answer(m.steady(), 3), (m.steady() * m.weights * m.poles ** np.arange(1, 4)[:, None]).sum(1).real)


@pytest.mark.parametrize("kind", ["csv", "csv.gz", "json", "parquet"])
def test_exports(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1.5, [1, 2]), ("b", None, [])], "name string, x double, v array<int>")
    for _ in range(2):
        files.exported(df, str(tmp_path / "out"), kind)
    names = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert names and all(n.endswith(kind if kind != "parquet" else ".parquet") for n in names)
    back = spark.read.option("header", "true").option("inferSchema", "true").format(kind.split(".")[0]).load(str(tmp_path / "out")) if kind != "json" else spark.read.json(str(tmp_path / "out"))
    got = {r["name"]: (r.x, r.v) for r in back.collect()}
    assert got == {"a": (1.5, "[1,2]" if "csv" in kind else [1, 2]), "b": (None, "[]" if "csv" in kind else [])}
    with pytest.raises(ValueError):
        files.exported(df, str(tmp_path / "out"), "npz")


@pytest.mark.parametrize("low,high,fs,order", [(0.5, 40.0, 500.0, 4), (0.5, 4.0, 10.0, 1), (5.0, 15.0, 100.0, 3)])
def test_band_pass_has_the_response_of_its_definition(low, high, fs, order):
    """The squared gain 1 / (1 + ((w^2 - low high) / (w (high - low)))^(2 order)) at warped frequencies, not by poles."""
    b, a = dsp.butter_bandpass(low, high, fs, order)
    f = np.linspace(0.01, 0.49, 200) * fs
    z = np.exp(-2j * np.pi * f / fs)
    gain = np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) ** 2
    w, lo, hi = (np.tan(np.pi * np.asarray(x) / fs) for x in (f, low, high))
    assert np.allclose(gain, 1 / (1 + ((w**2 - lo * hi) / (w * (hi - lo))) ** (2 * order)), atol=1e-6)


@pytest.mark.parametrize("chunk", [5, 40, 1 << 15])
def test_peaks_over_chunk_edges(spark, chunk):
    rng = np.random.default_rng(6)
    t = np.arange(600) / 100
    whole = {
        "noise": np.round(rng.normal(size=600) * 2), "flat": np.repeat(np.round(rng.normal(size=60) * 3), 10), "wave": np.sin(2 * np.pi * 1.3 * t) + 0.2 * rng.normal(size=600),
        "stairs": np.concatenate([np.arange(100.0), np.arange(100.0)[::-1]]), "same": np.full(80, 2.0), "one": np.array([1.0]), "edge": np.array([5.0, 1, 4, 1, 5]), "long": np.concatenate([[0.0], np.full(90, 3.0), [0.0, 1, 0]]),
    }
    df = spark.createDataFrame([(r, k, float(v)) for r, x in whole.items() for k, v in enumerate(x)], "record string, idx int, value double").repartition(4)
    for seconds, percentile in ((0.2, 75.0), (0.0, None)):
        got = {r: [] for r in whole}
        for r in signal.peaks_in_chunks(df, 100.0, seconds, 0.5, percentile, chunk).collect():
            got[r.record].append(r.idx)
        for r, x in whole.items():
            least = None if percentile is None else float(np.percentile(x, percentile))
            assert sorted(got[r]) == dsp.find_peaks(x, max(1, int(seconds * 100)), max(0.1, 0.5 * x.std()), least).tolist(), (r, chunk)


def test_stretches_of_equal_samples_are_no_peaks_in_the_queries(spark, tmp_path):
    """Events that repeat a value, against the SQL of both queries: it has strict maxima alone."""
    import duckdb

    from quillon.plans import catalog

    path, start = str(tmp_path / "events.parquet"), "TIMESTAMP '2024-01-01'"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, {start} + to_seconds(i) AS ts, i // 60 AS user_id, CASE WHEN i % 11 < 2 THEN 70.0 ELSE i * 37 % 60 + (i * 37 % 11 = 5)::INT * 30.0 END AS value FROM range(240) t(i)) TO '{path}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    rows = lambda d, c: sorted(map(repr, d[c].itertuples(index=False, name=None)))
    got, want = catalog.peaks_in_chunks(spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL["peaks_in_chunks"]).df()
    assert len(want) and rows(got, ["record", "idx"]) == rows(want, ["record", "idx"])
    got, want = catalog.peaks(spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL["peaks"]).df()
    assert rows(got, ["record", "n_peaks", "rr_mean"]) == rows(want, ["record", "n_peaks", "rr_mean"])
