"""Packed recordings: every format written and read back."""

import numpy as np
import pytest

from quillon.sources import wfdb


def packed(x, kind):
    x = np.asarray(x, int)
    if kind in (16, 61):
        return x.astype("<i2" if kind == 16 else ">i2").tobytes()
    if kind == 80:
        return (x + 128).astype(np.uint8).tobytes()
    out = bytearray()
    for k in range(0, len(x), 2):
        a, b = int(x[k]) & 0xFFF, int(x[k + 1]) & 0xFFF if k + 1 < len(x) else 0
        out += bytes([a & 0xFF, a >> 8 | b >> 8 << 4] + ([b & 0xFF] if k + 1 < len(x) else []))
    return bytes(out)


@pytest.mark.parametrize("kind,low,high", [(16, -32767, 32768), (61, -32767, 32768), (80, -127, 128), (212, -2047, 2048)])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_round_trip(kind, low, high, n):
    x = np.random.default_rng(n).integers(low, high, n)
    x[:2] = [low, high - 1][:n]
    assert wfdb.decoded(b"head" + packed(x, kind), kind, n, 4).tolist() == x.tolist()
    assert np.isnan(wfdb.decoded(packed([low - 1] * 2, kind), kind, 2)).all()


def test_recordings_of_several_files_and_segments(spark, tmp_path):
    d = tmp_path / "deep"
    d.mkdir()
    rng = np.random.default_rng(1)
    x, y, z = rng.integers(-2000, 2000, (2, 5)), rng.integers(-100, 100, (1, 5)), rng.integers(-2000, 2000, (1, 3))
    (d / "a.dat").write_bytes(packed(x.T.ravel(), 212))
    (d / "a8.dat").write_bytes(b"xx" + packed(y[0], 80))
    (d / "b.dat").write_bytes(packed(z[0], 16))
    (d / "a.hea").write_text("a 3 250 5\na.dat 212 200(10)/mV 12 0 0 0 0 I\na.dat 212 100/mV 12 4 0 0 0 II\na8.dat 80+2 0 8 0 0 0 0 V\n#Age: 40\n")
    (d / "b.hea").write_text("b 1 250 3\nb.dat 16 1 16 0 0 0 0 II\n")
    (d / "all.hea").write_text("all/3 3 250 10\na 5\n~ 2\nb 3\n")
    heads = wfdb.headers(spark, str(tmp_path))
    assert heads.filter("error is not null").count() == 0
    got = {(r.record_id, r.lead): np.array(r.signal) for r in wfdb.packed_signals(spark, str(tmp_path), heads).collect()}
    one, two, five = (x[0] - 10) / 200, (x[1] - 4) / 100, y[0]
    gap = lambda n: np.full(n, np.nan)
    want = {("all", "I"): np.r_[one, gap(5)], ("all", "II"): np.r_[two, gap(2), z[0]], ("all", "V"): np.r_[five, gap(5)]}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], equal_nan=True, atol=1e-5) for k in want)
    alone = {(r.record_id, r.lead) for r in wfdb.packed_signals(spark, str(tmp_path), heads.filter("record_id <> 'all'"), physical=False).collect()}
    assert alone == {("a", "I"), ("a", "II"), ("a", "V"), ("b", "II")}
    (d / "a.dat").unlink()
    with pytest.raises(Exception, match="a.dat"):
        wfdb.packed_signals(spark, str(tmp_path), heads).collect()
