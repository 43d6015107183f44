"""Readers against hand-written files."""

import gzip
from datetime import date, datetime

import pytest

from tidemark.sources import readers


def labelled(text, label):
    return f"{text:<60}{label}"


def grid_file(rows):
    lines = [labelled("    -1", "EXPONENT"), labelled("", "END OF HEADER")]
    for hour, exponent, bands in rows:
        lines += [labelled("     1", "START OF TEC MAP"), labelled(f"  2025     1     1    {hour:2d}     0     0", "EPOCH OF CURRENT MAP")]
        lines += [labelled(f"{exponent:6d}", "EXPONENT")] if exponent is not None else []
        for lat, values in bands:
            lines.append(labelled(f"  {lat:6.1f}-180.0 180.0  20.0 450.0", "LAT/LON1/LON2/DLON/H"))
            lines += ["".join(f"{v:5d}" for v in values[k : k + 16]) for k in range(0, len(values), 16)]
        lines.append(labelled("     1", "END OF TEC MAP"))
    lines += [labelled("     1", "START OF RMS MAP"), labelled("    87.5-180.0 180.0  20.0 450.0", "LAT/LON1/LON2/DLON/H"), "    1" * 16, "    1" * 3, labelled("     1", "END OF RMS MAP")]
    return "\n".join(lines) + "\n"


def test_grid_maps(spark, tmp_path):
    one, two = list(range(100, 119)), [9999, *range(1, 19)]
    (tmp_path / "a.txt").write_text(grid_file([(0, None, [(87.5, one), (-87.5, two)]), (2, 0, [(87.5, one)])]))
    got = {(r.map_epoch, r.lat, r.lon): r.value for r in readers.grid_maps(spark, str(tmp_path)).collect()}
    assert len(got) == 57
    assert got[datetime(2025, 1, 1), 87.5, -180.0] == pytest.approx(10.0) and got[datetime(2025, 1, 1), 87.5, 180.0] == pytest.approx(11.8)
    assert got[datetime(2025, 1, 1), -87.5, -180.0] is None and got[datetime(2025, 1, 1), -87.5, -160.0] == pytest.approx(0.1)
    assert got[datetime(2025, 1, 1, 2), 87.5, 0.0] == 109.0


def test_incomplete_grid_row_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text(grid_file([(0, None, [(87.5, [1] * 18)])]))
    with pytest.raises(Exception, match="incomplete grid row"):
        readers.grid_maps(spark, str(tmp_path)).collect()


def test_orbits(spark, tmp_path):
    point = lambda sv, x, y, z: f"P{sv}{x:14.6f}{y:14.6f}{z:14.6f} 999999.999999"
    lines = ["#dP2025", "*  2025  1  1  0  0  0.00000000", point("G01", 1.5, -2, 3), point("G 2", 4, 5, 6), point("G03", 999999.999999, 0, 0), point("G01", 7, 8, 9),
             "*  2025  1  1  0 14 59.99999960", "PE05 1.0 2.0 3.0", "PE06 1.0 nan 3.0", "EOF"]
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("\n".join(lines))
    got = sorted(tuple(r) for r in readers.orbits(spark, str(tmp_path)).collect())
    assert got == [(datetime(2025, 1, 1), "G01", 7000.0, 8000.0, 9000.0), (datetime(2025, 1, 1), "G02", 4000.0, 5000.0, 6000.0), (datetime(2025, 1, 1, 0, 15), "E05", 1000.0, 2000.0, 3000.0)]


def test_observations(spark, tmp_path):
    value = lambda v, lli=" ", ssi=" ": f"{v:14.3f}{lli}{ssi}"
    lines = [labelled("G    3 C1C L1C", "SYS / # / OBS TYPES"), labelled("       S1C X9X", "SYS / # / OBS TYPES"), labelled("R    1 C1C", "SYS / # / OBS TYPES"), labelled("", "END OF HEADER"),
             "> 2025 01 01 00 00 59.9999999  0  2", "G01" + value(20000000.125) + value(-5.5, "1", "7") + value(45), "R 2" + value(1.25),
             "> 2025 01 01 00 01 30.0000000  4  1", "G01" + value(9), "> 2025 01 01 00 02  0.1000000  0  2", "G03" + " " * 16 + value(2, " ", "5"), "E01" + value(3)]
    (tmp_path / "a.rnx").write_text("\r\n".join(lines) + "\r\n")
    got = sorted((tuple(r)[1:] for r in readers.observations(spark, str(tmp_path)).collect()), key=str)
    first, third = datetime(2025, 1, 1, 0, 1), datetime(2025, 1, 1, 0, 2, 0, 100_000)
    want = [(first, "G01", "C1C", 20000000.125, None, None), (first, "G01", "L1C", -5.5, 1, 7), (first, "G01", "S1C", 45.0, None, None), (first, "R02", "C1C", 1.25, None, None), (third, "G03", "L1C", 2.0, None, 5)]
    assert got == sorted(want, key=str)


def observation_text(epochs, eol="\n"):
    lines = [labelled("G    2 C1C L1C", "SYS / # / OBS TYPES"), labelled("E    1 C1C", "SYS / # / OBS TYPES"), labelled("", "END OF HEADER")]
    for e in range(epochs):
        lines.append(f"> 2025 01 01 {e // 3600:02d} {e // 60 % 60:02d} {e % 60:10.7f}  {4 if e % 50 == 7 else 0} 12")
        lines += [f"G{k:02d}{e + k / 8:14.3f}  {k:14.3f}1 " for k in range(1, 11)] + [f"E{k:02d}{-e - k / 8:14.3f}" for k in (1, 2)]
    return eol.join(lines) + eol


def test_observation_files_are_split(spark, tmp_path):
    """A file is read by many tasks, wherever the byte ranges begin, with the rows of one task."""
    (tmp_path / "a.rnx").write_text(observation_text(3000))
    (tmp_path / "b.rnx").write_text(observation_text(40, "\r\n"))
    (tmp_path / "c.rnx").write_text("no header here\n" + observation_text(9).partition("END OF HEADER")[2])
    key = "spark.sql.files.maxPartitionBytes"
    before, rows = spark.conf.get(key), {}
    try:
        for size in ("64m", "100k", "33333b"):
            spark.conf.set(key, size)
            found = readers.observations(spark, str(tmp_path))
            rows[size] = found.rdd.getNumPartitions(), sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set(key, before)
    assert rows["100k"][0] >= 10 and rows["33333b"][0] > 2 * rows["100k"][0] > 2 * rows["64m"][0]
    assert rows["100k"][1] == rows["64m"][1] == rows["33333b"][1]
    assert len(rows["64m"][1]) == (3000 - 60 + 40 - 1) * 22


def test_observation_filters(spark, tmp_path):
    (tmp_path / "a.rnx").write_text(observation_text(200))
    every = readers.observations(spark, str(tmp_path))
    for broadcast in (readers.HEADERS, 0):
        some = readers.observations(spark, str(tmp_path), ["E"], ["C1C"], "2025-01-01 00:01:00", "2025-01-01 00:02:00", broadcast)
        want = every.where("sv like 'E%' and obs = 'C1C' and epoch >= timestamp_ntz'2025-01-01 00:01:00' and epoch < timestamp_ntz'2025-01-01 00:02:00'")
        assert sorted(some.collect()) == sorted(want.collect()) and some.count() == 2 * 59
    assert readers.observations(spark, str(tmp_path), ["Z"]).count() == 0


def test_tables(spark, tmp_path):
    (tmp_path / "w.txt").write_text("YEAR DOY KP DST\n2025 1 30 -99999\n2025  2  99 -12\n\n")
    rows = readers.word_table(spark, str(tmp_path / "w.txt"), {"year": 1, "doy": 2, "kp": 3, "dst": 4}, {"kp": 99, "dst": 99999})
    day = readers.day_of_year(rows.year, rows.doy).alias("day")
    assert [tuple(r) for r in rows.select(day, "kp", "dst").collect()] == [(date(2025, 1, 1), 30.0, None), (date(2025, 1, 2), None, -12.0)]
    (tmp_path / "m.txt").write_text("60676.5 1.25 x\n60677.000011574 2 3\n")
    assert [tuple(r) for r in readers.mjd_table(spark, str(tmp_path / "m.txt"), ["mjd", "a", "b"]).select("a", "b").collect()] == [(1.25, None), (2.0, 3.0)]
    times = [r.epoch for r in readers.mjd_table(spark, str(tmp_path / "m.txt"), ["mjd", "a", "b"]).collect()]
    assert times[0] == datetime(2025, 1, 1, 12) and abs((times[1] - datetime(2025, 1, 2, 0, 0, 1)).total_seconds()) < 0.01
    (tmp_path / "s.csv").write_text("2025;01;31;2025.083; 120;x\n2025;02;30;0;1\n2025; 2; 1;0; -1;\n")
    assert [tuple(r) for r in readers.daily_semicolon(spark, str(tmp_path / "s.csv"), "ssn").collect()] == [(date(2025, 1, 31), 120.0), (date(2025, 2, 1), None)]


def test_numbers_of_fields():
    import numpy as np

    texts = ["  20000000.125", "        -5.500", "          .250", "         -.250", "         0.001", "-999999999.999", "9999999999.999", "              ", "        45    ", "  1.5e3       ", "     12 34.000", "    --1.000   ", "       1-2.000", "         x.000", "-0000000000.5 ", "          nan ", "          inf ", "        -    .", "      - 12.345", "+       12.345", "     +1234.567"]
    cells = np.frombuffer("".join(f"{t:14}1 " for t in texts).encode(), dtype=np.uint8)
    got, marks = readers._values(cells)
    for t, v in zip(texts, got.tolist(), strict=True):
        try:
            want = float(t)
        except ValueError:
            want = float("nan")
        assert v == want or v != v and want != want, (t, v, want)
    assert set(marks[:, 0].tolist()) == {1} and (marks[:, 1] < 0).all()
