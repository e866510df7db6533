"""CSV loads: bad lines set apart, rows numbered in file order."""

from __future__ import annotations

import pytest

from loadshape import config as C
from loadshape.sources.meter import load_meter_csv, read_meter_csv

HEAD = ",".join([C.SITE, C.TIME, C.TEMP, C.RAD, C.POWER, C.FLAG, C.CAP])


def test_bad_lines_become_rejects(spark, tmp_path):
    lines = ["S,2025-01-01 00:00:00,1.0,2.0,3.0,0,0.0", "S,yesterday,1.0,2.0,3.0,0,0.0", "S,2025-01-01 00:30:00,1.0,2.0,n/a,0,0.0",
             "S,2025-01-01 00:45:00,1.0", "S,2025-01-01 01:00:00,1,2,3,0,0,too,many", ",,,,,,", "S,2025-01-01 01:30:00,,,,1,2.5"]
    (tmp_path / "m.csv").write_text("\n".join([HEAD, *lines]))
    load = load_meter_csv(spark, str(tmp_path / "m.csv"))
    assert (load.n_rows, load.n_rejected) == (3, 4)
    good = {r[C.ROW_ID]: r for r in load.rows.collect()}
    assert sorted(good) == [0, 5, 6] and good[5][C.SITE] is None and good[6][C.CAP] == 2.5 and good[6][C.POWER] is None
    assert {r[C.ROW_ID]: r.line for r in load.rejects.collect()} == {k: lines[k] for k in (1, 2, 3, 4)}
    with pytest.raises(ValueError, match="4 of 7 lines"):
        read_meter_csv(spark, str(tmp_path / "m.csv"))
    assert read_meter_csv(spark, str(tmp_path / "m.csv"), most_rejected=0.6).count() == 3


def test_row_ids_follow_file_order_for_any_split(spark, tmp_path):
    for f, name in enumerate(("a.csv", "b.csv", "c.csv")):
        body = [f"F{f},2025-01-01 00:00:00,{i},0,{'x' if i % 50 == 7 else 1},0,0" for i in range(700 * (f + 1))]
        (tmp_path / name).write_text("\n".join([HEAD, *body]) + "\n")
    want, at = {}, 0
    for f in range(3):
        for i in range(700 * (f + 1)):
            want[f"F{f}", float(i)] = at + i
        at += 700 * (f + 1)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for most, cost in (("128m", "4m"), ("3k", "0"), ("17k", "1k")):
            for k, v in zip(keys, (most, cost)):
                spark.conf.set(k, v)
            load = load_meter_csv(spark, str(tmp_path))
            got = {(r[C.SITE], r[C.TEMP]): r[C.ROW_ID] for r in load.rows.collect()}
            assert load.n_rejected == 14 + 28 + 42 and len(got) == 4200 - 84
            assert all(want[k] == v for k, v in got.items())
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text(HEAD + "\n")
    load = load_meter_csv(spark, str(tmp_path / "e.csv"))
    assert (load.n_rows, load.n_rejected, load.rows.count(), load.rejects.count()) == (0, 0, 0, 0)
