"""Tables with a log of versions: partition values, crashes at every step, races and marks."""

import pytest
from pyspark.sql import functions as F

from wattloom.operators.merge import merge_partitions, upsert_old_wins
from wattloom.plans import ingest
from wattloom.sources import table as t
from wattloom.sources.lake import Lake
from wattloom.sources.table import LOG, STAGED, Table

KEYS = ("state", "upgrade")


def frame(spark, rows, upgrade="int"):
    return spark.createDataFrame(rows, f"bldg_id long, state string, upgrade {upgrade}")


def ids(df):
    return sorted((r["bldg_id"], r["state"], str(r["upgrade"])) for r in df.collect())


def folders(path):
    return sorted(str(p.parent.relative_to(path)) for p in path.rglob("*.parquet"))


def test_padded_typed_and_text_values_are_one_folder(spark, tmp_path):
    root = tmp_path / "lake" / "res_2022_tmy3_1" / "metadata"
    old = root / "state=NY" / "upgrade=00"
    spark.createDataFrame([(1,), (2,)], "bldg_id long").coalesce(1).write.parquet(str(old))
    ingest.metadata_job(frame(spark, [(2, "NY", 0), (9, "NY", 0)]), str(root))
    lake = Lake(spark, str(tmp_path / "lake"), "res_2022_tmy3_1")
    assert sorted(r["bldg_id"] for r in lake.metadata([0]).collect()) == [1, 2, 9]
    ingest.metadata_job(frame(spark, [(9, "NY", "00"), (10, "NY", "00")], "string"), str(root))
    ingest.metadata_job(frame(spark, [(11, "NY", "4"), (12, "AL", "04")], "string"), str(root))
    assert sorted(r["bldg_id"] for r in lake.metadata([0]).collect()) == [1, 2, 9, 10]
    assert sorted(set(folders(root))) == ["state=AL/upgrade=04", "state=NY/upgrade=00", "state=NY/upgrade=04"]
    assert lake.partitions("metadata") == [("AL", 4), ("NY", 0), ("NY", 4)]
    assert spark.read.parquet(str(root)).count() == 6  # any reader of Parquet sees the same


def test_folders_of_one_value_become_one(spark, tmp_path):
    for name, rows in (("0", [(1,), (2,)]), ("00", [(2,), (3,)])):
        spark.createDataFrame(rows, "bldg_id long").write.parquet(f"{tmp_path}/t/state=NY/upgrade={name}")
    merge_partitions(frame(spark, [(4, "NY", 0)]), f"{tmp_path}/t", KEYS)
    assert ids(Table(spark, f"{tmp_path}/t", KEYS).read()) == [(n, "NY", "0") for n in (1, 2, 3, 4)]
    assert len(set(folders(tmp_path / "t"))) == 1 and len(list((tmp_path / "t" / "state=NY").iterdir())) == 1


def test_odd_values(spark, tmp_path):
    odd = ["x:y", "a/b", "50%", "é ü", "[z]{q}", "", None, "=", "00", "%3A"]
    rows = [(i, s, 0) for i, s in enumerate(odd)]
    for part in (rows, rows, [(i + 100, s, u) for i, s, u in rows]):
        merge_partitions(frame(spark, part), f"{tmp_path}/t", KEYS)
    assert Table(spark, f"{tmp_path}/t", KEYS).read().count() == 20
    by = {r["bldg_id"]: r["state"] for r in Table(spark, f"{tmp_path}/t", KEYS).read().collect()}
    assert by == {i + k: (s or None) for i, s, _ in rows for k in (0, 100)}
    assert len({f for f in folders(tmp_path / "t")}) == 9  # '' and null are one


def test_a_column_that_stops_being_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_partitions(frame(spark, [(1, "NY", 7)]), path, KEYS)
    merge_partitions(frame(spark, [(2, "NY", "7"), (3, "NY", "x")], "string"), path, KEYS)
    table = Table(spark, path, KEYS)
    assert ids(table.read()) == [(1, "NY", "7"), (2, "NY", "7"), (3, "NY", "x")]
    assert dict(table.read().dtypes)["upgrade"] == "string" and sorted(set(folders(tmp_path / "t"))) == ["state=NY/upgrade=7", "state=NY/upgrade=x"]


STEPS = [(t.Files, "move"), (t.Files, "put"), (t.Files, "delete"), (t.Table, "_write"), (t.Table, "_commit"), (t.Table, "_drop"), (t, "write_partitioned")]


@pytest.mark.parametrize("after", [False, True], ids=["before", "after"])
@pytest.mark.parametrize("place", STEPS, ids=lambda s: s[1] if isinstance(s, tuple) else str(s))
def test_a_crash_at_any_step_leaves_the_old_rows_or_the_new(spark, tmp_path, monkeypatch, place, after):
    owner, name = place
    first, second = frame(spark, [(1, "NY", 0), (2, "AL", 0)]), frame(spark, [(2, "AL", 0), (3, "AL", 0), (4, "TX", 4)])
    old, new = ids(first), sorted(set(ids(first)) | set(ids(second)))
    whole, call = getattr(owner, name), 0
    while True:  # crash at the first, second, ... call of the step, until it is called no more
        path = f"{tmp_path}/{call}"
        merge_partitions(first, path, KEYS)
        calls = []

        def crash(*a, n=call, calls=calls, **k):
            calls.append(1)
            if len(calls) == n + 1:
                if after:
                    whole(*a, **k)
                raise RuntimeError("crash")
            return whole(*a, **k)

        monkeypatch.setattr(owner, name, crash)
        crashed = False
        try:
            merge_partitions(second, path, KEYS)
        except RuntimeError:
            crashed = True
        monkeypatch.setattr(owner, name, whole)
        assert ids(Table(spark, path, KEYS).read()) in (old, new)
        merge_partitions(second, path, KEYS)
        assert ids(Table(spark, path, KEYS).read()) == new
        Table(spark, path, KEYS).sweep()
        assert ids(spark.read.parquet(path)) == new
        call += 1
        if not crashed:
            break
    assert call > 1


def test_a_lost_race_starts_over(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    merge_partitions(frame(spark, [(1, "NY", 0)]), path, KEYS)
    commit, other = Table._commit, []

    def late(self, version):
        if not other:
            other.append(1)
            merge_partitions(frame(spark, [(2, "NY", 0)]), path, KEYS)  # another job is first
        return commit(self, version)

    monkeypatch.setattr(Table, "_commit", late)
    merge_partitions(frame(spark, [(3, "NY", 0)]), path, KEYS)
    assert [r[0] for r in ids(Table(spark, path, KEYS).read())] == [1, 2, 3]
    assert ids(spark.read.parquet(path)) == ids(Table(spark, path, KEYS).read())
    monkeypatch.setattr(Table, "_commit", lambda self, version: False)
    with pytest.raises(t.LostRace):
        merge_partitions(frame(spark, [(4, "NY", 0)]), path, KEYS)


def test_marks_let_a_change_in_once(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", KEYS)
    assert table.append(frame(spark, [(1, "NY", 0)]), ("job", 0)) and not table.append(frame(spark, [(1, "NY", 0)]), ("job", 0))
    assert table.append(frame(spark, [(1, "NY", 0)]), ("job", 1)) and table.append(frame(spark, [(1, "NY", 0)]), ("other", 0))
    assert table.read().count() == 3 and table.done("job") == 1 and table.done("none") == -1


def test_replace_upsert_and_columns(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", ("state",))
    table.replace(spark.createDataFrame([(1, "NY", 1)], "id int, state string, v int"))
    table.merge(spark.createDataFrame([(1, "NY", 7.5, "new"), (2, "NY", 2.5, "new")], "id long, state string, v double, w string"), lambda old, new: upsert_old_wins(old.withColumn("w", F.lit(None).cast("string")), new, ("id",), [F.col("w")]))
    assert sorted(map(tuple, table.read().select("id", "v", "w").collect())) == [(1, 1.0, None), (2, 2.5, "new")]
    table.merge(spark.createDataFrame([(1, "AL", "x")], "id int, state string, z string"))  # other partitions keep their files
    assert {(r["id"], r["state"], r["w"], r["z"]) for r in table.read().collect()} == {(1, "NY", None, None), (2, "NY", "new", None), (1, "AL", None, "x")}
    table.merge(spark.createDataFrame([(5, "AL")], "id int, state string"), t.new_rows)
    assert {(r["id"], r["state"]) for r in table.read().collect()} == {(1, "NY"), (2, "NY"), (5, "AL")}
    table.merge(spark.createDataFrame([(2, "NY")], "id int, state string"), t.replacing("id"))
    assert sorted((r["id"], r["w"]) for r in table.read().where("state = 'NY'").collect()) == [(1, None), (2, None)]
    table.replace(table.read().where("id > 1"))
    assert sorted(r["id"] for r in spark.read.parquet(table.path).collect()) == [2, 5]
    table.replace(table.read().limit(0))
    assert table.read().count() == 0 and {"id", "state", "w", "z"} <= set(table.read().columns)


def test_sweep_takes_what_no_version_names(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", ("state",))
    table.append(spark.createDataFrame([(1, "NY")], "id int, state string"))
    spark.range(3).write.parquet(f"{tmp_path}/t/state=TX")
    spark.range(3).write.parquet(f"{tmp_path}/t/{STAGED}/x")
    assert [r["id"] for r in table.read().collect()] == [1]
    left = table.sweep()
    assert left and all(f.startswith("state=TX/") for f in left) and not (tmp_path / "t" / STAGED).exists()
    for _ in range(t.KEPT + 3):
        table.append(spark.createDataFrame([(1, "NY")], "id int, state string"))
    assert len(list((tmp_path / "t" / LOG).glob("*.json"))) == t.KEPT
