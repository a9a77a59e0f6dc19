import os

import pytest

from nestwork.streaming.state import State, StateError, restore_mode

S = "k int"


@pytest.fixture
def make(spark, tmp_path):
    def build(**kw):
        return State(spark, f"file://{tmp_path}/state", f"file://{tmp_path}/backup", **kw)

    return build


def fill(spark, state, *values, replace=False):
    state.stage("t", spark.createDataFrame([(v,) for v in values], S), replace)


def read(state):
    return sorted(r.k for r in state.read("t", S).collect())


def test_runs_versions_and_rollback(spark, make):
    s = make()
    s.open()
    assert read(s) == []
    fill(spark, s, 1, 2)
    assert read(s) == [1, 2] and s.read("t", S, staged=False).isEmpty()
    assert s.commit(7) == 1
    fill(spark, s, 3)
    s.rollback()
    assert read(s) == [1, 2]
    fill(spark, s, 3)
    s.commit(8)
    assert sorted((r.k, r.run) for r in s.read("t", S).collect()) == [(1, 1), (2, 1), (3, 2)]
    fill(spark, s, 9, replace=True)
    s.commit(9)
    again = make()
    again.open()
    assert read(again) == [9] and again.opened.batch_id == 9
    assert again.versions() == [2, 3]  # older ones are gone, and so are files that nothing names
    assert len(s.files.names(f"{s.uri}/runs")) == 3


def test_staged_runs_of_a_lost_engine_are_ignored(spark, make):
    s = make()
    s.open()
    fill(spark, s, 1)
    s.commit(0)
    fill(spark, s, 2)
    other = make()
    other.open()
    assert read(other) == [1]


def test_closed_state(spark, make):
    s = make()
    with pytest.raises(StateError):
        s.read("t", S)
    s.open()
    with pytest.raises(StateError):
        s.delete()
    with pytest.raises(StateError):
        s.restore()
    s.close()
    s.delete()
    with pytest.raises(StateError):
        s.restore()


def with_backups(spark, make, n, **kw):
    s = make(**kw)
    s.open()
    for i in range(n):
        fill(spark, s, i, replace=True)
        s.commit(i)
        s.backup()
    s.close()
    return s


def test_backups_are_kept_and_restored(spark, make):
    s = with_backups(spark, make, 3, backups_to_keep=2)
    assert s.backups() == [2, 3]
    s.delete()
    assert s.restore() == 3
    s.open()
    assert read(s) == [2] and s.opened.batch_id == 2
    s.close()
    s.delete_backups()
    assert s.backups() == []


def damage(tmp_path, where):
    runs = os.path.join(tmp_path, where, "runs")
    for name in os.listdir(runs):
        for f in os.listdir(os.path.join(runs, name)):
            if f.endswith(".parquet"):
                with open(os.path.join(runs, name, f), "ab") as x:
                    x.write(b"x")


def test_damaged_backup(spark, make, tmp_path):
    s = with_backups(spark, make, 2)
    damage(tmp_path, "backup/2")
    s.delete()
    with pytest.raises(StateError):
        s.restore()
    s.auto_rollback = True
    assert s.restore() == 1 and s.backups() == [1]
    s.open()
    assert read(s) == [0]


def test_restore_when_needed(spark, make, tmp_path):
    with_backups(spark, make, 1)
    damage(tmp_path, "state")
    with pytest.raises(StateError):
        make().open()
    s = make(mode=" When_Needed ")
    s.open()
    assert read(s) == [0]


def test_restore_always(spark, make):
    s = with_backups(spark, make, 1)
    s.open()
    fill(spark, s, 5)
    s.commit(5)
    s.close()
    back = make(mode="ALWAYS")
    back.open()
    assert read(back) == [0]


def test_modes():
    assert restore_mode(None) == "never" and restore_mode(" Always") == "always"
    with pytest.raises(ValueError):
        restore_mode("sometimes")
