"""Runs that appear whole or not at all; a stream that takes every file once."""

import os
from collections import Counter

import pytest

from tessera.plans import job
from tessera.sinks import commit
from tessera.sinks.commit import is_published, published, run_committed
from tessera.spec import JobSpec
from tessera.streaming.incremental import start_committed

SPEC = JobSpec(source_type="csv", provider_name="p", required_fields=("article_sku",))


def _inputs(d):
    d.mkdir(parents=True)
    (d / "good.csv").write_text("article_sku,n\nA,1\nB,2\n")
    (d / "bad.csv").write_text("sku,n\nC,3\n")


def _tables(spark, out):
    drop = {"clean": ["run"], "quarantine": ["run"], "ledger": ["run", "run_ts"]}
    got = {}
    for name in commit.TABLES:
        df = published(spark, str(out), name)
        got[name] = None if df is None else Counter(repr(sorted(r.asDict().items())) for r in df.drop(*drop[name]).collect())
    return got


def _run(spark, tmp_path, out, **kw):
    return run_committed(spark, SPEC, str(tmp_path / "in"), str(tmp_path / out), "day 1", kind="csv", level="contract", **kw)


def test_killed_after_any_write_a_rerun_gives_the_same_tables(spark, tmp_path, monkeypatch):
    _inputs(tmp_path / "in")
    assert _run(spark, tmp_path, "whole")
    whole = _tables(spark, tmp_path / "whole")
    assert all(whole.values()) and sum(whole["clean"].values()) == 2
    real = {n: getattr(job, n) for n in ("write_clean", "write_frame")}
    for kill in range(3):  # after the clean rows, the quarantine, the ledger
        out, writes = f"killed{kill}", []

        def dies(name):
            def write(*a, **kw):
                got = real[name](*a, **kw)
                writes.append(name)
                if len(writes) == kill + 1:
                    raise RuntimeError("killed")
                return got
            return write

        with monkeypatch.context() as m:
            for n in real:
                m.setattr(job, n, dies(n))
            with pytest.raises(RuntimeError):
                _run(spark, tmp_path, out)
        assert not is_published(spark, str(tmp_path / out), "day 1")
        assert all(not rows for rows in _tables(spark, tmp_path / out).values())  # nothing of the broken run counts
        assert _run(spark, tmp_path, out)
        assert _tables(spark, tmp_path / out) == whole
        assert not _run(spark, tmp_path, out) and _tables(spark, tmp_path / out) == whole


def test_runs_of_other_keys_add_up(spark, tmp_path):
    _inputs(tmp_path / "in")
    for key in ("a", "b", "a"):
        run_committed(spark, SPEC, str(tmp_path / "in"), str(tmp_path / "out"), key, kind="csv", level="contract")
    assert published(spark, str(tmp_path / "out"), "clean").count() == 4
    assert published(spark, str(tmp_path / "nowhere"), "clean") is None


def test_stream_takes_every_file_once_also_after_a_lost_commit(spark, tmp_path):
    inbox, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    inbox.mkdir()

    def trigger():
        start_committed(spark, SPEC, str(inbox), str(out), str(check), kind="csv").awaitTermination(120)

    (inbox / "a.csv").write_text("article_sku\nA\n")
    trigger()
    (inbox / "b.csv").write_text("article_sku\nB\n")
    trigger()
    commits = check / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            os.remove(commits / name)  # the batch ran, but its commit was lost: Spark hands it in again
    trigger()
    (inbox / "c.csv").write_text("article_sku\nC\n")
    trigger()
    rows = published(spark, str(out), "clean").select("article_sku").collect()
    assert sorted(r.article_sku for r in rows) == ["A", "B", "C"]
    assert published(spark, str(out), "ledger").count() == 3


def test_state_passes_a_file_again_only_when_it_changed():
    import pandas as pd
    from tessera.streaming.incremental import _unseen

    class State:
        exists, kept = False, None

        @property
        def get(self):
            return self.kept

        def update(self, value):
            self.exists, self.kept = True, value

    state = State()

    def see(*sightings):
        pdf = pd.DataFrame({"modificationTime": pd.to_datetime([t for t, _ in sightings], unit="s"), "length": [n for _, n in sightings]})
        return [tuple(f.iloc[0])[1:] for f in _unseen(("p",), iter([pdf]), state)]

    s = 10 ** 9
    assert see((5, 1), (5, 1)) == [(5 * s, 1)]
    assert see((5, 1)) == []
    assert see((6, 1), (5, 1)) == [(6 * s, 1)]
    assert see((6, 2)) == [(6 * s, 2)]
    assert see((4, 9)) == []
