"""The shared folder: what is staged inside a scratch block goes at its end, the rest stays."""

import glob

import pytest

from leadspark import session


def files(spark):
    return glob.glob(session.staged_dir(spark).removeprefix("file:") + "/**/*.parquet", recursive=True)


def test_scratch_deletes_only_its_own(spark):
    path = session.fresh_path(spark, "kept")
    with session.scratch(spark):
        inner = session.stage(spark.range(10), "inner")
        with session.scratch(spark):
            nested = session.stage(inner.where("id < 5"), "nested")
            kept = session.stage(nested, "kept", path)
        assert inner.count() == 10 and not any("/nested-" in f for f in files(spark))
    assert kept.count() == 5 and not any("/inner-" in f for f in files(spark))
    session.unstage(kept)


def test_scratch_is_deleted_after_a_failure(spark):
    with pytest.raises(ValueError), session.scratch(spark):
        session.stage(spark.range(3), "failed")
        raise ValueError
    assert not any("/failed-" in f for f in files(spark)) and "scratch" not in session.fresh_path(spark, "next")
