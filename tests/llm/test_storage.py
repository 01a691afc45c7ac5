import os

import pytest

from layerlens.llm.storage import discarding, materialise


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_discarding_keeps_what_is_asked_for(spark):
    with discarding():
        with discarding():
            inner = folder(materialise(spark.range(3), "inner"))
            passed = materialise(spark.range(4), "passed", keep=True)
        assert not os.path.exists(inner)
        assert passed.count() == 4
        kept = materialise(passed, "kept", keep=True)
        gone = folder(passed)
    assert not os.path.exists(gone)
    assert kept.count() == 4
    assert os.path.exists(folder(materialise(spark.range(2), "outside")))


def test_a_failed_block_deletes_nothing(spark):
    with pytest.raises(ZeroDivisionError), discarding():
        path = folder(materialise(spark.range(3), "left"))
        _ = 1 / 0
    assert os.path.exists(path)
