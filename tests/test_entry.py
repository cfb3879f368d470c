from pathlib import Path

import pytest

import __spark_entry__


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
