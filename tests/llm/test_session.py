"""Settings that hold while a table is stored."""

import pytest

from marlstone.llm.session import STORING, storing


def test_storing_puts_settings_back(spark):
    one, other = STORING
    before = spark.conf.get(one, None), spark.conf.get(other, None)
    spark.conf.set(one, "12345")
    try:
        with pytest.raises(KeyError), storing(spark):
            assert all(spark.conf.get(k) == v for k, v in STORING.items())
            raise KeyError
        assert spark.conf.get(one) == "12345" and spark.conf.get(other, None) == before[1]
    finally:
        spark.conf.unset(one) if before[0] is None else spark.conf.set(one, before[0])
