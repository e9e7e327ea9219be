from __future__ import annotations

import pytest

from wrenchline.session import build_session

RAW_TABLES = ("region nation customer supplier part orders lineitem events").split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("wrenchline-tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__default__parallelism="2", spark__ui__enabled="false",
                            spark__driver__memory="8g",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def hot_spark(spark):
    """The same session with hot-key detection on for any size and any key above 16 rows, and no small sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("wrenchline.skew.minBytes", "0")
    spark.conf.set("wrenchline.skew.hotRows", "16")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("wrenchline.skew.minBytes")
    spark.conf.unset("wrenchline.skew.hotRows")
