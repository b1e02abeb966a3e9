from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    import corpus as c

    return c.write(spark, tmp_path_factory.mktemp("corpus"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    import corpus as c

    return c.write(spark, tmp_path_factory.mktemp("empty"), docs=[], bench=[], marks=[])
