"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import checks
from checks.compare import database, differences
from tests.conftest import TABLES

checks.load_all()


@pytest.fixture(scope="module")
def db():
    return database(str(TABLES))


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query(spark, db, name):
    assert differences(spark, db, name, str(TABLES)) is None
