import pytest


@pytest.mark.parametrize("name", ["p6_found", "p7_sound", "p8_whole", "p9_found", "p9_classes"])
def test_query_gives_the_rows_of_its_sql(agrees, name):
    assert agrees(name)
