"""Every document, event and conversation turn takes part in the fixtures."""

import pytest

from evolve import fixtures as fx


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_row_is_left_out(spark, scale):
    sf = f"/root/testdata/{scale}"
    count = lambda name: fx.table(spark, sf, name).count()
    assert fx.scripts(spark, sf).count() == count("documents")
    assert fx.log(spark, sf).count() == count("events")
    assert fx.mini_history(spark, sf).count() == count("conversations")
    assert fx.targets(spark, sf).count() == fx.table(spark, sf, "events").select("user_id").distinct().count()
