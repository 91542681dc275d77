from trackloom.operators import corruption
from trackloom.operators.queries import QUERIES


def test_every_number_of_a_variant_is_there(spark, sf):
    numbers = {k for k, v in corruption.DEFAULTS.items() if isinstance(v, float)}
    assert set(QUERIES["c2_variants"](spark, sf).columns) == {"seq_name", "n_frames", "variant", *numbers}
