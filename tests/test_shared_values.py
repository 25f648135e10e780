"""Values that the SQL takes from the library, stated a second time or checked by their definition."""

import sys

from tunetable.functions.text import WHITESPACE
from tunetable.operators.bootstrap import PER_DIGEST, REPLICATES, poisson_thresholds
from tunetable.plans.inputs import REWORDED


def test_white_space_is_what_strip_removes():
    assert set(WHITESPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if not c.strip()}


def test_bootstrap_weights():
    assert (REPLICATES, PER_DIGEST) == (1000, 8)
    # 65,536 times the distribution function of Poisson(1) at 0, 1, 2, ..., rounded
    assert poisson_thresholds() == [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]


def test_reworded_words():
    assert dict(REWORDED) == {" the ": " a ", " la ": " le ", " und ": " oder ", " el ": " un "}
