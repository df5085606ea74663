from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalanvil.operators.containers import ARRAY, DENSE, RUNS, WIDTH, compress, dense, positions_of


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, WIDTH - 1), max_size=300), st.lists(st.tuples(st.integers(0, WIDTH - 1), st.integers(0, 4000)), max_size=4))
def test_round_trip(single, runs):
    places = single | {x for a, n in runs for x in range(a, min(a + n, WIDTH))}
    form, data = compress(np.array(sorted(places), np.int64))
    assert set(positions_of(dense(form, data)).tolist()) == places
    assert len(data) <= min(2 * len(places), WIDTH // 8)


def test_the_smallest_form_is_taken():
    every = np.arange(WIDTH)
    assert compress(every)[0] == RUNS and len(compress(every)[1]) == 4
    assert compress(every[::3])[0] == DENSE and compress(every[::100])[0] == ARRAY and compress(every[:0]) == (ARRAY, b"")
