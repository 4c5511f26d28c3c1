from hypothesis import given, strategies as st

from kvspark.functions.bounds import EXCLUDED, INCLUDED, UNBOUNDED, Bound, holds, overlaps, prefix_bounds, prefix_successor

keys = st.binary(max_size=4)
bounds = st.builds(Bound, st.sampled_from([UNBOUNDED, INCLUDED, EXCLUDED]), keys)


def test_prefix_successor_cases():
    assert prefix_successor(b"user:") == b"user;"
    assert prefix_successor(b"a\xff\xff") == b"b"
    assert prefix_successor(b"\xff\xff") is None
    assert prefix_successor(b"") is None


@given(keys, keys)
def test_prefix_bounds_are_the_prefix(prefix, key):
    assert holds(*prefix_bounds(prefix), key) == key.startswith(prefix)


@given(bounds, bounds, st.lists(keys, max_size=5))
def test_overlap_never_skips_a_key(low, high, there):
    if any(holds(low, high, k) for k in there):
        assert overlaps(low, high, min(there), max(there))
    assert not overlaps(low, high, None, None)
