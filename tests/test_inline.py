"""The rows that follow from operators' definitions over small corpora."""

import pytest
from inline_cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    make, columns, want = CASES[name]
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got = [tuple(r) for r in make(spark).select(*columns).collect()]
    assert plain(got) == plain([tuple(float(v) if isinstance(g, float) and v is not None else v for v, g in zip(r, got[0], strict=True)) for r in want])
