from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ripplegraph.session import build_session, drop_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture()
def rows():
    """Rows of a frame as sorted plain tuples."""

    def get(df, *cols, digits=6):
        sel = df.select(*cols) if cols else df
        out = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in sel.collect()]
        return sorted(out, key=repr)

    return get
