import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from equipledger.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="eql-test-ckpt-")})
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="eql-test-")


def rows(df, *cols, sort=True):
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x if x is not None else 0) for x in t)) if sort else out


def plan_text(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()
