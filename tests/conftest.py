import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from revlens.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S") if s else None


@pytest.fixture
def gold_df(spark):
    """Build a gold-schema DataFrame from dicts (missing keys are NULL)."""
    from revlens.schema import GOLD

    def make(rows):
        out = []
        for r in rows:
            r = dict(r)
            for k in ("date", "reply_date"):
                if isinstance(r.get(k), str):
                    r[k] = ts(r[k])
            if r.get("date") is not None:
                r.setdefault("year", r["date"].year)
                r.setdefault("year_month", r["date"].strftime("%Y-%m"))
            out.append(tuple(r.get(f.name) for f in GOLD.fields))
        return spark.createDataFrame(out, GOLD)
    return make
