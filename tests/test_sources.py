"""CSV source/sink round trip, NaN handling, label and HTML checks."""
import os
import tempfile

import pytest

from conftest import SF_SMALL
from riskspark.sources.files import (SourceError, preview, read_applicants, write_scored)
from riskspark.sources.tables import applications


def test_csv_round_trip(spark):
    a = applications(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    write_scored(a, os.path.join(d, "apps"))
    back = read_applicants(spark, os.path.join(d, "apps"), schema=a.schema, require_label=True)
    assert back.count() == a.count()
    assert back.exceptAll(a).count() == 0
    assert preview(back).count() == 10


def test_nan_becomes_null_and_label_check(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("SK_ID_CURR,AMT_INCOME_TOTAL\n1,NaN\n2,5.0\n")
    df = read_applicants(spark, p)
    assert df.where("AMT_INCOME_TOTAL IS NULL").count() == 1
    with pytest.raises(SourceError):
        read_applicants(spark, p, require_label=True)


def test_html_page_is_refused(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = os.path.join(d, "page.csv")
    with open(p, "w") as f:
        f.write("<!DOCTYPE html>\n<html><body>sign in</body></html>\n")
    with pytest.raises(SourceError):
        read_applicants(spark, p)
