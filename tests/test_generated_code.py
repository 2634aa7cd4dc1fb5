"""The JVM compiles no method beyond 8,000 bytes; a row's code above that is interpreted, at several times the cost."""

import contextlib
import io
import re

import pytest

from sideline.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
LIMIT = 8000


@pytest.mark.parametrize("name", ["explanation_texts", "explanations", "baseline_forecast", "classification"])
def test_row_code_is_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan at once, not as it runs
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            REGISTRY[name](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < LIMIT
