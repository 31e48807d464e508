"""Lines made to stall or kill a task, and rows that come late."""

import random
import re
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from logvigil.functions.payload import _STEADY, detect_sqli, detect_xss, literal
from logvigil.functions.signatures import SQLI, XSS
from logvigil.sources.syslog import RFC5424
from logvigil.streaming.state import count_failures


def test_many_structured_data_elements(spark):
    line = "<34>1 2024-01-15T10:00:00Z host app 1 id " + "[a b=\"c\"]" * 50_000 + " message"
    lazy = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+((?:\[.*?\])*|-)\s*(.*)$"
    rows = spark.createDataFrame([(line,)], "line string").repartition(1)
    found = rows.selectExpr(f"regexp_extract(line, r'{RFC5424}', 9) AS message").first()
    assert found.message == "message"
    draw = random.Random(1)
    for _ in range(2000):
        tail = "".join(draw.choice("[]ab -") for _ in range(draw.randrange(14)))
        text = f"<34>1 t h a p m {tail}"
        assert re.match(RFC5424, text).groups() == re.match(lazy, text).groups()


@pytest.mark.parametrize("published", sorted(_STEADY))
def test_steady_forms_match_alike(published):
    parts = ["where", " ", "and", "or", "--", "#", "/*", "x", "sleep", "benchmark", "(", "%00", "\\0", "select", "drop", "band", "\n", ")",
             "conv(", "convert (", ",1", ", 2", "<script", ">", "<a", "<link", "<img", "<svg", "<body", "<meta", "href =", "onload=", "onerror=",
             "http-equiv", "<", "/"]
    # the pieces of the pattern itself come more often
    parts += [p for p in parts if p.strip(" =,(12") and p.strip(" =,(12") in published.replace("\\", "")] * 6
    draw, steady = random.Random(2), _STEADY[published]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        one, two = re.search(published, text), re.search(steady, text)
        assert (one and one.group()) == (two and two.group(1)), text


def test_every_steady_form_is_in_use():
    published = {p for table in (SQLI, XSS) for patterns in table.values() for p in patterns}
    assert set(_STEADY) <= published


@pytest.mark.parametrize("published", sorted(_STEADY))
def test_long_text_does_not_stall(spark, published):
    """A hundred thousand characters of begins without an end, under a second."""
    begin = {"\\": "where and ", "(": "or ", "<": "<script "}
    part = next((p for p in ("where and ", "convert(", "%00", "<script ", "<img ", "<svg ", "<body ", "<meta ", "<a ", "or ")
                 if p.strip().split()[0].rstrip("(") in published.replace("(?:a|link)", "a")), begin[published[0]])
    rows = spark.createDataFrame([(part * (100_000 // len(part)),)], "url string").repartition(1)
    text = literal("(?id)" + _STEADY[published])
    rows.selectExpr(f"rlike(url, {text}) AS hit").first()
    began = time.perf_counter()
    assert not rows.selectExpr(f"rlike(url, {text}) AS hit").first().hit
    assert time.perf_counter() - began < 1.5


@pytest.mark.parametrize("part", ["or+", "where+and+", "%00+", "convert(", "<script", "<a+", "<img+"])
def test_long_urls_do_not_stall(spark, part):
    url = "/x?q=" + part * (100_000 // len(part))
    rows = spark.createDataFrame([(url,)], "url string").repartition(1)
    found = rows.selectExpr(f"{detect_sqli('url')} AS sqli", f"{detect_xss('url')} AS xss")
    found.collect()
    began = time.perf_counter()
    found.collect()
    assert time.perf_counter() - began < 6


class State(SimpleNamespace):
    hasTimedOut, exists, get, until = False, False, None, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, ms):
        self.until = ms

    def getCurrentWatermarkMs(self):
        return self.watermark


@pytest.mark.parametrize("seed", range(20))
def test_late_failures_against_a_plain_model(seed):
    draw, width, state, known = random.Random(seed), 10, State(watermark=0), []
    handle, newest = count_failures(width), 0
    for _ in range(15):
        batch = sorted(max(newest - 6, 0) + draw.randrange(12) for _ in range(draw.randrange(1, 5)))
        rows = pd.DataFrame({"us": batch, "file_path": "f", "line_seq": range(len(batch)), "event_time": 0})
        got = pd.concat(list(handle(("k",), iter([rows]), state)))
        for us, count, first in zip(got.us, got.trailing_count, got.first_us, strict=True):
            known.append(us)
            inside = [t for t in known if us - width <= t <= us]
            assert (count, first) == (len(inside), min(inside))
        newest = max(known)
        assert state.until >= (newest + width) // 1000
        assert min(state.get[0]) >= -width
