import time

import pytest

from ledgerspark.plans.tools import Providers
from ledgerspark.plans.router import Router, keyword_intent


def test_router():
    r = Router()
    got = r.route("Calculate total revenue for FY23")
    assert got.track == "TRACK_DATA" and got.confidence >= 0.8 and r.route("calculate total revenue for fy23 ") is got
    assert r.route("Calculate total revenue for FY23", False).track != "TRACK_DATA"
    assert r.route("tell me a joke").track == "TRACK_OUT_OF_DOMAIN" and r.route("hmm").method == "default"
    assert r.route("what does the polcy say").track == "TRACK_DOC" and Router(model=lambda q: "TRACK_WEB").route("hmm").method == "model"
    assert keyword_intent("sum and total of it") == "CALCULATION" and keyword_intent("recipe for a total") is None and keyword_intent("") is None
    assert abs(sum(r.rates().values()) - 1) < 0.01
    start = time.perf_counter()
    for _ in range(100):
        r.route("Calculate total revenue for FY23")
    assert (time.perf_counter() - start) / 100 < 0.01
    for i in range(1100):
        r.route(f"zz{i} sum total")
    assert len(r.held) <= 1000


def test_providers():
    now, said = [0.0], []

    def fails(x):
        said.append(x)
        raise TimeoutError("no")

    p = Providers({"a": fails, "b": lambda x: x + 1}, rest=60, clock=lambda: now[0])
    assert p(1) == (2, "b") and p(2) == (3, "b") and said == [1]  # it rests
    now[0] = 61
    assert p(3) == (4, "b") and said == [1, 3]
    q = Providers({"a": fails}, clock=lambda: now[0])
    for _ in range(2):  # there's nobody else
        with pytest.raises(TimeoutError):
            q(5)
    with pytest.raises(LookupError):
        Providers({})(1)
    with pytest.raises(KeyError):
        Providers({"a": lambda x: {}[x]})(1)
