"""Which track a question takes: by pattern, by likeness to examples, by key words."""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from ledgerspark.functions import routing
from ledgerspark.functions.similarity import similarity

#: How sure likeness must be, and how many routes are kept and forgotten at once.
SURE, KEPT, FORGOTTEN = 0.75, 1000, 100
#: Examples of each track.
EXAMPLES = {
    "TRACK_DATA": ["total revenue of the year", "growth between two quarters", "compare costs by month", "value of a metric for a period"],
    "TRACK_DOC_SUMMARY": ["give me an overview of the file", "summarize the report"],
    "TRACK_DOC": ["what does the policy say", "which clause covers termination"],
    "TRACK_WEB": ["current market price", "latest tax rate"],
    "TRACK_OUT_OF_DOMAIN": ["tell me a joke", "write a poem"],
}
BY_INTENT = {"CALCULATION": "TRACK_DATA", "DATA_QUERY": "TRACK_DATA", "ENTITY_SEARCH": "TRACK_DATA", "SUMMARY": "TRACK_DOC_SUMMARY", "DOCUMENT_SEARCH": "TRACK_DOC", "REAL_TIME": "TRACK_WEB", "OUT_OF_DOMAIN": "TRACK_OUT_OF_DOMAIN"}


def keyword_intent(question: str) -> str | None:
    """The intent with most of its words in the question; None unless it has two or is the only one."""
    low = question.lower()
    found = {name: n for name, words in routing.INTENTS if (n := sum(w in low for w in words))}
    best = max(found, key=found.__getitem__, default=None)
    return best if best and (found[best] >= 2 or len(found) == 1) else None


@dataclass
class Route:
    track: str
    confidence: float
    method: str


@dataclass
class Router:
    """model: asked last, for a track or nothing."""

    model: Callable[[str], str | None] | None = None
    examples: dict[str, list[str]] = field(default_factory=lambda: EXAMPLES)
    held: OrderedDict = field(default_factory=OrderedDict)
    methods: Counter = field(default_factory=Counter)

    def __post_init__(self):
        self.patterns = [(n, [re.compile(p, re.I) for p in ps]) for n, ps in routing.TRACKS]

    def route(self, question: str, data_loaded: bool = True) -> Route:
        key = (question.lower().strip(), data_loaded)
        if key in self.held:
            self.methods["cache"] += 1
            return self.held[key]
        found = self._new(question, data_loaded)
        self.methods[found.method] += 1
        if len(self.held) >= KEPT:
            for _ in range(FORGOTTEN):
                self.held.popitem(last=False)
        self.held[key] = found
        return found

    def _new(self, question: str, data_loaded: bool) -> Route:
        open_to = lambda track: data_loaded or track not in routing.NEEDS_DATA
        for track, patterns in self.patterns:
            if open_to(track) and any(p.search(question) for p in patterns):
                return Route(track, routing.CONFIDENCE, "regex_fastpass")
        scores = {t: max((similarity(question, e) for e in es), default=0.0) for t, es in self.examples.items() if open_to(t)}
        best = max(scores, key=scores.__getitem__, default=None)
        if best and scores[best] >= SURE:
            return Route(best, scores[best], "similarity")
        track = BY_INTENT.get(keyword_intent(question) or "")
        if track and open_to(track):
            return Route(track, 0.7, "keywords")
        if self.model and (told := self.model(question)):
            return Route(told, 0.6, "model")
        return Route("TRACK_DATA" if data_loaded else "TRACK_OUT_OF_DOMAIN", 0.3, "default")

    def rates(self) -> dict[str, float]:
        n = sum(self.methods.values())
        return {m: round(k / n, 3) for m, k in self.methods.items()}
