"""Optional enrichment by an external model, injected as a callable; off by default (M-2 to M-8).

Runs on the driver over the few stories that are analysed in an edition. Pacing, breaking and deadlines take a clock and a
sleep function, so that they can be tested without waiting.
"""

from __future__ import annotations

import email.utils
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.markup import json_object

Answer = Callable[[str, str], str]  # (provider, prompt) -> text


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds of a Retry-After header, a number or an HTTP date; never negative (F-33)."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        try:
            return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
        except (TypeError, ValueError):
            return None


@dataclass
class Pacer:
    """Spacing of calls: doubled when throttled (from one second), seven tenths after a success, within floor and ceiling."""

    floor: float = 2.5
    ceiling: float = 20.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    gap: float = 0.0
    last: float | None = None

    def __post_init__(self) -> None:
        self.gap = self.floor

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()

    def succeeded(self) -> None:
        self.gap = max(self.floor, self.gap * 0.7)

    def throttled(self, told: float | None = None) -> None:
        self.gap = min(self.ceiling, max(told or 0.0, self.gap * 2 or 1.0))


@dataclass
class Breaker:
    """Opens after three failures, for 45 seconds that double with each trip up to 900; a success closes it."""

    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    trips: int = 0
    until: float = 0.0

    def allows(self) -> bool:
        return self.clock() >= self.until

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= 3:
            self.until = self.clock() + min(900.0, 45.0 * 2**self.trips)
            self.trips, self.failures = self.trips + 1, 0

    def succeeded(self) -> None:
        self.failures = self.trips = 0


@dataclass
class Deadline:
    """Time left of a budget; 0 is unlimited."""

    seconds: float
    clock: Callable[[], float] = time.monotonic
    start: float = field(init=False)

    def __post_init__(self) -> None:
        self.start = self.clock()

    def remaining(self) -> float:
        return float("inf") if not self.seconds else max(0.0, self.start + self.seconds - self.clock())

    def expired(self) -> bool:
        return self.remaining() <= 0


def story_prompt(batch: list[dict], body_chars: int = 3200, keep: float = 1.0) -> str:
    """The prompt of a batch: number, title, sources and the clipped text of each story."""
    size = max(400, int(body_chars * keep))
    parts = [f"[{s['sid']}] {s.get('title') or ''}\nSources: {s.get('sources') or ''}\n{(s.get('text') or '')[:size]}" for s in batch]
    return "Answer with one JSON object {\"stories\": [{\"id\": ..., \"summary_en\": ...}]}.\n\n" + "\n\n".join(parts)


def candidates(wanted: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(provider, model) pairs to try, each once, in their first order (D-9)."""
    return list(dict.fromkeys(wanted))


def link_context(graph: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entity graph and the links of each edition as text for a prompt (M-8): (edition, entities) and (edition, links).

    graph: (edition, entity, story_ids, n) of entity_graph; links: (edition, type, src, dst, evidence). An edition's lists only
    are gathered: its most frequent entities first, its links by their ends.
    """
    names = F.struct((-F.col("n")).alias("k"), "entity", F.concat("entity", F.lit(": "), "story_ids").alias("line"))
    ends = F.struct("src", "dst", "type", F.concat_ws(" ", F.concat_ws(">", "src", "dst"), F.concat(F.lit("("), "type", F.lit(")")), "evidence").alias("line"))
    text = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["line"]), "\n")
    return graph.groupBy("edition").agg(text(names).alias("entities")), links.groupBy("edition").agg(text(ends).alias("links"))


@dataclass
class Engine:
    """Batches of stories through a chain of providers; a failing batch is halved, what stays open is left to the fallback."""

    answer: Answer
    providers: list[str]
    batch_size: int = 5
    deadline: Deadline | None = None
    pacers: dict[str, Pacer] = field(default_factory=dict)
    breakers: dict[str, Breaker] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: {"calls": 0, "errors": 0, "splits": 0, "missing": 0})

    def _complete(self, prompt: str) -> str | None:
        for provider in self.providers:
            pacer = self.pacers.setdefault(provider, Pacer(floor=0.0))
            breaker = self.breakers.setdefault(provider, Breaker())
            if not breaker.allows():
                continue
            pacer.wait()
            self.counts["calls"] += 1
            try:
                text = self.answer(provider, prompt)
            except Exception as e:  # noqa: BLE001 - any failure of a provider leads to the next one
                self.counts["errors"] += 1
                breaker.failed()
                if getattr(e, "code", 0) == 429:
                    pacer.throttled(getattr(e, "retry_after", None))
                continue
            breaker.succeeded()
            pacer.succeeded()
            return text
        return None

    def _batch(self, batch: list[dict], keep: float) -> dict[str, dict]:
        import json

        if self.deadline and self.deadline.expired():
            return {}
        found = json_object(self._complete(story_prompt(batch, keep=keep)))
        rows = (json.loads(found).get("stories") or []) if found else []
        got = {str(r.get("id", "")).strip().upper(): r for r in rows if isinstance(r, dict)}
        got = {k: v for k, v in got.items() if k in {s["sid"] for s in batch}}
        if not got and len(batch) > 1:
            self.counts["splits"] += 1
            half = len(batch) // 2
            return self._batch(batch[:half], keep) | self._batch(batch[half:], keep)
        return got

    def analyse(self, stories: list[dict], passes: int = 3) -> dict[str, dict]:
        """Answers by story number; later passes retry what is open with shorter texts."""
        done: dict[str, dict] = {}
        for n in range(passes):
            open_ = [s for s in stories if s["sid"] not in done]
            for i in range(0, len(open_), self.batch_size):
                done |= self._batch(open_[i : i + self.batch_size], max(0.35, 0.75**n))
        self.counts["missing"] = sum(s["sid"] not in done for s in stories)
        return done

    def synthesise(self, stories: list[dict], context: str = "", fallback: Callable[[], dict] = dict, fewer: int = 12) -> dict:
        """The note of an edition from its stories and what earlier editions said: asked once for all of them, once for the first
        `fewer`, and left to the fallback (M-6). An answer counts if it is an object with a note or themes."""
        import json

        for part in dict.fromkeys((len(stories), min(fewer, len(stories)))):
            if not part or (self.deadline and self.deadline.expired()):
                break
            asked = "Answer with one JSON object {\"editor_note_en\": ..., \"top_themes\": [...]}.\n\n" + (f"Before:\n{context}\n\n" if context else "")
            found = json_object(self._complete(asked + "\n\n".join(f"[{s['sid']}] {s.get('title') or ''}" for s in stories[:part])))
            value = json.loads(found) if found else {}
            if value.get("editor_note_en") or value.get("top_themes"):
                return {**value, "_source": "model", "_stories": part}
        self.counts["errors"] += bool(stories)
        return {**fallback(), "_source": "extractive"}
