"""Topic lexicon: a fixed-size dimension compiled into one narrow expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import ascii_view, let
from brandloom.functions.text import fold


@dataclass(frozen=True)
class Topic:
    id: str
    label: str
    patterns: tuple[str, ...]
    format: str | None = None

    @property
    def pattern(self) -> str:
        return "|".join(f"(?:{p})" for p in self.patterns)


@dataclass(frozen=True)
class Lexicon:
    topics: tuple[Topic, ...]
    generic: tuple[str, ...] = ()
    audience: tuple[str, ...] = ()
    staples: tuple[str, ...] = ()
    no_stack: tuple[str, ...] = ()  # themes ignored when another topic is present
    labels: dict = field(default_factory=dict)

    def topics_in_folded(self, folded: Column) -> Column:
        """Topic ids in lexicon order. One pass over all patterns rules out the texts
        without a topic; only the others are tested topic by topic."""

        def tested(t: Column) -> Column:
            tests = F.array_compact(F.array(*[F.when(t.rlike(x.pattern), F.lit(x.id)) for x in self.topics]))
            return F.when(t.rlike("|".join(x.pattern for x in self.topics)), tests).otherwise(F.array().cast("array<string>"))

        return let(ascii_view(folded), tested)

    def topics_in(self, text: Column) -> Column:
        return self.topics_in_folded(fold(text))

    def primary_of(self, ids: Column) -> Column:
        def pick(every: Column) -> Column:
            specific = F.filter(every, lambda t: ~t.isin(list(self.generic))) if self.generic else every
            return F.coalesce(F.get(specific, F.lit(0)), F.get(every, F.lit(0)))

        return let(ids, pick)

    def primary_topic(self, text: Column) -> Column:
        return self.primary_of(self.topics_in(text))

    def audience_of(self, ids: Column) -> Column:
        return F.filter(ids, lambda t: t.isin(list(self.audience)))

    def audience_topics(self, text: Column) -> Column:
        return self.audience_of(self.topics_in(F.coalesce(text, F.lit(""))))

    def _lookup(self, pairs: list[tuple[str, str]], key: Column) -> Column:
        flat = [F.lit(x) for kv in pairs for x in kv]
        return F.try_element_at(F.create_map(*flat), key)

    def label_of(self, topic: Column) -> Column:
        return self._lookup([(t.id, t.label) for t in self.topics], topic)

    def format_of(self, topic: Column) -> Column:
        return self._lookup([(t.id, t.format or V.DEFAULT_GAP_FORMAT) for t in self.topics], topic)

    def order_of(self, topic: Column) -> Column:
        return F.array_position(F.array(*[F.lit(t.id) for t in self.topics]), topic)

    def table(self, spark: SparkSession) -> DataFrame:
        """The lexicon as a dimension table, one row per topic."""
        rows = [
            (i, t.id, t.label, t.pattern, t.format or V.DEFAULT_GAP_FORMAT, t.id in self.generic, t.id in self.audience)
            for i, t in enumerate(self.topics)
        ]
        return spark.createDataFrame(
            rows, "topic_ord int, topic_id string, label string, pattern string, format string, generic boolean, audience boolean"
        )


HOSPITALITY = Lexicon(
    topics=tuple(Topic(i, label, tuple(p), fmt) for i, label, fmt, p in V.TOPICS),
    generic=tuple(V.GENERIC_TOPICS),
    audience=tuple(V.AUDIENCE_TOPICS),
    staples=tuple(V.STAPLE_TOPICS),
    no_stack=("rooms",),
)
