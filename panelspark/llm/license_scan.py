"""License scans by template-markup matching.

A template is wording with regions: ``<<beginOptional>> … <<endOptional>>`` may be absent, ``<<var;match="{0,20}">>`` stands for so many
words of any kind. Templates are compiled together into one automaton over words: a mandatory word is an edge with that word, an
optional region an edge past it, a replaceable region a row of edges that any word takes. A text is accepted where all mandatory
words of a template stand in order and nothing else between them but what the regions allow.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import small_batches

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_CHARS = 1 << 20  # characters of a text that are held as words at a time
MATCHES = "array<struct<label:string,base:boolean,start:long,end:long,mandatory:int>>"


@dataclass(frozen=True)
class Template:
    """``label`` for texts that hold ``markup``. Case of A-Z and everything that is no word count for nothing."""

    label: str
    markup: str
    base: bool = False


# The base phrases and their labels.
BASE_TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Wordings of well-known licenses and of the notices that name them.
MORE_TEMPLATES = (
    Template("mit-notice", """<<beginOptional>>this <<var;match="{1,3}">> is<<endOptional>> <<var;match="{1,1}">> under the
        <<beginOptional>>terms of the<<endOptional>> mit license"""),
    Template("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included
        in all copies or substantial portions of <<var;match="{1,8}">> software"""),
    Template("apache-2.0-notice", """licensed under the apache license <<beginOptional>>version<<endOptional>> 2
        <<beginOptional>>0<<endOptional>>"""),
    Template("gpl-notice", """<<beginOptional>>gnu<<endOptional>> <<beginOptional>>lesser<<endOptional>>
        <<beginOptional>>affero<<endOptional>> general public license <<beginOptional>>as published by the free software foundation
        <<beginOptional>>either<<endOptional>><<endOptional>> version <<var;match="{1,1}">>"""),
    Template("cc-notice", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by
        <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> 4 0"""),
    Template("bsd-text", """redistribution and use in source and binary forms with or without modification are permitted
        <<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the following conditions are met
        <<beginOptional>><<var;match="{1,1}">><<endOptional>> redistributions of source code must retain the
        <<var;match="{0,2}">> copyright notice this list of conditions and the following disclaimer
        <<beginOptional>><<var;match="{1,1}">><<endOptional>> redistributions in binary form must reproduce the above copyright notice"""),
    Template("mpl-2.0-notice", """this source code form is subject to the terms of the mozilla public license v 2 0"""),
    Template("spdx-tag", """spdx license identifier <<var;match="{1,1}">>"""),
)
TEMPLATES = BASE_TEMPLATES + MORE_TEMPLATES

_MARK = re.compile(r'<<(beginOptional|endOptional|var)(?:;[^<>]*?match="\{(\d+),(\d+)\}")?[^<>]*>>')
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def text_slices(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """Pieces of about ``most`` characters that end between words, so that a very long text is not held as words at once."""
    gap, at = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0
    while len(text) - at > most:
        cut = gap.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Automaton:
    """One automaton over words for all templates; a state keeps the latest start that leads to it, so time is linear in the text."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self.ids: dict[str, int] = {}
        self.edges: list[dict[int, list[int]]] = []  # state: word: next states; word 0 is any word
        self.past: list[list[int]] = []  # state: states reached without a word
        self.final: dict[int, int] = {}
        self.mandatory = [0] * len(templates)
        firsts = [self._compile(i, t) for i, t in enumerate(templates)]
        closures = [self._closure([s]) for s in range(len(self.edges))]
        self.step = [{w: self._merge(closures, to) for w, to in e.items()} for e in self.edges]
        self.start: dict[int, tuple[int, ...]] = {}
        begin = {s for f in firsts for s in closures[f]}
        for i, f in enumerate(firsts):
            if any(s in self.final for s in closures[f]):
                raise ValueError(f"template {templates[i].label!r} accepts nothing at all")
        for w in {w for s in begin for w in self.step[s]}:
            self.start[w] = tuple(sorted({t for s in begin for t in self.step[s].get(w, ())}))
        self.first_word = np.zeros(len(self.ids) + 1, bool)
        self.first_word[[w for w in self.start if w]] = True
        if 0 in self.start:  # a template that begins with any word begins everywhere
            self.first_word[:] = True

    def _state(self) -> int:
        self.edges.append({})
        self.past.append([])
        return len(self.edges) - 1

    def _compile(self, index: int, template: Template) -> int:
        first = now = self._state()
        opened: list[int] = []
        at = 0

        def words(part: str, now: int) -> int:
            for word in lower_words(part):
                after = self._state()
                self.edges[now].setdefault(self.ids.setdefault(word, len(self.ids) + 1), []).append(after)
                self.mandatory[index] += not opened
                now = after
            return now

        for mark in _MARK.finditer(template.markup):
            now = words(template.markup[at : mark.start()], now)
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(now)
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError(f"markup of template {template.label!r} is not well formed")
                after = self._state()
                self.past[now].append(after)
                self.past[opened.pop()].append(after)
                now = after
            else:
                end = self._state()
                least, most = int(mark[2] or 0), int(mark[3] or 0)
                for k in range(most + 1):
                    if k >= least:
                        self.past[now].append(end)
                    if k < most:
                        after = self._state()
                        self.edges[now].setdefault(0, []).append(after)
                        now = after
                now = end
        now = words(template.markup[at:], now)
        if opened or "<<" in _MARK.sub("", template.markup) or any(m[1] == "var" and m[2] is None for m in _MARK.finditer(template.markup)):
            raise ValueError(f"markup of template {template.label!r} is not well formed")
        self.final[now] = index
        return first

    def _closure(self, states: list[int]) -> tuple[int, ...]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.past[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return tuple(sorted(seen))

    @staticmethod
    def _merge(closures: list[tuple[int, ...]], to: list[int]) -> tuple[int, ...]:
        return tuple(sorted({s for t in to for s in closures[t]}))

    def scan(self, text: str) -> tuple[int, dict[tuple[int, int], int]]:
        """Number of words, and {(template, start): last end} of all places where a template is accepted; words count from 0."""
        found: dict[tuple[int, int], int] = {}
        active: dict[int, int] = {}
        done = 0
        get, step, start, final = self.ids.get, self.step, self.start, self.final
        anywhere = start.get(0, ())
        for piece in text_slices(text):
            ids = np.array([get(w, 0) for w in lower_words(piece)], np.int64)
            begins = np.flatnonzero(self.first_word[ids])
            i = 0
            while i < len(ids):
                if not active:
                    k = np.searchsorted(begins, i)
                    if k == len(begins):
                        break
                    i = int(begins[k])
                word, new = int(ids[i]), {}
                for state, begun in active.items():
                    edges = step[state]
                    for t in (*edges.get(word, ()), *edges.get(0, ())) if word else edges.get(0, ()):
                        if new.get(t, -1) < begun:
                            new[t] = begun
                for t in (*start.get(word, ()), *anywhere) if word else anywhere:
                    new[t] = done + i
                for t, begun in new.items():
                    if t in final:
                        found[final[t], begun] = done + i + 1
                active = new
                i += 1
            done += len(ids)
        return done, found


def license_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All columns but text, with ``n_words`` and ``matches`` (label, base, start, end, mandatory), sorted by start, end, label.

    ``start`` and ``end`` (exclusive) count words from 0; of several starts of one state the latest counts, of several ends of one start the last; ``mandatory`` is how many words
    the template demands. A row is matched by itself and there is no shuffle, so repeated rows, ties and hot groups change nothing.
    NULL and empty texts have no words and no match; very long texts are read in slices, and a match may span slices. Columns named
    ``n_words`` or ``matches`` are replaced, others of any name stay; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automaton(templates))  # a few hundred states of stated templates
    kept = [c for c in docs.columns if c not in ("text", "n_words", "matches")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_words", "long").add("matches", T._parse_datatype_string(MATCHES))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("mandatory", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in small_batches(batches, len(kept)):
            counts, matches = [], []
            for text in batch.column(len(kept)):
                n, found = automaton.scan(text.as_py() or "")
                rows = [(start, end, automaton.templates[k].label, automaton.templates[k].base, automaton.mandatory[k]) for (k, start), end in found.items()]
                counts.append(n)
                matches.append([{"label": label, "base": base, "start": start, "end": end, "mandatory": m} for start, end, label, base, m in sorted(rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(matches, kind)], [*kept, "n_words", "matches"])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")


def license_digest(matched: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``license_matches``.

    ``score`` is m / (m + 2) for the longest accepted wording of m mandatory words, 0 where nothing is accepted. A document without
    a base match has NULL places and empty labels.
    """
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    words = F.array_max(F.transform("matches", lambda m: m["mandatory"]))
    return matched.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("matches")).alias("labels"), F.coalesce(words / (words + 2), F.lit(0.0)).alias("score"),
    )
