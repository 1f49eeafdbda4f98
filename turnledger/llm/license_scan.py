"""License scan by template markup.

A license template is wording with marked regions: optional text that may be missing, and
replaceable text of a bounded number of words. Templates are compiled to automata over
words; a place in a text is accepted if all mandatory wording is there, word by word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.frames import prepare, text_bytes
from turnledger.llm.license_texts import BASE_PHRASES, TEMPLATES
from turnledger.llm.text import slices

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
ANY = None


def normal_form(text: bytes) -> bytes:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, a space around each."""
    inner = b" ".join(text.translate(_FOLD).split())
    return b" " + inner + b" " if inner else b" "


@dataclass
class Template:
    """A compiled template: transitions of a nondeterministic automaton, run as subsets.

    ``steps[s]`` maps a word (or ``ANY``) to the next states; ``skips[s]`` are the states
    reached without a word. Subsets and their steps are remembered as they are met.
    """

    label: str
    steps: list[dict] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    mandatory: int = 0
    anchor: bytes = b""
    _known: dict = field(default_factory=dict)

    def state(self) -> int:
        self.steps.append({})
        self.skips.append([])
        return len(self.steps) - 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if any(word in self.steps[s] for s in states) else ANY)
        if key not in self._known:
            reached = {t for s in states for t in (*self.steps[s].get(key[1], ()), *self.steps[s].get(ANY, ()))}
            self._known[key] = self.closure(reached)
        return self._known[key]

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest acceptance that begins at ``start``, or -1."""
        end, states = -1, self.first
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end

    def accepts(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted places from left to right, without overlap."""
        found, at = [], 0
        while at < len(words):
            end = self.longest(words, at) if words[at] in self.openers or self.opens_free else -1
            if end > at:
                found.append((at, end))
                at = end
            else:
                at += 1
        return found


def compile_template(label: str, markup: str) -> Template:
    """Parse the markup; raises ``ValueError`` on unbalanced marks or without mandatory words."""
    out = Template(label)
    here, outer, run, longest = out.state(), [], [], []
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        for word in normal_form(markup[at : mark.start() if mark else len(markup)].encode()).split():
            after = out.state()
            out.steps[here].setdefault(word, []).append(after)
            here = after
            if not outer:
                out.mandatory += 1
                run.append(word)
                longest = max(longest, list(run), key=len)
        if mark is None:
            break
        at, run = mark.end(), []
        if mark[1] == "beginOptional":
            outer.append(here)
        elif mark[1] == "endOptional":
            if not outer:
                raise ValueError(f"{label}: endOptional without beginOptional")
            after = out.state()
            out.skips[outer.pop()].append(after)
            out.skips[here].append(after)
            here = after
        else:
            least, most = int(mark[2]), int(mark[3])
            after = out.state()
            for k in range(most):
                if k >= least:
                    out.skips[here].append(after)
                further = out.state()
                out.steps[here].setdefault(ANY, []).append(further)
                here = further
            out.skips[here].append(after)
            here = after
    if outer:
        raise ValueError(f"{label}: beginOptional without endOptional")
    if not out.mandatory:
        raise ValueError(f"{label}: no mandatory wording")
    out.final, out.first = here, out.closure([0])
    out.anchor = b" " + b" ".join(longest) + b" "
    out.openers = {w for s in out.first for w in out.steps[s] if w is not ANY}
    out.opens_free = any(ANY in out.steps[s] for s in out.first)
    return out


def phrase_places(text: bytes, phrase: bytes) -> list[int]:
    """Word positions of all places of a phrase in a normal form, overlaps included."""
    found, word, seen = [], 0, 0
    at = text.find(phrase)
    while at >= 0:
        word += text.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = text.find(phrase, at + 1)
    return found


class Scanner:
    """Base phrases and compiled templates, applied to one text after another."""

    def __init__(self, phrases: dict[str, str] | None = None, templates=None):
        self.phrases = [(normal_form(p.encode()), label) for p, label in (phrases or BASE_PHRASES).items()]
        self.templates = [compile_template(label, markup) for label, markup in (templates or TEMPLATES)]

    def scan(self, body: bytes) -> dict:
        text = normal_form(body)
        places, base = [], set()
        for phrase, label in self.phrases:
            if own := phrase_places(text, phrase):
                places += own
                base.add(label)
        labels, score, n_template, words = set(base), 1.0 if base else 0.0, 0, None
        for template in self.templates:
            if template.anchor in text:
                words = text.split() if words is None else words
                for start, end in template.accepts(words):
                    labels.add(template.label)
                    n_template += 1
                    score = max(score, template.mandatory / (end - start))
        return {
            "n_words": text.count(b" ") - 1,
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "n_template": n_template,
        }


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_template long"
)
_ARROW = pa.struct(
    [
        *((name, pa.int64()) for name in ("n_words", "n_base", "first_word", "last_word")),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_template", pa.int64()),
    ]
)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates=None) -> DataFrame:
    """One row per document with base places, labels and score.

    ``labels`` holds the base labels and those of accepted templates. ``score`` is 1 for a
    base phrase, else the largest share of mandatory words in an accepted place, else 0.
    Null and empty texts have no words and no labels. Texts are read whole; each is scanned
    in memory of a few times its size. Repeated rows are scanned alike, an empty table gives
    no rows, other columns are ignored.
    """
    prepare(docs.sparkSession)
    held: list[Scanner] = []

    @F.arrow_udf(RESULT)
    def scan(bodies: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(phrases, templates))
        rows = [
            held[0].scan(part.document(i)) for part in slices(bodies) for i in range(part.last - part.first)
        ]
        return pa.array(rows, _ARROW)

    return docs.select("doc_id", scan(text_bytes()).alias("found")).select("doc_id", "found.*")


def op2_license_scan(spark, sf_dir):
    return scan_licenses(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
