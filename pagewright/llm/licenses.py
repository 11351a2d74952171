"""License scans: an Aho-Corasick automaton over a text's words, and a shunting-yard parser of licence expressions.

The automaton finds notice phrases and the tag "spdx license identifier". The
expression after a tag is read from the raw text: identifiers, and, or, with
and parentheses. The parser puts it in postfix order and evaluates it to the
least permissive class that its reader has to accept: and takes the more
restrictive side, or the freer one, with frees its licence by one class.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts, texts_of

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Phrases of the method's own, and labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "all rights reserved": "reserved",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
# Beginnings of licence identifiers, their label and class (0 free, 1 file copyleft, 2 copyleft, 3 closed).
FAMILIES = {
    "agpl": ("agpl", 2),
    "lgpl": ("lgpl", 1),
    "gpl": ("gpl", 2),
    "apache": ("apache", 0),
    "mit": ("mit", 0),
    "bsd": ("bsd", 0),
    "isc": ("isc", 0),
    "mpl": ("mpl", 1),
    "epl": ("epl", 1),
    "cc-by-nc": ("cc-by-nc", 3),
    "cc-by-sa": ("cc-by-sa", 2),
    "cc-by": ("cc-by", 0),
    "cc0": ("public-domain", 0),
    "unlicense": ("public-domain", 0),
    "proprietary": ("reserved", 3),
}
#: The score of a text by the most restrictive class found; without any finding it is 0.
CLASS_SCORE = (1.0, 0.7, 0.4, 0.1)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Everything up to 0x7F that is neither a digit nor a lower-case letter parts words.
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]+)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+\-]+")


def family(identifier: str) -> tuple[str, int] | None:
    hits = [k for k in FAMILIES if identifier.startswith(k)]
    return FAMILIES[max(hits, key=len)] if hits else None


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order by the shunting-yard method; None if it isn't well formed.

    Reading stops before the first token that cannot follow, as tags stand in
    comments and prose; at least one identifier must have been read.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        if token in PRECEDENCE:
            if not operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], int] | None:
    """Labels of all named licences, and the class of the whole; None if no licence is known."""
    stack: list[tuple[set[str], int | None]] = []
    for token in rpn:
        if token not in PRECEDENCE:
            known = family(token)
            stack.append(({known[0]}, known[1]) if known else (set(), None))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], None if left[1] is None else max(0, left[1] - 1)))
            continue
        classes = [c for c in (left[1], right[1]) if c is not None]
        stack.append((left[0] | right[0], None if not classes else min(classes) if token == "or" else max(classes)))
    labels, found = stack[0]
    return None if found is None else (labels, found)


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score for every row.

    Words are runs of 0-9, a-z (A-Z in lower case) and bytes over 0x7F. Null
    and empty texts have no words, null word places, empty labels and score 0.
    Overlapping and repeated phrases count at each place. Rows with equal ids
    are scanned each; other columns are ignored.
    """
    phrases = {p: ("notice", label) for p, label in notices.items()} | {TAG: ("tag", "")} | {p: ("base", label) for p, label in base.items()}

    def start():
        automaton = _automaton(phrases)

        def run(batch):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score")}
            for text in texts(batch):
                lower = text.lower()
                words = lower.translate(_TO_SPACE).split()
                line = f" {b' '.join(words).decode()} "
                places, own, all_labels, rated, said = [], set(), set(), [], []
                tagged = False
                for end, (phrase, (kind, label)) in automaton.iter(line):
                    if kind == "tag":
                        tagged = True
                        continue
                    all_labels.add(label)
                    known = family(label)
                    rated.append(known[1] if known else 3 if label == "reserved" else 0)
                    if kind == "base":
                        own.add(label)
                        places.append(end - len(phrase) - 1)
                if tagged:
                    for m in _TAGGED.finditer(lower.decode()):
                        rpn = postfix(m[1])
                        value = evaluate(rpn) if rpn else None
                        if value:
                            said.append(" ".join(rpn))
                            all_labels |= value[0]
                            rated.append(value[1])
                first, last = (line.count(" ", 0, min(places)), line.count(" ", 0, max(places))) if places else (None, None)
                for k, v in (("n_words", len(words)), ("n_base", len(places)), ("first_word", first), ("last_word", last), ("base_labels", ",".join(sorted(own))), ("labels", ",".join(sorted(own | all_labels))), ("expressions", said), ("score", CLASS_SCORE[max(rated)] if rated else 0.0)):
                    out[k].append(v)
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "expressions": pa.list_(pa.string()), "score": pa.float64()}
            return {"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

        return run

    return map_arrow(texts_of(docs), start, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double")
