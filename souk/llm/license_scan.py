"""Licence scan (1).

One Aho-Corasick automaton finds notice phrases (as runs of whole words) in the
folded word text; another finds identifier tags (``SPDX-License-Identifier:``
and the like) in the text itself. The expression after a tag is read by a
shunting-yard parser and evaluated with and/or/with.

Edge cases: null and empty texts have no words, no labels and score 0. Broken
expressions add no label. Repeated rows each give a row. Columns beside the id
and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import FOLD, slices, text_buffer, text_of

#: Phrases and labels that the contract fixes.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: phrase, label.
MORE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache-2.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "proprietary and confidential": "proprietary",
}
#: Tags after which an expression stands, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Restrictiveness from 0 (no condition) to 1 (no permission).
RESTRICTIVE = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.8, "agpl": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.6
#: What an exception (``with``) takes off.
RELIEF = 0.3
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")


def restrictiveness(label: str) -> float:
    """Of an identifier: that of its longest known prefix."""
    known = [k for k in RESTRICTIVE if label == k or label.startswith(k + "-")]
    return RESTRICTIVE[max(known, key=len)] if known else UNKNOWN


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the tokens are no expression."""
    output, stack, operand_next = [], [], True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                output.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            output.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return output + stack[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """Identifiers of an expression and its restrictiveness: ``or`` lets one
    choose (least), ``and`` binds to both (most), ``with`` grants an exception."""
    postfix = to_postfix(_TOKEN.findall(expression.lower()))
    if postfix is None:
        return None
    stack: list[tuple[frozenset[str], float]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((frozenset([token]), restrictiveness(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, max(0.0, a - RELIEF)))
        else:
            stack.append((left | right, min(a, b) if token == "or" else max(a, b)))
    return stack[0]


_PART = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+-]*)")


def _expression_at(text: str, start: int) -> str:
    """The longest stretch of the line from ``start`` that can be an expression:
    operands and operators take turns, so prose after it is not read."""
    line = re.compile(r"[^\r\n]*").match(text, start)[0]
    at, end, operand_next, depth = 0, 0, True, 0
    while match := _PART.match(line, at):
        token = match[1]
        if token == "(" and operand_next:
            depth += 1
        elif token == ")" and depth and not operand_next:
            depth -= 1
        elif token in PRECEDENCE and not operand_next:
            operand_next = True
        elif token not in PRECEDENCE and token not in "()" and operand_next:
            operand_next = False
        else:
            break
        at = match.end()
        if not operand_next and not depth:
            end = at
    return line[:end]


class Scanner:
    """The automata; built once in each Python worker."""

    def __init__(self, phrases: dict[str, str], base: frozenset[str]):
        self.phrases = ahocorasick.Automaton()
        for phrase, label in phrases.items():
            self.phrases.add_word(f" {phrase} ", (label, len(phrase), phrase in base))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def notices(self, spaced: str) -> list[tuple[int, str, bool]]:
        """(word number, label, base?) of each phrase. ``spaced``: the words, a
        blank before and after each."""
        hits = sorted((end - length, label, base) for end, (label, length, base) in self.phrases.iter(spaced))
        found, number, upto = [], -1, 0
        for start, label, base in hits:
            number += spaced.count(" ", upto, start)
            upto = start
            found.append((number, label, base))
        return found

    def expressions(self, text: str) -> list[tuple[frozenset[str], float]]:
        lowered = text.lower()
        found = (evaluate(_expression_at(lowered, end + 1)) for end, _ in self.tags.iter(lowered))
        return [x for x in found if x]


_SPACED = np.where(FOLD == 0, 32, FOLD).astype(np.uint8)
_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, expressions (how many were read). ``phrases``:
    further ones, in folded words. A narrow map: nothing is shuffled."""
    known, base = BASE_PHRASES | MORE_PHRASES | (phrases or {}), frozenset(BASE_PHRASES)
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, base)
        for batch in slices(batches):
            raw, offsets = text_buffer(batch.column("text"))
            folded = _SPACED[raw].tobytes()
            rows = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = folded[a:b].split()
                hits = scanner.notices(f" {b' '.join(words).decode()} ")
                own = [h for h in hits if h[2]]
                evaluated = scanner.expressions(batch.column("text")[i].as_py()) if b"license" in folded[a:b] else []
                burdens = [restrictiveness(h[1]) for h in hits] + [e[1] for e in evaluated]
                labels = {h[1] for h in hits}.union(*(e[0] for e in evaluated))
                rows.append((len(words), len(own), own[0][0] if own else None, own[-1][0] if own else None, ",".join(sorted({h[1] for h in own})), ",".join(sorted(labels)), max(burdens, default=0.0), len(evaluated)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *_OUT.names])

    return source.mapInArrow(work, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions long").withColumnRenamed("id", id_col)
