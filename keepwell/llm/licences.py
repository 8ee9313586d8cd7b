"""License scan: Aho-Corasick for notices and tags, shunting-yard for expressions.

One automaton finds the words of notice phrases, another the identifier tag
in the raw text.  What follows a tag on its line is a licence expression with
``and``, ``or``, ``with`` and parentheses; it is brought to postfix order and
evaluated to the licences it names and to whether a policy permits it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, per_text, schema_of
from keepwell.llm.decontam import words_of

#: Phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of this operator.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Licence identifiers start with one of these; the longest that fits gives the label.
IDENTIFIERS = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "isc": "isc", "bsl": "bsl",
    "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc0": "cc0", "unlicense": "public-domain",
}
PERMITTED = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "public-domain"})
TAG = "spdx-license-identifier:"
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")
_PART = re.compile(r"[()]|[,;/|&]+|[a-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Signs between licences: alternatives by a slash or bar, all of a list.
_SIGNS = {"/": "or", "|": "or", "||": "or", ",": "and", ";": "and", "&": "and", "&&": "and"}


def _fits(identifier: str) -> list[str]:
    return [k for k in IDENTIFIERS if identifier == k or identifier.startswith((k + "-", k + "+"))]


def label_of(identifier: str) -> str:
    """The label of a licence identifier; an unknown one is its own label."""
    fits = _fits(identifier)
    return IDENTIFIERS[max(fits, key=len)] if fits else identifier


def plausible(word: str) -> bool:
    """Whether a word can name a licence or exception: a known one, or letters with a digit or hyphen."""
    return bool(_fits(word)) or (any(c.isalpha() for c in word) and any(c.isdigit() or c == "-" for c in word) and ":" not in word)


def expression_of(line: str) -> str:
    """The licence expression that a line begins with, in plain operators; empty if it begins with none.

    Licences in a list are all meant, those beside a slash or bar are
    alternatives, and one that follows another without any operator is meant
    too.  The expression ends before the first word that can name no licence,
    with the operator that led there.
    """
    out: list[str] = []
    opened, by_sign = 0, False
    for part in _PART.findall(line):
        operand_next = not out or out[-1] in _RANK or out[-1] == "("
        operator = _SIGNS.get(part, part)
        if part[0] in ",;/|&":
            if operator in _RANK and not operand_next:
                out.append(operator)
                by_sign = True
        elif operator in _RANK:
            if operand_next and out and by_sign:
                out.pop()  # a comma before the word itself
            out.append(operator)
            by_sign = False
        elif part == "(":
            if not operand_next:
                break
            out.append(part)
            opened += 1
        elif part == ")":
            if not opened:
                break
            if operand_next and by_sign and out[-1] in _RANK:
                out.pop()
            out.append(part)
            opened -= 1
        elif not plausible(part):
            if operand_next and out and out[-1] in _RANK:
                out.pop()
            break
        else:
            if not operand_next:
                out.append("and")
            out.append(part)
            by_sign = False
    if out and by_sign and out[-1] in _RANK:
        out.pop()
    return " ".join(out)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if it is no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if token in _RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand_next:
            out.append(token)
            operand_next = False
        else:
            # A second operand in a row: the expression ended before it.
            break
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str, permitted: frozenset[str] = PERMITTED) -> tuple[frozenset[str], bool] | None:
    """The labels that an expression names, and whether ``permitted`` licences satisfy it.

    ``or`` needs one side, ``and`` both; ``with`` adds an exception to the
    licence on its left, which stays what it is.  None if the text does not
    begin with an expression.
    """
    order = postfix(expression_of(expression))
    if order is None:
        return None
    stack: list[tuple[frozenset[str], bool]] = []
    for token in order:
        if token not in _RANK:
            label = label_of(token)
            stack.append((frozenset({label}), label in permitted))
            continue
        (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
        stack.append((a, a_ok) if token == "with" else (a | b, (a_ok or b_ok) if token == "or" else (a_ok and b_ok)))
    return stack[0]


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, (len(word), value))
    out.make_automaton()
    return out


def scanner() -> Callable[[bytes | None], tuple]:
    """text -> (n_words, finds as (label, first word, words, base), expressions as (text, labels, permitted))."""
    notices = _automaton({f" {phrase} ": (label, phrase.count(" ") + 1, base) for base, group in ((False, NOTICES), (True, BASE)) for phrase, label in group.items()})
    tags = _automaton({TAG: None})

    def scan(text: bytes | None) -> tuple:
        words = words_of(text)
        finds: list[tuple[str, int, int, bool]] = []
        # Latin-1 gives every byte one character; letters beyond ASCII cannot be part of a phrase.
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = list(notices.iter(joined))
        if found:
            spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
            first = np.searchsorted(spaces, [end - size + 1 for end, (size, _) in found])
            finds = [(label, int(at), n, base) for at, (_, (_, (label, n, base))) in zip(first, found, strict=True)]
        expressions = []
        if text:
            low = text.lower().decode("latin-1")
            for end, _ in tags.iter(low):
                stop = low.find("\n", end)
                expression = low[end + 1 : stop if stop >= 0 else len(low)].strip()
                value = evaluate(expression)
                if value is not None:
                    expressions.append((expression, value[0], value[1]))
        return len(words), finds, expressions

    return scan


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, finds, expressions, permitted): one row for each row of ``docs``.

    ``finds`` are all places of notice phrases, overlapping ones too;
    ``expressions`` the tagged expressions that parse, with their labels and
    whether the policy permits them.  ``permitted`` is null without any find,
    else whether all labels of notices and all expressions are permitted.
    Null counts as empty.  Repeated rows are treated alike, each for itself; an
    empty table gives no rows; other columns do not matter.
    """
    rows = id_and_text(docs, id_col, text_col)
    finds = "array<struct<label:string,word:long,n:long,base:boolean>>"
    schema = schema_of(rows, "id", ("n_words", "long"), ("finds", finds), ("expressions", "array<struct<text:string,labels:array<string>,permitted:boolean>>"), ("permitted", "boolean"))

    def make():
        scan = scanner()

        def one(text: bytes | None) -> tuple:
            n, found, expressions = scan(text)
            allowed = all(f[0] in PERMITTED for f in found) and all(e[2] for e in expressions) if found or expressions else None
            return (
                n,
                [{"label": a, "word": b, "n": c, "base": d} for a, b, c, d in found],
                [{"text": t, "labels": sorted(ls), "permitted": ok} for t, ls, ok in expressions],
                allowed,
            )

        return one

    return per_text(rows, schema, make)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; then permitted.

    ``score`` grows with the number of places and tagged expressions: 1 - 0.5 ** n.
    """
    out = scan_licences(docs).withColumn("base", F.filter("finds", lambda f: f["base"]))
    labels = F.array_union(F.transform("finds", lambda f: f["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    words = F.transform("base", lambda f: f["word"])
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(F.transform("base", lambda f: f["label"])).alias("base_labels"),
        joined(labels).alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("finds") + F.size("expressions"))).alias("score"),
        "permitted",
    )
