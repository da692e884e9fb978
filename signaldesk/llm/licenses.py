"""License scans: an Aho-Corasick pass over words finds phrases and tags, a shunting-yard parser reads expressions.

Texts are taken as bytes, A-Z lower-cased; words are runs of a-z, 0-9 and bytes above 127.  One automaton over the
space-joined words finds the base phrases, further notice phrases and identifier tags at once.  The expression after a
tag is parsed into and/or/with with the usual precedence and evaluated to its labels and to whether every way of
fulfilling it is share-alike; a text is share-alike by its expressions or by the phrases it holds.

Defined results: a null or empty text has no words, no places, null first and last words, empty labels and score 0;
repeated rows are scanned alike; an empty table gives an empty table; other columns play no part; texts are read whole.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from signaldesk.llm.common import small_batches, table

#: The base phrases and labels of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "isc license": "isc", "creative commons": "cc",
    "public domain": "public-domain", "boost software license": "bsl", "all rights reserved": "reserved"}
TAG = "spdx license identifier"
#: First part of an identifier and its label; share-alike labels.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc": "cc", "bsl": "bsl", "unlicense": "public-domain"}
SHARE_ALIKE = frozenset({"gpl", "agpl", "lgpl", "mpl", "epl"})

BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
_TAGGED = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")


def leading_postfix(tokens: list[str]) -> tuple[list[str], int]:
    """Shunting yard: operands and operators in postfix order of the longest leading part that is well formed, and its length."""
    out: list[str] = []
    ops: list[str] = []
    operand, depth, best = False, 0, (0, (), 0)
    for at, t in enumerate(tokens, 1):
        if t in BINDS or t == ")":
            if not operand or (t == ")" and not depth):
                break
            while ops and ops[-1] != "(" and (t == ")" or BINDS[ops[-1]] >= BINDS[t]):
                out.append(ops.pop())
            if t == ")":
                ops.pop()
                depth -= 1
            else:
                ops.append(t)
                operand = False
        elif operand:
            break
        elif t == "(":
            ops.append(t)
            depth += 1
        else:
            out.append(t)
            operand = True
        if operand and not depth:
            best = len(out), tuple(ops), at   # outside brackets at most one operator of each rank is open
    return out[:best[0]] + list(best[1][::-1]), best[2]


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Operands and operators in postfix order; None if the expression is malformed."""
    postfix, used = leading_postfix(tokens)
    return postfix if tokens and used == len(tokens) else None


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels that take part, and whether every choice is share-alike."""
    stack: list[tuple[set[str], bool]] = []
    for t in postfix:
        if t in BINDS:
            (b, b_alike), (a, a_alike) = stack.pop(), stack.pop()
            stack.append((a, a_alike) if t == "with" else (a | b, a_alike and b_alike if t == "or" else a_alike or b_alike))
        else:
            label = FAMILIES.get(t.split("-")[0].rstrip("+"), "other")
            stack.append(({label}, label in SHARE_ALIKE))
    return stack.pop()


def expression_labels(line: bytes) -> tuple[set[str], bool]:
    """Of the longest leading part of the line that is a well-formed expression (comment ends may follow)."""
    postfix, _ = leading_postfix([t.decode() for t in _TOKEN.findall(line)])
    return evaluate(postfix) if postfix else (set(), False)


def _table() -> bytes:
    keep = bytearray(b" " * 256)
    for c in range(256):
        if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127:
            keep[c] = c
        elif 65 <= c <= 90:
            keep[c] = c + 32
    return bytes(keep)


def _scan(parts):
    words_only, lower = _table(), bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    found = ahocorasick.Automaton()
    for phrase in [*BASE_PHRASES, *NOTICE_PHRASES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()

    def one(text: bytes | None):
        words = (text or b"").translate(words_only).split()
        joined = b" " + b" ".join(words) + b" "
        base, labels, starts, notices, tagged = set(), set(), [], 0, False
        for end, phrase in found.iter(joined.decode("latin-1")):
            if phrase in BASE_PHRASES:
                base.add(BASE_PHRASES[phrase])
                starts.append(end - len(phrase))
            else:
                notices += 1
                tagged |= phrase == TAG
                labels |= {NOTICE_PHRASES[phrase]} if phrase != TAG else set()
        labels |= base
        alike = bool(labels & SHARE_ALIKE)
        for line in _TAGGED.findall(text.translate(lower)) if tagged else ():
            got, share = expression_labels(line)
            labels |= got
            alike |= share
        places = []
        if starts:
            # A place's number is that of the blanks before it.
            blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            places = (np.searchsorted(blanks, starts) - 1).tolist()
        score = 1 - 0.25 ** len(places) * 0.5 ** notices
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score, alike)

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "share_alike")
    for pdf in parts:
        rows = pd.DataFrame([one(t) for t in pdf["text"]], columns=names, index=pdf.index)
        for c in ("first_word", "last_word"):
            rows[c] = pd.array(rows[c], dtype="Int64")
        yield pd.concat([pdf[["doc_id"]], rows], axis=1)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Words, places, labels, score and share-alike flag of every document."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(
        _scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, share_alike boolean")


def license_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
