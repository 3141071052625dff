"""Slow, plain reference implementations for the tests."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from operator import add


def align(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of the cheapest way; of equally cheap last steps the first listed counts."""

    @cache
    def best(i: int, j: int) -> tuple[int, int, int]:
        if not i or not j:
            return 0, i, j
        changed = int(ref[i - 1] != hyp[j - 1])
        ways = [(best(i - 1, j - 1), (changed, 0, 0)), (best(i - 1, j), (0, 1, 0)), (best(i, j - 1), (0, 0, 1))]
        return min((tuple(map(add, before, step)) for before, step in ways), key=sum)

    for i in range(len(ref)):
        for j in range(len(hyp)):
            best(i, j)  # in order, so that no call goes deep
    return best(len(ref), len(hyp))


def distance(a, b) -> int:
    """Least number of edits, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def tokens_13a(text: str) -> list[str]:
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, mark)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    text = re.sub(r"([0-9])(-)", r"\1 \2 ", text)
    return text.split()


def grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(pairs: list[tuple[str, str]], smooth: bool = True) -> float:
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for ref, hyp in pairs:
        r, h = tokens_13a(ref), tokens_13a(hyp)
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(4):
            match[n] += sum((grams(h, n + 1) & grams(r, n + 1)).values())
            total[n] += sum(grams(h, n + 1).values())
    if not any(match) or 0 in total or (not smooth and 0 in match):
        return 0.0
    logs, halvings = 0.0, 1
    for m, t in zip(match, total):
        if m == 0:
            halvings *= 2
            logs += math.log(1 / (halvings * t))
        else:
            logs += math.log(m / t)
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return (100.0 if smooth else 1.0) * penalty * math.exp(logs / 4)
