"""Fill-in-the-middle: a document's middle is moved to its end, behind sentinels, by a two-pass streaming matcher.

The first pass counts the units of a text, the second advances a lazy match iterator to the two cuts; matches are
never stored, so the memory beside the text and its output is constant however many units there are. The draws of a document
come from a hash of its id, so a result depends on the row alone and a lost task repeats it.

Defined cases: a null text is an empty one; empty texts, texts that hold a sentinel and rows without an id stay plain. A cut may fall on
the start or the end, so each part may be empty. Rows that share an id share its draws. Extra columns pass through; those
named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Fixed values of the contract: a unit is a word with the white space before it, or the white space at the end; sentinels; draws.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SUFFIX_FIRST = 42, 50, 80


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cuts(text: str, first: int, last: int) -> tuple[int, int]:
    """Where unit ``first`` and the later or same unit ``last`` begin, in code points."""
    matches, places, at = UNIT.finditer(text), [], 0
    for skip in (first, last - first):
        if skip:
            at = next(islice(matches, skip - 1, None)).end()
        places.append(at)
    return places[0], places[1]


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 that depend on the id and the seed alone."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one document."""
    text = text or ""
    n = count_units(text)
    if doc_id is None or not text or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b, whether, which = draws(doc_id, seed)
    if whether % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = cuts(text, *sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if which % 100 < suffix_first:
        return n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``; ``rate`` of 100 documents are rearranged, ``suffix_first`` of 100 of them as spm."""

    def made(ids: list, texts: list) -> list:
        found = [rearrange(i, t, seed, rate, suffix_first) for i, t in zip(ids, texts, strict=True)]
        return list(map(list, zip(*found, strict=True))) if found else [[]] * 5

    return common.append_columns(df, [id_col, text], "n long, form string, prefix_chars long, middle_chars long, output string", made)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone. The parts hold no sentinel and no sentinel overlaps another, so the first of each ends its part."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    part = lambda s, by, k: F.split_part(s, F.lit(by), F.lit(k))
    second = {f: part(rest, s, 2) for f, s in (("psm", SUFFIX), ("spm", PREFIX))}
    psm = F.concat(part(rest, SUFFIX, 1), part(second["psm"], MIDDLE, 2), part(second["psm"], MIDDLE, 1))
    spm = F.concat(part(second["spm"], MIDDLE, 1), part(second["spm"], MIDDLE, 2), part(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
