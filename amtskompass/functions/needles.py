"""Many keyword rules in one pass over a text.

Testing a text with ``contains`` reads it once for each needle, some 170 times for the display rules.  An Aho-Corasick
automaton over all needles reads it once.  Texts go to Python in Arrow batches; what comes back is one number with a bit
for each rule that has a needle in the text, from which labels follow in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import pieces

Rules = Sequence[tuple[str, Sequence[str]]]
MOST_RULES = 62  # bits of a positive long


@lru_cache(maxsize=32)
def automaton(needles: tuple[tuple[str, ...], ...]) -> tuple[ahocorasick.Automaton, int]:
    """Automaton whose values have the bits of the rules a needle belongs to, and all bits.  Built once for each worker."""
    masks: dict[str, int] = {}
    for bit, words in enumerate(needles):
        for word in words:
            masks[word] = masks.get(word, 0) | 1 << bit
    always = masks.pop("", 0)  # an empty needle is in every text
    found = ahocorasick.Automaton()
    for word, mask in masks.items():
        found.add_word(word, mask)
    if masks:
        found.make_automaton()
    return found, always


def bits_of(text: str, needles: tuple[tuple[str, ...], ...]) -> int:
    """Bits of the rules that have a needle in ``text``."""
    found, bits = automaton(needles)
    if len(found):
        for _, mask in found.iter(text):
            bits |= mask
    return bits


def rule_bits(text: Column, *rules: Rules) -> Column:
    """One bit for each rule of all lists, in order; null for a null text."""
    needles = tuple(tuple(words) for some in rules for _, words in some)
    if len(needles) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules at once")

    @F.arrow_udf(T.LongType())
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            for texts in pieces(some):
                yield pa.array([None if t is None else bits_of(t, needles) for t in texts], pa.int64())

    return found(text)


def has_bit(bits: Column, bit: int) -> Column:
    return F.coalesce(bits.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(False))


def first_label(bits: Column, rules: Rules, default: Column, at: int = 0) -> Column:
    """Label of the first rule that is set; ``at`` is the bit of the list's first rule."""
    result: Column | None = None
    for i, (label, _) in enumerate(rules):
        hit = has_bit(bits, at + i)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return default if result is None else result.otherwise(default)


def all_labels(bits: Column, rules: Rules, at: int = 0) -> Column:
    """Labels of all rules that are set, in rule order."""
    return F.array_compact(F.array(*[F.when(has_bit(bits, at + i), F.lit(label)) for i, (label, _) in enumerate(rules)]))
