"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space between words (ASCII and Unicode).
WHITESPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# English stop words of the frequency report.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are aren't as at be because been
    before being below between both but by can can't cannot com could couldn't did didn't do does
    doesn't doing don't down during each else ever few for from further get had hadn't has hasn't
    have haven't having he he'd he'll he's hence her here here's hers herself him himself his how
    how's however http i i'd i'll i'm i've if in into is isn't it it's its itself just k let's like
    me more most mustn't my myself no nor not of off on once only or other otherwise ought our ours
    ourselves out over own r same shall shan't she she'd she'll she's should shouldn't since so
    some such than that that's the their theirs them themselves then there there's therefore these
    they they'd they'll they're they've this those through to too under until up very was wasn't we
    we'd we'll we're we've were weren't what what's when when's where where's which while who who's
    whom why why's with won't would wouldn't www you you'd you'll you're you've your yours yourself
    yourselves""".split()
)

# Characters that become spaces, then characters that are removed.
SPACED = "/-'"
REMOVED = "/-'?!.,#$%'()*+-/:;<=>@[\\]^_`{|}~" + '""“”’' + "∞θ÷α•à−β∅³π‘₹´°£€\\×™√²—–&"

# Characters that separate words when texts become id sequences.
SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def words(text: Column) -> Column:
    """Words between runs of white space, no empty ones."""
    return F.array_remove(F.split(text, f"[{WHITESPACE}]+"), "")


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def separated(text: Column) -> Column:
    """Lower-case text whose separators became spaces."""
    return F.translate(F.lower(text), SEPARATORS, " " * len(SEPARATORS))


def separated_words(text: Column) -> Column:
    """Lower-case words between spaces after separators became spaces."""
    return F.array_remove(F.split(separated(text), " "), "")


def words_and_punctuation(text: Column) -> Column:
    """Runs of word characters and runs of other visible characters."""
    pattern = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WHITESPACE}]+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without(tokens: Column, stop: Sequence[str], ignore_case: bool = False) -> Column:
    stop = list(stop)
    if ignore_case:
        return F.filter(tokens, lambda w: ~F.lower(w).isin(stop))
    return F.filter(tokens, lambda w: ~w.isin(stop))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space; empty for shorter arrays."""
    last = F.size(tokens) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)])
    )


def cleaned(text: Column) -> Column:
    """Separating marks become spaces, then all listed punctuation goes."""
    return F.translate(F.translate(text, SPACED, " " * len(SPACED)), REMOVED, "")


def padded(ids: Column, length: int) -> Column:
    """The last ``length`` ids, with zeros in front if there are fewer."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), length - F.size(kept)), kept)
