"""Text expressions: cleaning, n-grams, lexical signals, label parsing.

All of it runs inside the JVM; no Python worker is started.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazarlens.fixed_values import CLASSIFY_PROMPT, RESIDUAL_LABEL, STOPWORDS_PT, TAXONOMY

# A word character is a letter, a number or "_"; blanks include the separators
# U+001C..U+001F, which the JVM class leaves out.
NOT_WORD_OR_BLANK = r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]"
DIGITS = r"\p{Nd}+"
BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"

ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def clean_tokens(text: Column, stopwords: list[str] = STOPWORDS_PT, min_length: int = 3) -> Column:
    """Lower-case tokens without punctuation, digits, stopwords and short words.

    Digits are removed, not replaced by a blank: ``a1b`` becomes ``ab``.
    """
    spaced = F.regexp_replace(F.lower(text), NOT_WORD_OR_BLANK, " ")
    tokens = F.split(F.regexp_replace(spaced, DIGITS, ""), BLANKS)
    return F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~t.isin(*stopwords))


def clean_text(text: Column, stopwords: list[str] = STOPWORDS_PT, min_length: int = 3) -> Column:
    """The cleaned tokens joined by one blank."""
    return F.array_join(clean_tokens(text, stopwords, min_length), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens; empty for a shorter array."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def signal_text(text: Column) -> Column:
    """Accent-free text padded by blanks, on which signals are searched.

    Stopwords stay: several signals contain one.
    """
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    spaced = F.regexp_replace(plain, NOT_WORD_OR_BLANK, " ")
    return F.concat(F.lit(" "), F.regexp_replace(spaced, BLANKS, " "), F.lit(" "))


def signal_tokens(text: Column) -> Column:
    return F.split(F.trim(signal_text(text)), " ")


def signal_matches(tokens: Column, signals: list[str]) -> Column:
    """The distinct signals that occur as whole words among the tokens of a text.

    ``tokens`` is a column that exists already: it is used several times. Runs of as many tokens as signals have words are looked up in a hash set
    of the signals, so the work does not grow with their number. Longer runs
    are formed only in a text with a word that begins a longer signal.
    """
    by_length: dict[int, list[str]] = {}
    for signal in dict.fromkeys(signals):
        by_length.setdefault(len(signal.split(" ")), []).append(signal)
    literal = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    found = [F.array_intersect(tokens, literal(by_length.pop(1, [])))]
    if by_length:
        begins = literal(sorted({s.split(" ")[0] for words in by_length.values() for s in words}))
        longer = [F.array_intersect(ngrams(tokens, n), literal(words)) for n, words in sorted(by_length.items())]
        found.append(F.when(F.arrays_overlap(tokens, begins), F.concat(*longer)).otherwise(F.array().cast("array<string>")))
    return F.concat(*found)


def signal_hits(matches: Column, signals: list[str]) -> Column:
    """How many of the signals are among the matches of a text."""
    return F.size(F.array_intersect(matches, F.array(*map(F.lit, signals)).cast("array<string>"))).cast("long")


def parse_label(answer: Column, taxonomy: list[str] = TAXONOMY, residual: str = RESIDUAL_LABEL) -> Column:
    """First label of the taxonomy that the answer contains, in any case."""
    lowered = F.lower(answer)
    tests = [F.when(lowered.contains(label.lower()), F.lit(label)) for label in taxonomy]
    return F.coalesce(*tests, F.lit(residual))


def classify_prompt(comment: Column, template: str = CLASSIFY_PROMPT) -> Column:
    """The classification prompt with the trimmed comment put in."""
    head, tail = template.split("{comment}")
    trimmed = F.regexp_replace(comment, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    return F.concat(F.lit(head), trimmed, F.lit(tail))


def truncate_text(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
