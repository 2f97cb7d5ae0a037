"""Text analysis: tokens, folding, stemming, k-mers and character classes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Runs of letters or of numbers.
PLAIN = "\\p{L}+|\\p{N}+"
#: Comments, CDATA, processing instructions, definitions and tags; a quoted > does not end a tag.
MARKUP = "<!--(?s:.*?)-->|<!\\[(?s:.*?)\\]\\]?>|<\\?(?s:.*?)\\?>|<![A-Z](?s:[^>]*)>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
MAX_TOKEN_BYTES = 1024


def without_markup(text: Column) -> Column:
    """Markup of all kinds gives way to a blank, so text within CDATA and comments is dropped."""
    return F.regexp_replace(text, MARKUP, " ")


def tokens(text: Column, pattern: str = PLAIN) -> Column:
    """Lower-cased runs of letters or numbers, JVM side."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def cut(term: Column) -> Column:
    """At most MAX_TOKEN_BYTES bytes, whole characters."""
    raw = F.substring(F.encode(term, "utf-8"), 1, MAX_TOKEN_BYTES).cast("string")
    return F.when(F.octet_length(term) <= MAX_TOKEN_BYTES, term).otherwise(F.rtrim(F.make_valid_utf8(raw), F.lit("\ufffd")))


_WANTED = regex.compile(r"[\p{Alphabetic}\p{N}]")


@lru_cache(1 << 16)
def fold_char(c: str) -> str:
    """Compatibility decomposition, without what is neither alphabetic nor a number, case-folded."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if _WANTED.match(x)).casefold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() and text.isalnum() else "".join(map(fold_char, text))


#: The kinds of tokens, found in this order at each place: markup, runs of alphabetic code points (letters, letter
#: numbers and the marks that stand with letters), runs of numbers, anything else but white space.
_TOKENS = regex.compile(f"(?P<markup>{MARKUP})|(?P<alpha>\\p{{Alphabetic}}+)|(?P<numeric>\\p{{N}}+)|(?P<other>\\S)")
_RUNS = regex.compile(r"\p{Alphabetic}+|\p{N}+")
_ASCII_RUNS = re.compile("[A-Za-z]+|[0-9]+")


def segment(text: str) -> Iterator[tuple[str, str]]:
    """(type, lexeme) of each token: alpha and numeric runs found on the raw code points and folded afterwards, markup
    by its kind, all else one character as 'other'; white space between tokens is skipped."""
    for m in _TOKENS.finditer(text):
        kind = m.lastgroup
        if kind == "markup":
            yield _markup_kind(m[0]), m[0]
        else:
            yield kind, m[0] if kind == "other" else _cut(fold(m[0]))


def folded_runs(text: str) -> list[str]:
    """The runs of letters and of numbers, folded; plain ASCII takes the quick way."""
    if text.isascii():
        return [w[:MAX_TOKEN_BYTES] for w in _ASCII_RUNS.findall(text.lower())]
    return [w for w in (_cut(fold(r)) for r in _RUNS.findall(text)) if w]


_TAG = re.compile(MARKUP)


def _cut(word: str) -> str:
    """At most MAX_TOKEN_BYTES bytes, whole characters."""
    raw = word.encode()
    return word if len(raw) <= MAX_TOKEN_BYTES else raw[:MAX_TOKEN_BYTES].decode(errors="ignore")


def _markup_kind(tag: str) -> str:
    for begin, kind in (("<!--", "comment"), ("<![CDATA[", "cdata"), ("<![", "conditional"), ("<!", "definition"), ("<?", "processing_instruction"), ("</", "xml_end_tag")):
        if tag.startswith(begin):
            return kind
    return "xml_empty_tag" if tag.endswith("/>") else "xml_start_tag"


def indexed(text: str) -> list[str]:
    """The tokens an index takes: alpha and numeric."""
    return folded_runs(_TAG.sub(" ", text) if "<" in text else text)


@lru_cache(1 << 17)
def _runs_of(piece: str) -> str:
    return "\n".join(folded_runs(piece))


def joined_runs(text: str) -> str:
    """indexed() as lines: no run has white space in it, so pieces between are folded apart, and frequent ones once."""
    text = _TAG.sub(" ", text) if "<" in text else text
    return "\n".join([r for w in text.split() if (r := _runs_of(w) if len(w) < 64 else "\n".join(folded_runs(w)))])


#: Texts that are Python objects side by side.
SLICE = 64


@arrow_udf(StringType())
def _joined(text: pa.Array) -> pa.Array:
    parts = [pa.array([joined_runs(t) if t is not None else "" for t in text.slice(a, SLICE).to_pylist()], pa.string()) for a in range(0, len(text), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def full_tokens(text: Column) -> Column:
    """indexed() over a column, for full folding; plain text is quicker with tokens(). One string a text leaves Python, and
    a batch is gone through by slices, so its texts and words are never objects side by side."""
    return F.array_remove(F.split(_joined(text), "\n"), "")


@pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("lexeme", StringType())])))
def typed_tokens(text: pd.Series) -> pd.Series:
    """Every token with its type, markup too."""
    return text.map(lambda t: [{"type": k, "lexeme": w} for k, w in segment(t or "")])


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold(t))


def query_tokens(text: str) -> list[str]:
    """Query words: no markup, runs as in documents."""
    return folded_runs(text)


@pandas_udf(ArrayType(StringType()))
def full_query_tokens(text: pd.Series) -> pd.Series:
    """query_tokens() over a column, for indexes with full folding."""
    return text.map(lambda t: query_tokens(t) if t is not None else [])


def raw_query_tokens(text: Column) -> Column:
    """Split at ASCII white space, nothing folded."""
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def query_id(text: Column) -> Column:
    """What stands before the first of quote, blank, tab and colon; empty if none of these is there."""
    return F.regexp_extract(text, "^([^\" \\t:]*)[\" \\t:]", 1)


def query_text(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("[\" \\t:]")), F.regexp_extract(text, "(?s)^[^\" \\t:]*[\" \\t:]+(.*)$", 1)).otherwise(text)


def kmers(sequence: Column, k: int) -> Column:
    """Overlapping k-mers of DNA bases, lower-cased; white space is skipped, other characters break the run."""
    runs = F.filter(F.split(F.regexp_replace(F.lower(sequence), "\\s+", ""), "[^acgt]+"), lambda r: F.length(r) >= k)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - k + 1), lambda i: F.substring(r, i, F.lit(k)))))


# -- Porter's algorithm (M. F. Porter, An algorithm for suffix stripping, 1980) -----------------------------------

#: The published suffix tables, in their order.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as v and c; y is a vowel behind a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, _STEP4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


#: Stemmers by name: of one lower-case word.
STEMMERS: dict[str, Callable[[str], str]] = {"none": lambda w: w, "porter": porter}


def stemmed(word: str | Column, stemmer: str = "porter") -> Column:
    """Stems of a column of words; apply to distinct terms and join back. Words of other than ASCII letters stay."""
    stem = STEMMERS[stemmer]

    @pandas_udf(StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w) if w.isascii() and w.isalpha() else w)

    return run(word)


#: Character classes as patterns for rlike on one character.
CLASSES = {
    "alpha": "\\p{IsAlphabetic}", "digit": "\\p{N}", "alnum": "[\\p{IsAlphabetic}\\p{N}]", "upper": "\\p{IsUppercase}", "lower": "\\p{IsLowercase}", "cntrl": "\\p{Cc}",
    "punct": "\\p{P}", "space": "\\s", "uspace": "[\\p{Z}\\s]", "mark": "\\p{M}", "symbol": "\\p{S}", "xdigit": "[0-9A-Fa-f]", "graph": "[^\\p{Z}\\p{C}\\s]",
    "xml_name_start": "[:_\\p{IsAlphabetic}]", "xml_name": "[:_.\\-\\p{IsAlphabetic}\\p{N}\\p{M}]",
    "ascii_vowel": "[aeiouAEIOU]", "ascii_vowel_y": "[aeiouyAEIOUY]", "dna_base": "[acgtACGT]", "ascii_alpha": "[A-Za-z]", "ascii_digit": "[0-9]", "ascii_alnum": "[A-Za-z0-9]",
    "ascii_upper": "[A-Z]", "ascii_lower": "[a-z]", "ascii_space": "[ \\t-\\r]", "ascii_punct": "[!-/:-@\\[-`{-~]", "ascii_cntrl": "[\\x00-\\x1F\\x7F]", "ascii_graph": "[!-~]", "ascii_print": "[ -~]",
}


def is_class(character: Column, name: str) -> Column:
    return F.regexp_like(character, F.lit(f"^(?:{CLASSES[name]})$"))


# -- UTF-8 --------------------------------------------------------------------------------------------------------


def utf8_bytes(codepoint: Column) -> Column:
    """How many bytes a code point takes; 0 beyond U+10FFFF."""
    return F.when(codepoint < 0x80, 1).when(codepoint < 0x800, 2).when(codepoint < 0x10000, 3).when(codepoint <= 0x10FFFF, 4).otherwise(0)


def is_utf8(data: Column) -> Column:
    """Whether bytes are well-formed text."""
    return F.is_valid_utf8(data.cast("string"))


def to_codepoints(text: Column) -> Column:
    """The code points of a text, from its UTF-32 bytes."""
    raw = F.encode(text, "utf-32")
    at = F.sequence(F.lit(1), F.octet_length(raw), F.lit(4))
    return F.when(F.octet_length(raw) > 0, F.transform(at, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(4))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def from_codepoints(codepoints: Column) -> Column:
    """The text of an array of code points."""
    return F.decode(F.unhex(F.array_join(F.transform(codepoints, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "utf-32")
