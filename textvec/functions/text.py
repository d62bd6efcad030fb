"""Text normalisation and pre-tokenisation as Column expressions; only NFD and NFC need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that are tokens of their own (fixed values): ASCII symbols and category P; CJK ideographs.
PUNCT = r"!-/:-@\[-`{-~\p{P}"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
BASIC = rf"(?U)[{CJK}]|[{PUNCT}]|(?:(?![{CJK}{PUNCT}])\S)+"
#: Pre-token patterns (fixed values of the public tokenizers).
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QWEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def decomposed(t: Column) -> Column:
    """NFD; ASCII texts are in it already and don't go through Python."""
    return F.coalesce(nfd(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def composed(t: Column) -> Column:
    """NFC, likewise."""
    return F.coalesce(nfc(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def strip_accents(decomposed: Column) -> Column:
    """Without non-spacing marks; the text must be in NFD."""
    return F.regexp_replace(decomposed, r"\p{Mn}", "")


def clean_text(t: Column) -> Column:
    """Tab, line feed and return become spaces; other control, format, private and surrogate characters go."""
    return F.regexp_replace(F.regexp_replace(t, r"[\t\n\r]", " "), r"[\x{FFFD}\p{Cc}\p{Cf}\p{Co}\p{Cs}]", "")


def isolate_cjk(t: Column) -> Column:
    return F.regexp_replace(t, f"([{CJK}])", " $1 ")


def basic_tokens(t: Column, lower: bool = True) -> Column:
    """Array of words and single punctuation marks, as a BERT tokenizer splits."""
    if lower:
        t = strip_accents(decomposed(F.lower(t)))
    return F.regexp_extract_all(clean_text(t), F.lit(BASIC), F.lit(0))


def gpt2_pretokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?U)" + GPT2), F.lit(0))


def qwen_pretokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?U)" + QWEN), F.lit(0))


def byte_table() -> list[str]:
    """The printable character of each byte: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


def byte_encode(t: Column) -> Column:
    """Each UTF-8 byte as its printable character."""
    pairs = F.regexp_extract_all(F.hex(F.encode(t, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    table = F.create_map(*(x for b, c in enumerate(byte_table()) for x in (F.lit(f"{b:02X}"), F.lit(c))))
    return F.array_join(F.transform(pairs, lambda h: F.element_at(table, h)), "")


def metaspace(t: Column) -> Column:
    return F.replace(t, F.lit(" "), F.lit("▁"))


def sp_whitespace(t: Column) -> Column:
    """Trimmed, runs of spaces joined, a leading mark, and spaces as marks; empty stays empty."""
    one = F.regexp_replace(F.trim(t), " +", " ")
    return F.when(one == "", F.lit("")).otherwise(F.concat(F.lit("▁"), metaspace(one)))


def byte_fallback(t: Column, known: list[str]) -> Column:
    """Each character, or for those not known one <0xNN> for each UTF-8 byte."""
    chars = F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0))
    have = F.create_map(*(x for c in known for x in (F.lit(c), F.lit(True))))
    bytes_ = lambda c: F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda h: F.concat(F.lit("<0x"), h, F.lit(">")))
    return F.flatten(F.transform(chars, lambda c: F.when(F.coalesce(F.element_at(have, c), F.lit(False)), F.array(c)).otherwise(bytes_(c))))


def added_token_split(t: Column, tokens: list[tuple[str, bool, bool]]) -> Column:
    """Segments of the text and its added tokens (content, lstrip, rstrip), the longest first at each place.

    lstrip or rstrip absorbs the white space beside a token into it.
    """
    quoted = [(r"\s*" if left else "") + r"\Q" + c + r"\E" + (r"\s*" if right else "") for c, left, right in sorted(tokens, key=lambda x: -len(x[0]))]
    either = "|".join(quoted)
    return F.filter(F.regexp_extract_all(t, F.lit(f"(?Us)(?:{either})|(?:(?!{either}).)+"), F.lit(0)), lambda x: F.length(x) > 0)
