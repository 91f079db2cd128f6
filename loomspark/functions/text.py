"""Text expressions. All are Catalyst columns except `split_prompt`."""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_han(c: Column) -> Column:
    """Any character of the CJK unified ideographs block."""
    return c.rlike("[\\u4e00-\\u9fff]")


def has_han_narrow(c: Column) -> Column:
    """Any of the ideographs up to U+9FA5."""
    return c.rlike("[\\u4e00-\\u9fa5]")


def has_latin(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def has_special(c: Column) -> Column:
    """Anything besides word characters, white space and common punctuation of both languages."""
    return c.rlike(r"[^\p{L}\p{N}_\s,.'\"!?;:()\-，。！？；：、（）“”‘’]")


def script_language(c: Column) -> Column:
    """`en` where the first character is an ASCII letter or no ideograph occurs, else `ch`; null for empty text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(None)).when(c.rlike("^[a-zA-Z]") | ~has_han(c), "en").otherwise("ch")


def quoted(c: Column, nth_last: int = 1) -> Column:
    """The last (1) or second last (2) substring between straight or curly double quotes."""
    found = F.regexp_extract_all(c, F.lit("[\"“”]([^\"“”]*)[\"“”]"), F.lit(1))
    return F.try_element_at(found, F.lit(-nth_last))


def normalised(c: Column) -> Column:
    """ASCII letters and digits, lower-cased, without anything else."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def unfenced(c: Column) -> Column:
    """Line ends and code fences removed."""
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("")), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def parts(c: Column, separator: str = "&&") -> Column:
    """Trimmed parts between the separators."""
    return F.transform(F.split(c, separator), lambda x: F.trim(x))


def sentences(c: Column) -> Column:
    """Stretches from a capital letter to the next full stop before white space, or the end of the line."""
    # fixed value: the pattern
    return F.regexp_extract_all(c, F.lit(r"[A-Z][A-Z\-0-9]*.*?(?=\.\s|$)"), F.lit(0))


def spaced(c: Column, n: int = 1) -> Column:
    """n spaces between the characters."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), " " * n)


def caption(c: Column) -> Column:
    """Lower-cased, trimmed, with a full stop at the end."""
    low = F.trim(F.lower(c))
    return F.when(F.endswith(low, F.lit(".")), low).otherwise(F.concat(low, F.lit(".")))


def canonical(c: Column, keep: str | None = None) -> Column:
    """ASCII punctuation removed (but `keep` where it stands whole), white space runs to one space, trimmed."""
    bare = lambda x: F.translate(x, string.punctuation, "")
    whole = F.array_join(F.transform(F.split(c, _literal(keep)), bare), keep) if keep else bare(c)
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def between(c: Column, start: str, end: str) -> Column:
    """What stands after the first `start`, up to the first `end` of the text before which it lies; null without `start`."""
    head = F.split(c, _literal(end), 2)[0]
    return F.try_element_at(F.split(head, _literal(start)), F.lit(2))


def quote_words(words: Column) -> Column:
    """Words in single quotes, joined by commas."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")


def fill_template(template: Column, **values: Column) -> Column:
    """Every <name> of the template replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"<{name}>"), value)
    return template


def messages(system: Column, user: Column) -> Column:
    """Chat messages as an array of (role, content)."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


#: Quotes open and close only past this many characters of the prompt.
QUOTES_FROM = 155


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_prompt(texts: pd.Series) -> pd.Series:
    """Prompt pieces: text outside quotes stays whole, each character inside late quotes stands alone in curly quotes."""

    def pieces(text):
        if text is None:
            return None
        text = text.replace("“", '"').replace("”", '"')
        late = [i for i, c in enumerate(text) if c == '"' and i > QUOTES_FROM]
        out, begin = [], 0
        for n, at in enumerate(late):
            if n % 2 == 0:
                out.append(text[begin : at + 1])
                begin = at + 1
            else:
                out += [f"“{c}”" for c in text[begin:at]]
                begin = at
        if len(late) % 2:
            out += [f"“{c}”" for c in text[begin:]]
        elif text[begin:]:
            out.append(text[begin:])
        return out

    return texts.map(pieces)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the keyed hash (RFC 2104) of a text, by built-in functions."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def signed_request(key: bytes, params: Column) -> Column:
    """struct(query, signature) of a map of parameters: `name=value` joined by & in the order of names, and their keyed hash."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda x: F.concat(x["key"], F.lit("="), F.url_encode(x["value"])))
    query = F.array_join(pairs, "&")
    return F.struct(query.alias("query"), hmac_sha256(key, query).alias("signature"))


def data_url(payload: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(payload), F.lit("\r\n"), F.lit("")))  # Spark breaks long lines


def style_name(stem: Column) -> Column:
    """Style that a weight file's stem names."""
    return F.replace(F.split(stem, "_rank")[0], F.lit("_"), F.lit(" "))
