"""Normalisation and tokens as Spark columns.

Two modes share the tables: blocking (candidate generation) and matching (pair features). Only texts with characters beyond ASCII
go through Python (transliteration and compatibility decomposition, for which Spark SQL has nothing); the rest stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T

SPACE = r"[ \t\n\r\u000B\u000C\u0085   -     　]+"
DELETED = r"[.'’​-‍⁠﻿]"
#: The punctuation that the matching mode turns into spaces
MATCHER_SPACES = r"""[!"#$%&()*+,\-/:;<=>?@\[\\\]^_`{|}~\t\r]"""


def romanise(s: str, table: dict[int, tuple[str, int]] = T.INDIC_BLOCKING) -> str:
    """Indic letters in Latin ones. A consonant has its vowel a where another Indic letter that is no sign follows."""
    kinds = [table.get(ord(c) & 0x7F, ("", T.OTHER)) if 0x0900 <= ord(c) <= 0x0D7F else None for c in s]
    out = []
    for c, this, after in zip(s, kinds, [*kinds[1:], None], strict=True):
        out.append(this[0] if this else c)
        if this and this[1] in (T.CONSONANT, T.NUKTA) and after and after[1] not in (T.SIGN, T.VIRAMA, T.NUKTA):
            out.append("a")
    return "".join(out)


def fold(s: str, matcher: bool) -> str:
    """Romanised, decomposed, without marks (by category in blocking, by combining class in matching)."""
    s = romanise(s, T.INDIC if matcher else T.INDIC_BLOCKING)
    s = unicodedata.normalize("NFKD", s.lower() if matcher else s)
    return "".join(c for c in s if not (unicodedata.combining(c) if matcher else unicodedata.category(c)[0] == "M"))


@cache
def _fold_udf(matcher: bool):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fold(x, matcher), na_action="ignore")

    return F.pandas_udf(run, StringType())


def folded(s: Column, matcher: bool = False) -> Column:
    return F.coalesce(_fold_udf(matcher)(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)


def normalize(s: Column, matcher: bool = False) -> Column:
    """Lower case, romanised, no marks; full stops and apostrophes go, other punctuation becomes a space. Null is empty."""
    s = F.lower(folded(F.coalesce(s, F.lit("")), matcher))
    if matcher:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, DELETED, ""), MATCHER_SPACES, " "), SPACE, " "))
    return F.regexp_replace(F.regexp_replace(s, DELETED.replace("'", "'`"), ""), r"[^\p{IsAlphabetic}\p{N}]", " ")


def words(s: Column) -> Column:
    return F.filter(F.split(s, SPACE), lambda w: w != "")


def strip_web(w: Column, matcher: bool = False) -> Column:
    """Without a leading www. and one trailing top-level domain, if something is left."""
    tlds = "|".join(t.replace(".", r"\.") for t in [*T.TLDS, *([".www"] if matcher else [])])
    return F.regexp_replace(F.regexp_replace(w, r"^www\.", ""), rf"^(.+?)({tlds})$", "$1")


def _mapped(w: Column, table: dict[str, str]) -> Column:
    pairs = ",".join(f"{k}:{v}" for k, v in table.items())  # one literal, folded into a map when the plan is made
    return F.coalesce(F.element_at(F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":")), w), w)


def canon_number(w: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(w, "^0+$", "0"), "^0+(?=[1-9])", "")


def name_words(name: Column, matcher: bool = False) -> Column:
    bare = F.array_join(F.transform(words(F.lower(F.coalesce(name, F.lit("")))), lambda w: strip_web(w, matcher)), " ")
    return F.transform(words(normalize(bare, matcher)), lambda w: _mapped(w, T.NAME_WORDS))


def core_words(name_words: Column, matcher: bool = False) -> Column:
    stop = F.array(*map(F.lit, T.MATCHER_STOP_WORDS if matcher else T.STOP_WORDS))
    return F.filter(name_words, lambda w: ~F.array_contains(stop, w))


def addr_words(addr: Column, matcher: bool = False) -> Column:
    s = F.array_join(words(normalize(addr, matcher)), " ")
    any_pair = r"(?<![^ ])(" + "|".join(T.STATE_PAIRS) + r")(?![^ ])"
    paired = s
    for pair, code in T.STATE_PAIRS.items():
        paired = F.regexp_replace(paired, rf"(?<![^ ]){pair}(?![^ ])", code)
    s = F.when(s.rlike(any_pair), paired).otherwise(s)
    if matcher:
        one = lambda w: _mapped(canon_number(_mapped(w, T.MATCHER_ADDRESS_WORDS)), T.MATCHER_STATES)
    else:
        one = lambda w: canon_number(_mapped(w, T.ADDRESS_WORDS | T.STATES))
    return F.filter(F.transform(words(s), one), lambda w: w != "")


def skeleton(w: Column) -> Column:
    """A key of consonants; null for words of fewer than three letters, others than a-z, or keys of fewer than two."""
    s = F.replace(w, F.lit("tion"), F.lit("shn"))
    k = F.translate(F.regexp_replace(s, "[aeiouyh]", ""), "cqgzvwf", "kkjjbbp")
    k = F.replace(F.regexp_replace(F.replace(k, F.lit("x"), F.lit("Ks")), r"(.)\1+", "$1"), F.lit("K"), F.lit("k"))
    k = F.when(s.rlike("^[aeiou]"), F.concat(F.lit("a"), k)).otherwise(k)
    return F.when(s.rlike("^[a-z]{3,}$") & (F.length(k) >= 2), k)


def trigrams(w: Column) -> Column:
    p = F.concat(F.lit("#"), w, F.lit("#"))
    return F.when(w.rlike("^[A-Za-z0-9]{4,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def country_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


#: Channels of blocking tokens: number of the score group of each
NAME, NAME_JOIN, NAME_SKEL, ADDR, ADDR_SKEL, TRIG = range(6)
GROUP_OF = (0, 1, 2, 3, 3, 2)


def record_tokens(nw: Column, aw: Column, core: Column) -> Column:
    """array<struct<ch, tag, tok>>: the distinct blocking tokens of a record, given as columns its name words, address words and core words."""
    make = lambda ch, tag, xs: F.transform(xs, lambda t: F.struct(F.lit(ch).alias("ch"), F.lit(tag).alias("tag"), t.alias("tok")))
    known = lambda xs: F.filter(F.transform(xs, skeleton), lambda t: t.isNotNull())
    long = F.filter(nw, lambda w: w.rlike(r"^[\x00-\x7F]{6,}$"))
    joined = F.when(F.size(core) > 0, F.array(F.array_join(core, ""), F.array_join(F.array_sort(core), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            make(NAME, "w", nw), make(NAME_JOIN, "j", joined), make(NAME_SKEL, "s", known(nw)), make(NAME_SKEL, "p", F.transform(long, lambda w: F.substring(w, 1, 4))), make(NAME_SKEL, "x", F.transform(long, lambda w: F.right(w, F.lit(4)))),
            make(ADDR, "a", aw), make(ADDR_SKEL, "k", known(F.filter(aw, lambda w: F.octet_length(w) >= 4))), make(TRIG, "t", F.flatten(F.transform(core, trigrams))),
        )
    )
