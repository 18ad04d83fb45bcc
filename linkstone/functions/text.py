"""Normalisation of names and addresses as column expressions; all stay inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as X


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def fold(c: Column) -> Column:
    """Latin letters without marks; ligatures spelt out."""
    c = F.translate(c, *X.ACCENTS)
    for a, b in X.LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def transliterate(c: Column) -> Column:
    """fold(), and Indic scripts spelt in Latin letters. Text without Indic letters skips the letter map."""
    c = fold(_text(c))
    letters = F.create_map(*[F.lit(x) for x in chain.from_iterable(X.indic_letters().items())])
    one_block = F.translate(c, *X.indic_to_first_block())
    spelt = F.array_join(F.transform(F.split(one_block, ""), lambda x: F.coalesce(letters[x], x)), "")
    return F.when(c.rlike("[\\u0900-\\u0D7F]"), spelt).otherwise(c)


def replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def domain_stem(c: Column, compat: bool = True, folded: bool = False) -> Column:
    """First host label before a known ending, lower case; '' without one. compat: endings may stop inside a word."""
    return F.lower(F.regexp_extract(c if folded else transliterate(c), X.DOMAIN_COMPAT if compat else X.DOMAIN_STRICT, 3))


def name_tokens(c: Column | str, profile: str = "P", compat: bool = True, folded: bool = False) -> Column:
    """Ordered tokens of a name, repetitions included. folded: c is transliterated already."""
    if profile == "P":
        t = _text(c) if folded else transliterate(_text(c))
        pattern = X.DOMAIN_COMPAT if compat else X.DOMAIN_STRICT
        stem = F.lower(F.regexp_extract(t, pattern, 3))
        t = F.regexp_replace(t, F.lit(pattern), F.concat(F.lit(" "), stem, F.lit(" ")))
        t = replaced(F.lower(t), X.PHONETIC + X.CORPORATE)
        return F.filter(F.regexp_extract_all(t, F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    t = _text(c)
    if profile in ("C", "IDF"):
        t = fold(t)
    if profile != "L":
        t = F.regexp_replace(t, X.DOMAIN_STRIP, " ")
    drop = _words(X.LEGAL[profile] + (X.STOPWORDS if profile == "L" else []))
    return F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~F.array_contains(drop, w))


def core_tokens(tokens: Column, profile: str = "P") -> Column:
    drop = X.GENERIC[profile] + (X.LEGAL["P"] if profile == "P" else [])
    return F.array_except(tokens, _words(drop)) if drop else F.array_distinct(tokens)


def compressed(tokens: Column, folded: Column | None = None, compat: bool = True) -> Column:
    """Tokens without spaces; without tokens, the domain stem of the transliterated name."""
    joined = F.array_join(tokens, "")
    return joined if folded is None else F.when(joined == "", domain_stem(folded, compat, folded=True)).otherwise(joined)


def clean_addr(c: Column | str, profile: str = "P", folded: bool = False) -> Column:
    t = _text(c)
    if profile == "P":
        t = t if folded else transliterate(t)
    elif profile == "C":
        t = fold(t)
    t = F.lower(t)
    if profile in ("P", "C"):
        t = F.regexp_replace(t, X.CEDEX, " ")
    rules = X.ADDRESS[profile]
    if profile == "P":  # text is ASCII where it matters: whole tokens and the rules' word borders agree
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.items())])
        tokens = F.transform(F.regexp_extract_all(t, F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0)), lambda w: F.coalesce(table[w], w))
        t = F.array_join(tokens, "")
    else:
        t = replaced(t, [(rf"\b{k}\b", v) for k, v in rules.items()])
    return F.array_join(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def _anchor_text(c: Column | str, profile: str, folded: bool = False) -> Column:
    t = _text(c) if folded else transliterate(_text(c)) if profile == "P" else fold(_text(c))
    return F.regexp_replace(t, X.CEDEX, " ") if profile in ("P", "C") else t


def door(c: Column | str, profile: str = "P", folded: bool = False) -> Column:
    t = _anchor_text(c, profile, folded)
    prefix, number, suffix = (F.regexp_extract(t, X.DOOR, k) for k in (1, 2, 3))
    tail = F.concat(number, F.lower(suffix))
    return F.when(prefix != "", F.concat(F.lower(prefix), F.lit("-"), tail)).otherwise(tail)


def pin(c: Column | str, profile: str = "P", folded: bool = False) -> Column:
    return F.regexp_extract(_anchor_text(c, profile, folded), X.PIN, 1)


def phone(c: Column | str, profile: str = "P", folded: bool = False) -> Column:
    return F.regexp_extract(_anchor_text(c, profile, folded), X.PHONE, 0)


def anchor_sets(c: Column | str) -> tuple[Column, Column, Column]:
    """(anchors, pins, phones) of the older trainer: all doors of two characters or more, and all pins."""
    t = fold(_text(c))
    group = lambda k: F.regexp_extract_all(t, F.lit(X.DOOR), F.lit(k))
    tails = F.zip_with(group(2), group(3), lambda n, s: F.concat(n, F.lower(s)))
    doors = F.zip_with(group(1), tails, lambda p, s: F.when(p != "", F.concat(F.lower(p), F.lit("-"), s)).otherwise(s))
    pins = F.array_distinct(F.regexp_extract_all(t, F.lit(X.PIN), F.lit(1)))
    phones = F.array_distinct(F.regexp_extract_all(t, F.lit(X.PHONE), F.lit(0)))
    return F.array_union(F.filter(doors, lambda d: F.length(d) >= 2), pins), pins, phones


def digit_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(X.DIGITS), F.lit(0)))


def addr_keys(door_: Column, addr: Column) -> Column:
    """door_token for the first three tokens that aren't numbers, without street words; order and repetitions stay."""
    words = F.filter(F.split(addr, " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    kept = F.filter(F.slice(words, 1, 3), lambda w: ~F.array_contains(_words(X.KEY_STOPWORDS), w))
    return F.when(door_ == "", F.array().cast("array<string>")).otherwise(F.transform(kept, lambda w: F.concat(door_, F.lit("_"), w)))


def profiled(records, profile: str = "P", compat: bool = True):
    """Entity records with the columns that blocking and features read."""
    spell = transliterate if profile == "P" else lambda c: fold(_text(c)) if profile == "C" else _text(c)
    out = records.withColumn("_name", spell(F.col("business_name"))).withColumn("_addr", spell(F.col("business_address")))
    anchor = out["_addr"] if profile == "P" else fold(_text("business_address"))
    out = out.withColumn("_anchor", anchor).withColumn("tokens", name_tokens("_name", profile, compat, folded=True))
    out = out.withColumn("clean_name", F.array_join("tokens", " "))
    out = out.withColumn("compressed", compressed(F.col("tokens"), F.col("_name") if profile == "P" else None, compat))
    out = out.withColumn("core", core_tokens(F.col("tokens"), profile)).withColumn("clean_addr", clean_addr("_addr", profile, folded=True))
    for name, f in (("door", door), ("pin", pin), ("phone", phone)):
        out = out.withColumn(name, f("_anchor", profile, folded=True))
    if profile == "L":
        out = out.withColumn("digits", digit_tokens("business_address"))
    return out.withColumn("addr_keys", addr_keys(F.col("door"), F.col("clean_addr"))).drop("_name", "_addr", "_anchor")
