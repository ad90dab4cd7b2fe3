"""Tokens, snippets and content hashes, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """array<string>: the runs of a-z and 0-9 of the lower-cased text, in order, with repeats; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenize(text: str | None) -> list[str]:
    """tokens() of a query string."""
    return re.findall(TOKEN, (text or "").lower())


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower hex."""
    return F.sha2(_col(text), 256)


def changed(new_hash: Column | str, old_hash: Column | str) -> Column:
    """Whether content is new; a missing old hash is a change."""
    return ~_col(new_hash).eqNullSafe(_col(old_hash))


BEFORE, AFTER, NO_HIT = 8, 12, 20


def bound(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda, Spark computes an expression again for each element."""
    return F.transform(F.array(value), body)[0]


def snippet(text: Column | str, terms: list[str]) -> Column:
    """The words around the first one that, stripped to a-z and 0-9, is a term; the first words where there is none."""
    text = F.coalesce(_col(text), F.lit(""))
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

    def around(words: Column, hit: Column) -> Column:
        first = F.greatest(hit - BEFORE, F.lit(1))
        near = F.slice(words, first, F.least(F.size(words), hit + AFTER - 1) - first + 1)
        return F.when(hit > 0, F.concat(F.lit("..."), F.array_join(near, " "), F.lit("..."))).otherwise(F.array_join(F.slice(words, 1, NO_HIT), " "))

    def found(words: Column) -> Column:
        # lower-cased and stripped as one string; a word that is stripped to nothing keeps its place
        stripped = F.split(F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z0-9 ]", ""), " ", -1)
        hits = F.transform(stripped, lambda w: F.array_contains(wanted, w))
        return bound(F.array_position(hits, True).cast("int"), lambda hit: around(words, hit))  # from 1; 0: none

    def trimmed(parts: Column) -> Column:
        # a match at the end leaves one empty string; text that is blank leaves nothing else
        words = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.when(F.exists(words, lambda w: w != ""), words).otherwise(F.array().cast("array<string>"))

    return bound(bound(F.split(text, r"\s+", -1), trimmed), found)
