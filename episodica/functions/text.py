"""Strings, keys and hashes as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are Python objects at once in ``normalised``.
FOLD_ROWS = 64


def slug(text: Column, size: int = 48) -> Column:
    """Lower case, runs of other signs as one underscore, none at the ends, cut to ``size``."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(size))


def normalised(text: Column) -> Column:
    """Words of the compatibility form (NFKC), case folded, joined by one space.

    No built-in function has this form or folds case, so this runs in Python, Arrow batches at a time.
    """

    @F.arrow_udf("string")
    def fold(values):
        import pyarrow as pa

        words = re.compile(r"\w+").findall
        form = lambda v: None if v is None else " ".join(words(unicodedata.normalize("NFKC", v).casefold()))
        # a slice at a time, so that few texts are Python objects at once
        slices = (values.slice(i, FOLD_ROWS) for i in range(0, len(values), FOLD_ROWS))
        return pa.concat_arrays([pa.array([form(v.as_py()) for v in part], pa.string()) for part in slices] or [pa.array([], pa.string())])

    return fold(text)


def between_markers(text: Column, begin: str, end: str) -> Column:
    """What stands between the first ``begin`` and the first ``end`` behind it, trimmed; null if either lacks or nothing is there."""
    at = F.locate(begin, text)
    rest = F.substring(text, at + len(begin), F.length(text))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 0), F.nullif(F.trim(F.substring(rest, F.lit(1), stop - 1)), F.lit("")))


def seed_of(text: Column) -> Column:
    """The first 8 hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def seed_block(text: Column, blocks: int = 1_000_000, size: int = 50) -> Column:
    """The start of a block of ``size`` seeds by the first 8 bytes of the SHA-256; an unsigned 64-bit number needs a decimal."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.pmod(number, F.lit(blocks).cast("decimal(20,0)")) * size + blocks).cast("long")


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with keys in order and nulls left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def is_hex64(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def has_offset(stamp: Column) -> Column:
    """Whether an ISO time carries an offset (Z counts) and can be read."""
    return stamp.rlike(r"(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(stamp).isNotNull()


#: Words that only lead into an action and are left out of its clause.
LEADING = ("please", "now", "next", "then", "first", "finally")
#: Verbs that are told apart from nouns behind "and", "then" or a comma.
KNOWN_VERBS = ("pick", "push", "carry", "wash", "turn", "lay", "place", "go", "open", "close", "move")


def without_words(words: Column, dropped: tuple[str, ...]) -> Column:
    """An array of words without those of a list."""
    return F.filter(words, lambda w: ~w.isin(*dropped))


def action_clause(text: Column, third: Callable[[Column], Column]) -> Column:
    """An instruction as a clause in the third person: no leading words, no full stop, verbs bent by ``third``."""
    clause = F.regexp_replace(F.rtrim(F.trim(text), F.lit(".")), r"\s+", " ")
    clause = F.regexp_replace(clause, rf"(?i)^((?:{'|'.join(LEADING)})[ ,]+)+", "")
    words = F.split(clause, " ")

    def bent(word: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1)).otherwise("")
        follows = (F.lower(before).isin("and", "then") | before.endswith(",")) & F.lower(word).isin(*KNOWN_VERBS)
        return F.when((i == 0) | follows, third(F.lower(word))).otherwise(word)

    return F.array_join(F.transform(words, bent), " ")


def ordered_actions(clauses: Column) -> Column:
    """One clause alone, or all of them as first ..., then ..."""
    rest = F.concat(F.lit("first "), F.array_join(clauses, ", then "), F.lit("; in exactly this order"))
    return F.when(F.size(clauses) == 1, clauses[0]).otherwise(rest)


def cut_at_word(text: Column, size: int) -> Column:
    """At most ``size`` characters, without a broken last word."""
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(F.left(text, F.lit(size)), r"\s+\S*\z", ""))


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def counted(n: Column, noun: str) -> Column:
    """A number and its noun, in the plural but for one."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def without_colour_codes(text: Column) -> Column:
    """Terminal escape sequences removed."""
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")


def without_fence(text: Column) -> Column:
    """The inside of a fenced block; other text as it is."""
    return F.regexp_replace(text, r"^\s*```[a-z]*\s*|\s*```\s*$", "")
