"""Quality rules, line first: lines that fail are removed, then documents that lost too much are rejected.

Rules of a line, in this order, the first that holds gives the reason: boilerplate (a phrase of ``BOILERPLATE``),
navigation (a share of its words are bars or arrows, or all of its few words are ``MENU_WORDS``), punctuation (none of its
words closes a sentence, or it is mostly marks). Lines without a word neither stay nor count. A document is kept if it
passes the base rules (length and repeated words) and lines of no more than ``LOSS`` per cent of its characters fail.

Defined cases: null text has no words and fails the base rules, as do empty and very short ones; texts are read whole,
whatever their length; repeated rows are judged each; an empty table gives an empty result; columns of other names, or
those of the result, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

LEAST_WORDS = 10
REPEATS = 20
LOSS = 50
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Marks that close a sentence, with or without one of the marks that may follow.
CLOSING = [mark + after for mark in ".!?…。！？" for after in ("", '"', "'", ")", "]", "”", "’", "»")]
BARS = ("|", ">", "<", "»", "«", "›", "•", "·", "→", "/")
MARKS = "!#$%&*+/<=>@\\^_`{|}~"
MENU_WORDS = (
    "home menu login logout register search contact about help news next previous prev back top more faq sitemap share "
    "start suche kontakt impressum anmelden hilfe weiter zurück "
    "accueil connexion recherche aide suivant précédent retour "
    "inicio buscar contacto ayuda siguiente anterior volver"
).split()
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie", "javascript",
    "lorem ipsum", "copyright", "licensed under", "click here", "read more", "sign in", "sign up", "subscribe", "newsletter",
    "alle rechte vorbehalten", "datenschutz", "tous droits réservés", "mentions légales", "todos los derechos reservados",
    "política de privacidad",
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_CLOSING, _BARS, _MENU = tuple(c.encode() for c in CLOSING), frozenset(b.encode() for b in BARS), frozenset(w.encode() for w in MENU_WORDS)
_PHRASES = [p.encode() for p in BOILERPLATE]
_BEYOND = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_BLANKS = b"\t\n\x0b\x0c\r "


def _chars(raw: bytes) -> int:
    """Code points that are no white space."""
    return len(raw.translate(None, _BEYOND + _BLANKS))


def reason(line: bytes, chars: int, phrases: list[bytes]) -> str | None:
    """The rule that a line of ``chars`` characters breaks; ``phrases`` are those that occur in its text at all."""
    words = line.split()
    if phrases:
        low = line.translate(_LOWER)
        if any(p in low for p in phrases):
            return "boilerplate"
    bars = sum(w in _BARS for w in words)
    if bars >= 2 and 5 * bars >= len(words):
        return "navigation"
    if len(words) <= 6 and all(w.translate(_LOWER) in _MENU for w in words):
        return "navigation"
    if not any(w.endswith(_CLOSING) for w in reversed(words)):
        return "punctuation"
    marks = len(line) - len(line.translate(None, MARKS.encode()))
    return "punctuation" if marks >= 3 and 5 * marks > chars else None


def _repeated(texts: list[list[bytes]]) -> np.ndarray:
    """For each text its words in windows of ``WINDOW`` words that occur twice or more in it, the first included."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    n = len(word) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(texts), np.int64)
    key = text
    for j in range(WINDOW):  # exact: number the windows by one word more at a time
        _, key = np.unique(key[:n] * len(numbers) + word[j : j + n], return_inverse=True)
    inside = text[:n] == text[WINDOW - 1 :]
    times = np.bincount(key[inside], minlength=int(key.max()) + 1)
    again = np.flatnonzero(inside & (times[key] > 1))
    marked = np.zeros(len(word), bool)
    for j in range(WINDOW):
        marked[again + j] = True
    return np.bincount(text[marked], minlength=len(texts))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features and verdict of every row, with clean_text (its lines that pass) and lost_chars, by rule too."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rules = ("boilerplate", "navigation", "punctuation")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*counts, "base_failed", "kept", "lost_chars", *[f"lost_{r}" for r in rules], "clean_text"]
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                out: dict[str, list] = {n: [] for n in names}
                raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
                split = [raw.split() for raw in raws]
                for raw, words, repeated in zip(raws, split, _repeated(split).tolist(), strict=True):
                    low = raw.translate(_LOWER)
                    phrases = [p for p in _PHRASES if p in low]
                    seen, kept, lost, dup = set(), [], dict.fromkeys(rules, 0), 0
                    for line in raw.split(b"\n"):
                        if not (chars := _chars(line)):
                            continue
                        dup += line in seen
                        seen.add(line)
                        if why := reason(line, chars, phrases):
                            lost[why] += chars
                        else:
                            kept.append(line)
                    total, gone = _chars(raw), sum(lost.values())
                    failed = len(words) < LEAST_WORDS or 100 * repeated > REPEATS * len(words)
                    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
                    given = (len(words), total, symbols, dup, repeated, failed, not failed and 100 * gone <= LOSS * total, gone, *lost.values(), b"\n".join(kept))
                    for name, value in zip(names, given, strict=True):
                        out[name].append(value)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()]], ["doc_id", *names])

    longs = [*counts, "base_failed boolean", "kept boolean", "lost_chars", *[f"lost_{r}" for r in rules]]
    schema = ", ".join([f"doc_id {slim.schema['doc_id'].dataType.simpleString()}", *[c if " " in c else f"{c} long" for c in longs], "clean_text string"])
    return slim.mapInArrow(judge, schema)


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(common.read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS times
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM windows, range({WINDOW}) x(j) WHERE times > 1 GROUP BY r),
lines AS (
  SELECT r, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d)),
judged AS (
  SELECT r, line, length(array_to_string(w, '')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY n) > 1 AS again,
    list_bool_or(list_transform({_sql_list(BOILERPLATE)}, lambda p: contains(low, p)))
    OR (len(list_filter(w, lambda x: list_contains({_sql_list(BARS)}, x))) >= 2 AND 5 * len(list_filter(w, lambda x: list_contains({_sql_list(BARS)}, x))) >= len(w))
    OR (len(w) <= 6 AND list_bool_and(list_transform(w, lambda x: list_contains({_sql_list(MENU_WORDS)}, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))))
    OR NOT list_bool_or(list_transform(w, lambda x: list_contains({_sql_list(CLOSING)}, right(x, 1)) OR list_contains({_sql_list(CLOSING)}, right(x, 2))))
    OR (length(line) - length(translate(line, '{MARKS}', '')) >= 3
        AND 5 * (length(line) - length(translate(line, '{MARKS}', ''))) > length(array_to_string(w, ''))) AS fails
  FROM lines WHERE len(w) > 0),
sums AS (SELECT r, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars FROM judged GROUP BY r),
base AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN sums USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATS} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATS} * n_words) AND 100 * lost_chars <= {LOSS} * word_chars AS kept, lost_chars
FROM base"""
