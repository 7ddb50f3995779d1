"""Dictionaries given as tables: thousands of rules or replacements.

Rules (``first_rule``). Every rule phrase is filed under one key, the pair of adjacent words
in it (or its only word) that the fewest rules share, so a frequent first word doesn't gather
its rules. Each text asks for its distinct words and adjacent pairs: an equi-join, whose
candidates per row are then verified by the phrase's own pattern, in rule order up to the first hit. Texts
don't pass the join on keys; rows meet their candidates by row id.

Replacements (``fold_phrases``). One pass of a phrase automaton (a trie with failure links) finds the
entries a text holds. They are applied in order, as the chain of regular expressions
does, but only those found; around each replacement the automaton looks for phrases
that it made. Characters that are neither part of a word nor of any phrase cut a text into stretches
which no match leaves, so each stretch is replaced by itself, and a worker remembers the results
of frequent ones. The dictionary reaches the workers as a broadcast of at most
``DICTIONARY_ROWS`` entries; a larger one is applied slice by slice, with a checkpoint in between.

Matching is that of ``functions.regex``: whole words, any letter case.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonscope.functions.regex import WORD_CLASS
from reasonscope.session import bounded_broadcast, materialize, ship_package

DICTIONARY_ROWS = 1 << 18
_JOIN = "\x01"
_FOLDERS: dict[int, "Folder"] = {}


# ------------------------------------------------------------------ rules
def _words(text: Column) -> Column:
    """The words of a text, equal for texts that are equal in any letter case."""
    upper = F.upper(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("ẞ"), F.lit("ß")))
    plain = F.lower(F.concat(upper, F.lit(_JOIN)))   # Spark takes lower(upper(x)) for lower(x)
    return F.regexp_extract_all(plain, F.lit(WORD_CLASS + "+"), 0)


def _pairs(words: Column) -> Column:
    pair = lambda i: F.concat_ws(_JOIN, F.get(words, i), F.get(words, i + 1))
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)).otherwise(F.array().cast("array<string>"))


def _pattern(phrase: Column) -> Column:
    """``phrase_pattern`` of a column of phrases."""
    literal = F.regexp_replace(phrase, r"([\x00-\x7F&&[^A-Za-z0-9_]])", r"\\$1")
    back = F.concat(F.lit(WORD_CLASS + ".{"), F.length(phrase).cast("string"), F.lit("}"))
    left = F.when(phrase.rlike("^" + WORD_CLASS), F.concat(F.lit("(?<!"), back, F.lit(")"))).otherwise(F.concat(F.lit("(?<="), back, F.lit(")")))
    right = F.when(phrase.rlike("(?s)" + WORD_CLASS + r"\z"), F.lit(f"(?!{WORD_CLASS})")).otherwise(F.lit(f"(?={WORD_CLASS})"))
    return F.concat(F.lit("(?ius)"), literal, left, right)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """(key, rule_no, name, pattern) of a table (rule_no, name, phrase): each rule once,
    empty phrases left out; a phrase without a word is filed under the empty key, which every text asks for."""
    words = rules.where(F.length("phrase") > 0).select("rule_no", "name", "phrase", _words(F.col("phrase")).alias("_w"))
    keys = F.when(F.size("_w") > 1, _pairs(F.col("_w"))).when(F.size("_w") == 1, F.col("_w")).otherwise(F.array(F.lit("")))
    each = words.select("rule_no", "name", "phrase", F.explode_outer(F.array_distinct(keys)).alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by("key", F.struct("_n", "key")).alias("key")
    return (each.join(shared, "key").groupBy("rule_no", "name", "phrase").agg(best)
            .select("key", "rule_no", "name", _pattern(F.col("phrase")).alias("pattern")))


def rule_candidates(texts: DataFrame, rules: DataFrame, text_col: str, max_rules: int | None = None) -> DataFrame:
    """(row_id, _rules): the rules whose key a text has, in rule order. ``max_rules``: a
    proven bound of the rule rows, which allows a broadcast."""
    filed = keyed_rules(rules)
    if max_rules is not None:
        filed = bounded_broadcast(filed, max_rules)
    words = texts.select("row_id", _words(F.col(text_col)).alias("_w"))
    asked = words.select("row_id", F.explode_outer(F.array_distinct(F.concat("_w", _pairs(F.col("_w")), F.array(F.lit(""))))).alias("key"))
    return asked.join(filed, "key").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rule_no", "name", "pattern"))).alias("_rules"))


def first_rule(texts: DataFrame, rules: DataFrame, text_col: str = "ReasonText", out_col: str = "Category",
               max_rules: int | None = None) -> DataFrame:
    """``texts`` (with a unique row_id) and the name of the first rule of the table (rule_no,
    name, phrase) whose phrase the text has as whole words in any letter case, else null."""
    found = rule_candidates(texts, rules, text_col, max_rules)
    first = F.aggregate("_rules", F.lit(None).cast("string"), lambda name, rule: F.when(name.isNotNull(), name).when(
        F.regexp_like(F.col(text_col), rule["pattern"]), rule["name"]))
    return texts.join(found, "row_id", "left").withColumn(out_col, first).drop("_rules")


# ------------------------------------------------------------------ replacements
class _Fold(dict):
    """Character map to the common form of its letter cases, one character each."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        upper = char.upper() if len(char.upper()) == 1 else char
        lower = upper.lower() if len(upper.lower()) == 1 else ("i" if upper == "İ" else upper)
        self[code] = ord(lower)
        return self[code]


_FOLD = _Fold()


def _word(char: str) -> bool:
    return char.isalnum() or char == "_"


@cache
def _others() -> dict[str, list[str]]:
    """Characters outside words that have letter cases, by their common form."""
    out = defaultdict(list)
    for char in map(chr, range(sys.maxunicode + 1)):
        if not char.isalnum() and (char.upper() != char or char.lower() != char):
            out[char.translate(_FOLD)].append(char)
    return out


#: results a worker remembers, and the longest text of one
REMEMBERED = 1 << 17
REMEMBERED_CHARS = 64


class Folder:
    """Ordered whole-word replacements of one dictionary."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = [(p.translate(_FOLD), r, _word(p[0]), _word(p[-1])) for p, r in entries if p]
        numbers = defaultdict(list)
        for i, (phrase, *_) in enumerate(self.entries):
            numbers[phrase].append(i)
        self.reach = max(map(len, numbers), default=0) + 1
        self.automaton = ahocorasick.Automaton()
        for phrase, own in numbers.items():
            self.automaton.add_word(phrase, (len(phrase), own))
        if numbers:
            self.automaton.make_automaton()
        self.empty = not numbers
        kept = {c for phrase in numbers for char in phrase for c in (char, *_others().get(char, ())) if not _word(c)}
        self.stretch = re.compile("[\\w" + "".join(map(re.escape, sorted(kept))) + "]+")
        self.known: dict[str, str] = {}

    @staticmethod
    def _at(text: str, begin: int, end: int, first: bool, last: bool) -> bool:
        """Whether a word boundary stands at both ends."""
        before = begin > 0 and _word(text[begin - 1])
        behind = end < len(text) and _word(text[end])
        return before != first and behind != last

    def found(self, text: str, folded: str, low: int = 0, high: int | None = None) -> set[int]:
        """The entries with an occurrence inside [low, high)."""
        out: set[int] = set()
        for end, (size, own) in self.automaton.iter(folded, low, len(folded) if high is None else high):
            out.update(i for i in own if i not in out and self._at(text, end + 1 - size, end + 1, *self.entries[i][2:]))
        return out

    def places(self, text: str) -> list[tuple[int, int]]:
        """(begin, entry) of every whole-word occurrence, in order."""
        if self.empty or not text:
            return []
        folded = text.translate(_FOLD)
        return sorted((end + 1 - size, i) for end, (size, own) in self.automaton.iter(folded) for i in own
                      if self._at(text, end + 1 - size, end + 1, *self.entries[i][2:]))

    def _replace(self, text: str, folded: str, entry: int) -> tuple[str, list[int]]:
        """The text behind one entry, and the ends of what was put in."""
        phrase, new, first, last = self.entries[entry]
        parts, ends, begin, size = [], [], 0, 0
        at = folded.find(phrase)
        while at != -1:
            end = at + len(phrase)
            if self._at(text, at, end, first, last):
                parts += [text[begin:at], new]
                size += at - begin + len(new)
                ends.append(size)
                begin = end
                at = folded.find(phrase, end)
            else:
                at = folded.find(phrase, at + 1)
        return "".join(parts) + text[begin:], ends

    def apply(self, text: str | None) -> str | None:
        if not text or self.empty:
            return text
        return self.stretch.sub(self._stretch, text)

    def _stretch(self, match: re.Match) -> str:
        text = match[0]
        if len(text) > REMEMBERED_CHARS:
            return self._chain(text)
        new = self.known.get(text)
        if new is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            new = self.known[text] = self._chain(text)
        return new

    def _chain(self, text: str) -> str:
        folded = text.translate(_FOLD)
        waiting = self.found(text, folded)
        while waiting:
            entry = min(waiting)
            waiting.discard(entry)
            text, ends = self._replace(text, folded, entry)
            if not ends:
                continue
            folded = text.translate(_FOLD)
            width = len(self.entries[entry][1]) + self.reach
            low = high = 0
            near: list[tuple[int, int]] = []
            for end in ends:   # stretches that the replacements can have changed, overlapping ones as one
                low, top = max(0, end - width), min(len(text), end + self.reach)
                if near and low <= high:
                    near[-1] = near[-1][0], top
                else:
                    near.append((low, top))
                high = top
            for low, top in near:
                waiting.update(i for i in self.found(text, folded, low, top) if i > entry)
        return text


def fold_phrases(df: DataFrame, src: str, dst: str, entries: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``df`` with ``dst`` = ``src`` after all replacements (phrase, replacement) in order.
    A table has the columns entry_no, phrase and replacement."""
    spark = df.sparkSession
    if isinstance(entries, DataFrame):
        # kept: the entries are counted and then read slice by slice
        numbered, at = materialize(entries.where(F.length("phrase") > 0).select("entry_no", "phrase", "replacement")), 0
        rows = numbered.count()
        slices = []
        while at < rows:   # each slice has a bounded number of rows
            part = numbered.orderBy("entry_no", "phrase", "replacement").offset(at).limit(DICTIONARY_ROWS).collect()
            slices.append([(r["phrase"], r["replacement"]) for r in sorted(part)])
            at += DICTIONARY_ROWS
    else:
        entries = list(entries)
        slices = [entries[i: i + DICTIONARY_ROWS] for i in range(0, len(entries), DICTIONARY_ROWS)]
    ship_package(spark)
    out = df.withColumn(dst, F.col(src))
    for n, part in enumerate(slices):
        if n:
            out = materialize(out, "checkpoint")
        out = out.withColumn(dst, _folded(spark.sparkContext.broadcast(part))(F.col(dst)))
    return out


def _folded(shared):
    number = id(shared)

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        if number not in _FOLDERS:
            if len(_FOLDERS) >= 4:
                _FOLDERS.clear()
            _FOLDERS[number] = Folder(shared.value)
        return texts.map(_FOLDERS[number].apply, na_action="ignore")

    return folded


def ordered_entries(abbreviations, synonyms) -> list[tuple[str, str]]:
    """The replacements of cleaning, in order: abbreviations, then each synonym group, its
    longest phrases first."""
    out = [(a, full) for a, full in abbreviations if a]
    for canonical, phrases in synonyms:
        out += [(p, canonical) for p in sorted([p for p in phrases if p], key=len, reverse=True)]
    return out
