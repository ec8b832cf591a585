"""Term matching over text tables: a single pass, or a positional inverted index.

``match_fields`` reads the texts once with a multi-pattern automaton and needs no shuffle; it suits one batch of terms. ``build_index``
pays once and then answers any number of batches from the distinct units of the corpus. Both give the same rows.

Texts become units: maximal runs without separators (white space, Chinese sentence marks), Chinese runs as overlapping
pairs of characters, so that every character outside the separators starts or lies in exactly one unit and Chinese text needs no marks.
The index holds, in a row per document, its distinct units with the field and the gap-coded positions in the document (fields lie one
space apart). A term of one unit is a hit wherever a unit that holds it occurs. A longer one (a phrase, a longer Chinese word) is
looked for only at the positions of its rarest part, also from the end of one field into the next; of more than ``SCAN_TERMS`` longer
ones the rarest parts are nearly everywhere, so they are looked for together, in one pass over the texts. Terms come in batches of
bounded size, nothing is truncated, and the hit table is broadcast only within a measured size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import BROADCAST_MAX_BYTES, broadcast_if_small, materialize, spread, union_all

SEPARATORS = r"\s　，。；：！？、"
CJK_RANGE = "一-鿿"
CJK = re.compile(f"[{CJK_RANGE}]")
UNIT = re.compile(f"[{CJK_RANGE}]+|[^{SEPARATORS}{CJK_RANGE}]+")
WORD = re.compile(r"\w+")
SPACE = re.compile(f"[{SEPARATORS}]")
MARK = re.compile("[，。；：！？、]")
#: White space by its code; none lies beyond.
WHITE = np.array([chr(i).isspace() for i in range(0x3002)])
#: Characters of terms that one pattern automaton holds; more terms take further passes over the units.
PART_CHARS = 4_000_000
#: Up to so many longer terms are compared at the positions of their rarest parts, more in one pass over the texts; the rows are the same.
SCAN_TERMS = 1000
#: Bit of ``fields`` for a phrase that runs from one field into the next.
CROSSING = 62
#: From this length on a text is cut at its white space as an array.
LONG_TEXT = 400


@dataclass(frozen=True)
class Matcher:
    """How a term matches a text: terms of the ``whole_word`` pattern need a word boundary at both ends, all others are
    found anywhere."""

    whole_word: str | None = None


# Which terms match whole words only.
TOKEN = Matcher("^[a-z0-9]{1,2}$")
KEYWORD = Matcher("^[a-z0-9][a-z0-9\\-]*$")
SUBSTRING = Matcher()


@dataclass(frozen=True)
class TextIndex:
    """``documents``: keys, unit, field and gaps as arrays; ``texts``: keys, texts array<string> in field order."""

    keys: list[str]
    names: list[str]
    documents: DataFrame
    texts: DataFrame
    units: list[DataFrame] = field(default_factory=list)

    @property
    def postings(self) -> DataFrame:
        """keys, unit, field, gaps: a row for every document, unit and field."""
        return self.entries("unit", "field", "gaps")

    def entries(self, *columns: str) -> DataFrame:
        """The postings with some of their columns; the others are not read."""
        return self.documents.select(*self.keys, F.explode(F.arrays_zip(*columns)).alias("_e")).select(*self.keys, *[F.col("_e")[c].alias(c) for c in columns])

    def vocabulary(self) -> DataFrame:
        """(unit, n): the distinct units with the number of their postings, staged at their first use."""
        if not self.units:
            self.units.append(materialize(self.documents.select(F.explode("unit").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))))
        return self.units[0]

    def weigh(self, weights: dict[str, int], combine: Callable[[Column, Column], Column]) -> Column:
        return weigh(self.names, weights, combine)


def weigh(names: Iterable[str], weights: dict[str, int], combine: Callable[[Column, Column], Column]) -> Column:
    """Weights of the fields in ``fields``, combined; 0 where a term only runs across fields."""
    parts = [F.when(F.getbit("fields", F.lit(i)) == 1, F.lit(weights[n])).otherwise(0) for i, n in enumerate(names)]
    return reduce(combine, parts, F.lit(0)).cast("int")


def best_of(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def sum_of(a: Column, b: Column) -> Column:
    return a + b


# --- units ---------------------------------------------------------------------------------------


def is_cjk(char: str) -> bool:
    return "一" <= char <= "鿿"


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def units_of(text: str) -> Iterator[tuple[str, int]]:
    """(unit, position). The last character of a unit tells its kind: c for Chinese; 0 to 3 for other runs, 1 with a Chinese
    neighbour on the left, 2 with one on the right, so that word boundaries can be told from the unit alone."""
    for match in UNIT.finditer(text):
        run, at, end = match[0], match.start(), match.end()
        if is_cjk(run[0]):
            for i in range(len(run) - 1):
                yield run[i:i + 2] + "c", at + i
            yield run[-1] + "c", end - 1
        else:
            left, right = at > 0 and is_cjk(text[at - 1]), end < len(text) and is_cjk(text[end])
            yield run + "0123"[left + 2 * right], at


def term_parts(term: str, whole_word: bool) -> list[tuple[str, str, int]]:
    """(part, kind, place in the term). Kinds: word and sub lie anywhere in a unit, suffix ends it, prefix and start begin it, exact fills it."""
    out = []
    for match in UNIT.finditer(term):
        run, at, end = match[0], match.start(), match.end()
        alone = at == 0 and end == len(term)
        if not is_cjk(run[0]) or (alone and len(run) <= 2):
            kind = "word" if whole_word else "sub" if alone else "suffix" if at == 0 else "prefix" if end == len(term) else "exact"
            out.append((run, kind, at))
        elif len(run) == 1:
            out.append((run, "start", at))
        else:
            out += [(run[i:i + 2], "exact", at + i) for i in range(len(run) - 1)]
    return out


def _bounded(core: str, flag: str, start: int, end: int) -> bool:
    """Word boundaries at both ends of core[start:end]."""
    before = is_word(core[start - 1]) if start else flag in "13"
    after = is_word(core[end]) if end < len(core) else flag in "23"
    return before != is_word(core[start]) and after != is_word(core[end - 1])


def _fits(kind: str, core: str, flag: str, start: int, end: int) -> bool:
    match kind:
        case "sub":
            return True
        case "word":
            return _bounded(core, flag, start, end)
        case "suffix":
            return flag != "c" and end == len(core)
        case "prefix":
            return flag != "c" and start == 0
        case "start":
            return flag == "c" and start == 0
    return start == 0 and end == len(core)


# --- building ------------------------------------------------------------------------------------


def _joined_fields(docs: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    return spread(docs.select(*keys, F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in fields.values()]).alias("texts")))


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _runs(text: str) -> Iterable[tuple[str, int]]:
    """(run, position) of a text without Chinese signs."""
    if len(text) < LONG_TEXT or not text.isascii() and MARK.search(text):
        return ((m[0], m.start()) for m in UNIT.finditer(text))
    runs = text.split()  # the white space of regular expressions
    solid = np.ones(len(text) + 1, bool)
    solid[0] = False
    solid[1:] = ~WHITE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(WHITE) - 1)]
    return zip(runs, np.flatnonzero(solid[1:] & ~solid[:-1]).tolist(), strict=True)


def build_index(docs: DataFrame, keys: list[str], fields: dict[str, Column]) -> TextIndex:
    """The index of ``docs`` (one row per key), its fields in the given order. Null texts are empty; the postings are staged, a document's in one row."""
    names, texts = list(fields), _joined_fields(docs, keys, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                units, of, bases, places, rows = [], [], [], [], [0]
                for texts_of_row in part.column("texts").to_pylist():
                    base = 0
                    for i, text in enumerate(texts_of_row):
                        found: dict[str, list[int]] = {}
                        chinese = not text.isascii() and CJK.search(text)
                        for unit, at in units_of(text) if chinese else _runs(text):
                            if unit in found:
                                found[unit].append(at)
                            else:
                                found[unit] = [at]
                        units += found if chinese else [unit + "0" for unit in found]
                        of += [i] * len(found)
                        bases += [base] * len(found)
                        places += found.values()
                        base += len(text) + 1
                    rows.append(len(units))
                cuts = np.cumsum([0, *map(len, places)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(places), np.int32, cuts[-1])
                gaps = np.diff(flat, prepend=np.int32(0))
                gaps[cuts[:-1]] = flat[cuts[:-1]] + np.array(bases, np.int32)  # a unit has one position at least
                lists = [pa.array(units, pa.string()), pa.array(of, pa.int8()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(gaps))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), x) for x in lists)],
                                                 [*keys, "unit", "field", "gaps"])

    documents = materialize(texts.mapInArrow(run, f"{_types(texts, keys)}, unit array<string>, field array<tinyint>, gaps array<array<int>>"), "zstd")
    return TextIndex(keys, names, documents, texts)


# --- matching ------------------------------------------------------------------------------------


def _numbered(terms: DataFrame, matcher: Matcher) -> DataFrame:
    """Distinct usable terms with a number (staged, so that it stays) and the whole-word flag."""
    clean = terms.select("term").where("term is not null and length(trim(term)) > 0").distinct()
    whole = F.col("term").rlike(matcher.whole_word) if matcher.whole_word else F.lit(False)
    return materialize(clean.withColumn("term_id", F.monotonically_increasing_id()).withColumn("whole_word", whole))


def _batches_of(terms: DataFrame, flag: str = "whole_word") -> Iterator[list[tuple]]:
    """The terms in batches of about PART_CHARS characters, whatever their number: term, term_id, ``flag``."""
    total = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    n = int(total) // PART_CHARS + 1
    for i in range(n):
        yield [tuple(r) for r in terms.where(F.pmod(F.col("term_id"), F.lit(n)) == i).select("term", "term_id", flag).collect()]


def _automaton(patterns: dict[str, list]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    machine = ahocorasick.Automaton()
    for pattern, what in patterns.items():
        machine.add_word(pattern, (len(pattern), what))
    machine.make_automaton()
    return machine


def _parts_of(terms: DataFrame) -> DataFrame:
    """(term_id, n_parts, spaced, no, part, kind, place) of the terms' parts, staged."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for term, number, whole in zip(*(batch.column(c).to_pylist() for c in ("term", "term_id", "whole_word")), strict=True):
                parts = term_parts(term, whole)
                spaced = sum(len(m[0]) for m in UNIT.finditer(term)) < len(term)
                out += [(number, len(parts), spaced, i, part, kind, place) for i, (part, kind, place) in enumerate(parts)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["term_id", "n_parts", "spaced", "no", "part", "kind", "place"])

    return materialize(terms.select("term", "term_id", "whole_word").mapInArrow(
        split, "term_id long, n_parts int, spaced boolean, no int, part string, kind string, place int"))


def _unit_hits(units: DataFrame, terms: DataFrame, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, n, part, kind, at: where a unit holds a part), and the terms' parts, or those given. Many terms may have a part in common, so
    units meet distinct parts only. Both staged."""
    schema, kinds = "unit string, n long, part string, kind string, at int", [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    names = [c.split()[0] for c in schema.split(", ")]
    parts = _parts_of(terms) if parts is None else parts
    wanted = parts.select("part", "kind").distinct().withColumnRenamed("part", "term").withColumn("term_id", F.xxhash64("term", "kind"))
    found = []
    for batch in _batches_of(wanted, "kind"):
        patterns: dict[str, list] = {}
        for part, _, kind in batch:
            patterns.setdefault(part, []).append(kind)

        def run(rows: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            machine = _automaton(patterns)
            for each in rows:
                out: list[tuple] = []
                for unit, n in zip(each.column("unit").to_pylist(), each.column("n").to_pylist(), strict=True):
                    core, flag = unit[:-1], unit[-1]
                    out += [(unit, n, core[last + 1 - size:last + 1], kind, last + 1 - size) for last, (size, what) in machine.iter(core) for kind in what
                            if _fits(kind, core, flag, last + 1 - size, last + 1)]
                columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        if patterns:
            found.append(units.mapInArrow(run, schema))
    return materialize(union_all(found) if found else units.sparkSession.createDataFrame([], schema)), parts


def match_index(index: TextIndex, terms: DataFrame, matcher: Matcher = TOKEN) -> DataFrame:
    """keys, term, fields: one row for every document that holds the term; bit i of ``fields`` stands for the i-th field, bit
    CROSSING for a phrase that only runs from one field into the next (one space between them)."""
    numbered = _numbered(terms, matcher)
    parts = _parts_of(numbered)
    single = F.expr("n_parts = 1 and not spaced")
    longer, found = parts.where(~single), []
    n_longer = longer.select("term_id").distinct().count()
    if n_longer > SCAN_TERMS:
        found = _by_scan(index, longer, numbered)
    if n_longer <= SCAN_TERMS or not parts.where(single).isEmpty():
        hits, _ = _unit_hits(index.vocabulary(), numbered, parts.where(single) if found else parts)
        # a unit that holds a part at several places holds the term once
        alone = hits.select("unit", "part", "kind").distinct().join(broadcast_if_small(parts.where(single)), ["part", "kind"])
        whole = broadcast_if_small(materialize(alone.groupBy("unit").agg(F.collect_set("term_id").alias("ids"))))  # terms inside one unit
        direct = index.entries("unit", "field").join(whole, "unit").select(*index.keys, "field", F.explode("ids").alias("term_id"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("field").cast("int"))
        if n_longer and not found:
            found = _by_position(index, hits, _rarest(hits, longer), numbered)
        found = [direct.groupBy(*index.keys, "term_id").agg(F.bit_or(bit).alias("fields")), *found]
    return union_all(found).join(broadcast_if_small(numbered.select("term_id", "term")), "term_id").select(*index.keys, "term", "fields")


def _by_scan(index: TextIndex, longer: DataFrame, numbered: DataFrame) -> list[DataFrame]:
    """(keys, term_id, fields) of the ``longer`` terms, each batch of them in one pass over the texts. Such terms have no word rule of their own:
    what a whole-word pattern takes has one part."""
    keys, kinds = index.keys, f"{_types(index.texts, index.keys)}, term_id long, fields long"
    terms = materialize(numbered.join(broadcast_if_small(longer.select("term_id").distinct()), "term_id", "left_semi"))
    found = []
    for batch in _batches_of(terms):
        patterns = [(term, number) for term, number, _ in batch]

        def run(rows: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for term, number in patterns:
                machine.add_word(term, (len(term), number))
            machine.make_automaton()
            for each in rows:
                row, numbers, masks = [], [], []
                for r, texts in enumerate(each.column("texts").to_pylist()):
                    ends, held = list(accumulate(len(t) + 1 for t in texts)), {}
                    for last, (size, number) in machine.iter(" ".join(texts)):
                        first = bisect_right(ends, last + 1 - size)  # a field's end is the space behind it
                        bit = 1 << (first if last + 1 < ends[first] else CROSSING)
                        held[number] = held.get(number, 0) | bit
                    row += [r] * len(held)
                    numbers += held
                    masks += [m & ~(1 << CROSSING) or m for m in held.values()]
                yield pa.RecordBatch.from_arrays([*(each.column(k).take(pa.array(row, pa.int64())) for k in keys), pa.array(numbers, pa.int64()),
                                                  pa.array(masks, pa.int64())], [*keys, "term_id", "fields"])

        if patterns:
            found.append(index.texts.mapInArrow(run, kinds))
    return found


def _rarest(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """(term_id, part, kind, place) of each term's part with the fewest postings; terms that lack a part are gone."""
    sizes = hits.groupBy("part", "kind").agg(F.sum("n").alias("n"))
    least = parts.join(sizes, ["part", "kind"]).groupBy("term_id", "n_parts").agg(
        F.count("*").alias("have"), F.min(F.struct("n", "no", "part", "kind", "place")).alias("least")).where("have = n_parts")
    return least.select("term_id", "least.part", "least.kind", "least.place")


def _by_position(index: TextIndex, hits: DataFrame, rarest: DataFrame, numbered: DataFrame) -> list[DataFrame]:
    """Terms of several parts, or with separators at an end: the text is compared at the positions of the rarest part. A document's postings
    go to its text once for each batch of terms, however many of them ask for a unit."""
    number = F.xxhash64("part", "kind").alias("number")  # parts of one number would only be compared more often
    asks = materialize(rarest.select("term_id", "place", number).join(broadcast_if_small(numbered.select("term_id", "term")), "term_id"))
    places = hits.select("unit", "at", number)
    n = int(asks.agg(F.sum(F.length("term") + 16)).first()[0] or 0) // PART_CHARS + 1
    return [_compared(index, places, asks.where(F.pmod(F.col("term_id"), F.lit(n)) == i)) for i in range(n)]


def _compared(index: TextIndex, places: DataFrame, asks: DataFrame) -> DataFrame:
    """(keys, term_id, fields) of one batch of terms."""
    keys, wanted = index.keys, {}
    for r in asks.select("number", "term_id", "term", "place").collect():  # PART_CHARS characters at most
        wanted.setdefault(r["number"], []).append((r["term_id"], r["term"], r["place"]))
    units = places.join(broadcast_if_small(asks.select("number").distinct()), "number", "left_semi").groupBy("unit").agg(F.collect_set(F.struct("number", "at")).alias("holds"))
    asked = index.postings.join(broadcast_if_small(materialize(units)), "unit").groupBy(*keys).agg(
        F.collect_list(F.struct("holds", "gaps")).alias("asked"))  # a document's postings at most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, numbers, masks = [], [], []
            for r, (texts, postings) in enumerate(zip(batch.column("texts").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                whole = " ".join(texts)
                ends = (np.cumsum([len(t) + 1 for t in texts]) - 1).tolist()
                held: dict[int, int] = {}
                for posting in postings:
                    starts = np.cumsum(posting["gaps"]).tolist()
                    for part in posting["holds"]:
                        for number, term, place in wanted[part["number"]]:
                            for at in starts:
                                at += part["at"] - place
                                if at >= 0 and whole.startswith(term, at):
                                    first, end = bisect_left(ends, at), at + len(term)
                                    inside = first == bisect_left(ends, end - 1) and end <= ends[first]
                                    held[number] = held.get(number, 0) | 1 << (first if inside else CROSSING)
                row += [r] * len(held)
                numbers += held
                masks += [m & ~(1 << CROSSING) or m for m in held.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keys), pa.array(numbers, pa.int64()),
                                              pa.array(masks, pa.int64())], [*keys, "term_id", "fields"])

    return index.texts.join(asked, keys).mapInArrow(compare, f"{_types(index.texts, keys)}, term_id long, fields long")


def _split_words(batch: list[tuple[str, int, bool]]) -> tuple[dict[str, list], set[str]]:
    """(patterns of the automaton, terms that equal a whole word): a term of word characters alone with a boundary at both ends is a word."""
    usable = [(term, whole) for term, _, whole in batch if UNIT.search(term)]
    words = {term for term, whole in usable if whole and all(map(is_word, term))}
    return {term: [(term, whole)] for term, whole in usable if term not in words}, words


def _held(text: str, machine: ahocorasick.Automaton | None, words: set[str]) -> set[str]:
    """The terms that one text holds."""
    here = words.intersection(WORD.findall(text)) if words else set()
    if machine:
        here |= {what[0][0] for last, (size, what) in machine.iter(text) if not what[0][1] or _bounded(text, "0", last + 1 - size, last + 1)}
    return here


def match_fields(docs: DataFrame, keys: list[str], fields: dict[str, Column], terms: DataFrame, matcher: Matcher = TOKEN) -> DataFrame:
    """The rows of ``match_index`` without an index: one pass over the texts for each batch of terms, and no shuffle of texts."""
    texts = _joined_fields(docs, keys, fields)
    found = []
    for batch in _batches_of(_numbered(terms, matcher)):
        patterns, single_words = _split_words(batch)

        def run(rows: Iterator[pa.RecordBatch], patterns=patterns, single_words=single_words) -> Iterator[pa.RecordBatch]:
            machine = _automaton(patterns)
            for each in rows:
                row, names, masks = [], [], []
                for r, parts in enumerate(each.column("texts").to_pylist()):
                    held: dict[str, int] = {}
                    for i, text in enumerate(parts):
                        for term in _held(text, machine, single_words):
                            held[term] = held.get(term, 0) | 1 << i
                    if phrases:
                        for term in _over_borders(machine, parts):
                            held.setdefault(term, 1 << CROSSING)
                    row += [r] * len(held)
                    names += held
                    masks += held.values()
                yield pa.RecordBatch.from_arrays([*(each.column(k).take(pa.array(row, pa.int64())) for k in keys), pa.array(names, pa.string()),
                                                  pa.array(masks, pa.int64())], [*keys, "term", "fields"])

        longest = max(map(len, patterns), default=0)
        phrases = {t: w for t, w in patterns.items() if SPACE.search(t)}

        def _over_borders(machine: ahocorasick.Automaton, parts: list[str], phrases=phrases, longest=longest) -> set[str]:
            """Phrases that hold a border between two fields: only the ends of a field can take part."""
            cut = [t if len(t) <= 2 * longest else f"{t[:longest]}\0{t[-longest:]}" for t in parts]
            text, borders = " ".join(cut), np.cumsum([len(c) + 1 for c in cut])[:-1] - 1
            out = set()
            for last, (size, what) in machine.iter(text):
                first = last + 1 - size
                if what[0][0] in phrases and np.searchsorted(borders, first) != np.searchsorted(borders, last + 1):
                    out.add(what[0][0])
            return out

        if patterns or single_words:
            found.append(texts.mapInArrow(run, f"{_types(texts, keys)}, term string, fields long"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{_types(texts, keys)}, term string, fields long")
    return union_all(found)  # a term is in one batch


def match_texts(texts: DataFrame, terms: DataFrame, keys: list[str], text_col: str = "text", matcher: Matcher = TOKEN) -> DataFrame:
    """Distinct (keys, term) in one pass over the texts, without an index: for tables that are searched once for few terms."""
    numbered = _numbered(terms, matcher)
    rows = texts.where(F.col(text_col).isNotNull()).select(*keys, F.lower(text_col).alias("_text"))
    kinds = _types(rows, keys)
    found = []
    for batch in _batches_of(numbered):
        patterns, single_words = _split_words(batch)

        def run(rows: Iterator[pa.RecordBatch], patterns=patterns, single_words=single_words) -> Iterator[pa.RecordBatch]:
            machine = _automaton(patterns)
            for each in rows:
                row, names = [], []
                for i, text in enumerate(each.column("_text").to_pylist()):
                    here = _held(text, machine, single_words)
                    row += [i] * len(here)
                    names += here
                yield pa.RecordBatch.from_arrays([*(each.column(k).take(pa.array(row, pa.int64())) for k in keys), pa.array(names, pa.string())], [*keys, "term"])

        if patterns or single_words:
            found.append(rows.mapInArrow(run, f"{kinds}, term string"))
    if not found:
        return texts.sparkSession.createDataFrame([], f"{kinds}, term string")
    return union_all(found).distinct()
