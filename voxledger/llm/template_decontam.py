"""Benchmark decontamination by templates.

Texts become sequences of template tokens: numbers, quantities, units and names turn into typed
placeholders, other words stay in lower case without punctuation at their ends. Windows of template
tokens are hashed and joined between documents and benchmark items. A window's placeholders hold
slot values; along one alignment of a document and an item every item value must stand for one
document value and the other way round. So a question asked again with other numbers or names is
found, and text that only has the same shape is not. A document leaks an item when aligned,
consistent windows cover at least half of the item's windows.

Documents are windowed inside the tasks. A bit set of the benchmark's window hashes (at most 16 MB,
sized by their count) keeps windows that cannot match out of the shuffle; it only passes too much.
Whatever passes is joined on the full hash, as an ordinary join that adaptive skew handling can
split when one passage stands in very many documents.

Rules: a token is a run outside ``[\\x20\\x09-\\x0D]`` without ASCII punctuation at its ends; empty
ones vanish. A first character 0-9 makes a number (only ``0-9.,:/-``) or a quantity (others); a known
unit after a number is a unit; a capital (A-Z, À-Ö, Ø-Þ) before a small letter makes a name, unless it
begins a sentence or line. All else is compared in lower case, so shouted passages match, but for windows with names. Windows need
``literals`` words that are no placeholders. Items shorter than a window are one window, with at
least ``short_literals``. Items without any such window, null and empty texts match nothing.

With ``whole`` (``WHOLE``) windows with fewer literal words count too, and match where their words stand verbatim
(case aside): questions dense in numbers and names are found when they are copied. An alignment with clashing slots
keeps the pairs that are ahead of all pairs with the same item value or document value, and loses only windows with other
pairs; windows whose slots all hold the item's own values always count. Windows also have a second reading, in which capitalised words are
names at the beginning of a sentence or line too; it counts for the item's window, whose first reading decides on literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bitset import bit_set, passes
from voxledger.llm.bytetext import mix, slices, span_hash, windows, words
from voxledger.llm.tables import free_names, stored

NUMBER, QUANTITY, UNIT, NAME = 1, 2, 3, 4

UNITS = (
    "m mm cm km kg g mg lb oz t l ml s h min ms hour hours minute minutes second seconds day days week weeks month months "
    "year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms "
    "pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degree degrees apples people"
).split()


@dataclass(frozen=True)
class Parameters:
    width: int = 8
    literals: int = 4
    short_literals: int = 3
    share: float = 0.5
    bits_per_window: int = 512
    whole: bool = False  # search for all windows, by the rules at the end of the module's text


WHOLE = Parameters(whole=True)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[[*range(48, 58), *b".,:/-"]] = True


@dataclass
class Template:
    code: np.ndarray  # hash of the word, or of its placeholder
    value: np.ndarray  # hash of the word itself
    slot: np.ndarray  # is it a placeholder
    first: np.ndarray  # bounds of the texts
    wide_code: np.ndarray  # the second reading: names also at the beginning of sentences
    wide_slot: np.ndarray


def templates(column: pa.Array) -> Template:
    w = words(column, lower=False)
    n = len(w.data)
    if not len(w.start):
        empty = np.zeros(0, np.uint64)
        return Template(empty, empty, np.zeros(0, bool), np.zeros(len(column) + 1, np.int64), empty, np.zeros(0, bool))
    place = np.arange(n)
    solid = ~_PUNCTUATION[w.data]
    after = np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    start, end = after[w.start], before[w.end - 1] + 1
    real = start < end
    start, end, text = start[real], end[real], w.text[real]
    first = np.searchsorted(text, np.arange(len(column) + 1))
    if not len(start):
        empty = np.zeros(0, np.uint64)
        return Template(empty, empty, np.zeros(0, bool), first, empty, np.zeros(0, bool))
    # Capitals: one byte, or the second byte after 0xC3.
    wide = np.zeros(n, bool)
    wide[1:] = w.data[:-1] == 0xC3
    capital = (w.data >= 65) & (w.data <= 90) | wide & (w.data >= 0x80) & (w.data <= 0x9E) & (w.data != 0x97)
    low = np.where(capital, w.data | 32, w.data)
    small = (low >= 97) & (low <= 122) & ~capital | wide & (low >= 0xA0) & ~capital
    value = span_hash(low, start, end)
    lead = w.data[start]
    head = np.minimum(start + (lead == 0xC3), n - 1)  # the byte that tells a first letter's case
    second = np.minimum(head + 1, n - 1)
    second = np.minimum(second + (w.data[second] == 0xC3), n - 1)
    stops = np.isin(w.data, np.frombuffer(b".!?:;", np.uint8))
    line = np.concatenate([[0], np.cumsum(w.data == 10)])
    raw_start, raw_end = w.start[real], w.end[real]
    begins = np.ones(len(start), bool)
    begins[1:] = (text[1:] != text[:-1]) | stops[raw_end[:-1] - 1] | (line[raw_start[1:]] > line[raw_end[:-1]])
    numeric = np.concatenate([[0], np.cumsum(_NUMERIC[w.data])])
    digit = (lead >= 48) & (lead <= 57)
    number = digit & (numeric[end] - numeric[start] == end - start)
    capitalised = capital[head] & small[second] & (second < end)
    name = capitalised & ~begins
    units = np.array(UNITS, dtype=object)
    unit_data = np.frombuffer("".join(units).encode(), np.uint8)
    unit_end = np.cumsum([len(u) for u in units])
    known = np.isin(value, span_hash(unit_data, unit_end - [len(u) for u in units], unit_end))
    follows = np.zeros(len(start), bool)
    follows[1:] = number[:-1] & (text[1:] == text[:-1])
    kind = np.select([number, digit, known & follows, name], [NUMBER, QUANTITY, UNIT, NAME], 0)
    wide = np.where((kind == 0) & capitalised, NAME, kind)

    def codes(kind: np.ndarray) -> np.ndarray:
        return np.where(kind > 0, mix(kind.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), value)

    return Template(codes(kind), value, kind > 0, first, codes(wide), wide > 0)


SCHEMA = "id long, width int, pos int, h long, slots array<long>, counts boolean"
_VERBATIM = np.uint64(1 << 32)


def _listed(t: Template, slot: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.ListArray:
    """Slot values of the windows from ``a`` to ``b``."""
    before = np.concatenate([[0], np.cumsum(slot)])
    lo, sizes = before[a], before[b] - before[a]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = t.value[np.flatnonzero(slot)[np.repeat(lo - offsets[:-1], sizes) + np.arange(offsets[-1])]].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(taken, pa.int64()))


def _windowed(p: Parameters, widths: list[int] | None, bits: np.ndarray | None):
    """Windows of a batch; ``widths`` None: the widths of benchmark items (their own if shorter than a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, column in slices(batch.column("text")):
                t = templates(column)
                counts = np.diff(t.first)
                slots_before = np.concatenate([[0], np.cumsum(t.slot)])
                for width in widths if widths is not None else range(1, p.width + 1):
                    h, bounds = windows(t.code, t.first, width)
                    text = np.repeat(np.arange(len(counts)), np.diff(bounds))
                    place = np.arange(len(h)) - bounds[text]
                    # A shorter text is no window of this width.
                    fits = counts[text] >= width
                    if widths is None and width < p.width:
                        fits &= counts[text] == width
                    a = t.first[text] + place
                    b = np.minimum(a + width, len(t.code))
                    literal = width - (slots_before[b] - slots_before[a])
                    rich = literal >= (p.literals if width == p.width else min(p.short_literals, width))
                    readings = [(h + np.uint64(width), t.slot, fits & rich, True)]
                    if p.whole:
                        # Documents have both readings of all windows, so the item's literals decide.
                        ok = fits & rich if widths is None else fits
                        second = windows(t.wide_code, t.first, width)[0]
                        readings = [(h + np.uint64(width), t.slot, ok, True), (second + np.uint64(width), t.wide_slot, ok & (second != h), False)]
                        # The item decides which windows are compared word by word; those have no slots.
                        plain = windows(t.value, t.first, width)[0] + np.uint64(width) + _VERBATIM
                        readings.append((plain, np.zeros_like(t.slot), fits & ~rich if widths is None else fits, True))
                    for h, slot, ok, new in readings:
                        h = mix(h)
                        if bits is not None:
                            ok = ok & passes(bits, h)
                        hit = np.flatnonzero(ok)
                        if not len(hit):
                            continue
                        ids = batch.column("id").slice(at, len(column)).take(pa.array(text[hit]))
                        lists = _listed(t, slot, a[hit], b[hit])
                        yield pa.record_batch(
                            [ids, pa.array(np.full(len(hit), width), pa.int32()), pa.array(place[hit], pa.int32()), pa.array(h[hit].view(np.int64)), lists, pa.array(np.full(len(hit), new))],
                            names=["id", "width", "pos", "h", "slots", "counts"],
                        )

    return run


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not at each use inside an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _settled(found: Column) -> Column:
    """Windows of an alignment that hold the item's own values, or only pairs of the map that most of its windows hold.

    A pair is in the map if every other pair with its item value or its document value stands in fewer slots; of two equal
    counts the pair of equal values is ahead.
    """
    same = lambda y: y["ours"] == y["theirs"]
    alike = lambda x, y: (x["ours"] == y["ours"]) & (x["theirs"] == y["theirs"])

    def scored(every: Column) -> Column:
        def score(x: Column) -> Column:
            times = F.array_size(F.filter(every, lambda y: alike(x, y)))
            return F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs"), (2 * times + same(x).cast("int")).alias("score"))

        return F.transform(F.array_distinct(every), score)

    def in_map(pairs: Column) -> Column:
        def ahead(x: Column) -> Column:
            return ~F.exists(pairs, lambda y: ((y["ours"] == x["ours"]) != (y["theirs"] == x["theirs"])) & (y["score"] >= x["score"]))

        return F.filter(pairs, ahead)

    def windows_of(pairs: Column) -> Column:
        whole = F.filter(found, lambda w: F.forall(w["slots"], same) | F.forall(w["slots"], lambda y: F.exists(pairs, lambda x: alike(x, y))))
        return F.transform(whole, lambda w: F.struct(w["b"].alias("b"), F.forall(w["slots"], same).alias("same")))

    every = F.flatten(F.transform(found, lambda w: w["slots"]))
    return _let(every, lambda e: _let(scored(e), lambda s: _let(in_map(s), windows_of)))


def _covered(joined: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, same, b): windows that count, where clashes cost only the windows that hold them."""
    window = F.struct(F.col("b").alias("b"), F.arrays_zip("ours", "theirs").alias("slots"))
    # An alignment has as many windows as the item, in two readings at most.
    aligned = joined.groupBy("doc_id", "item_id", "n_windows", (F.col("d") - F.col("b")).alias("shift")).agg(F.collect_set(window).alias("found"))
    pairs = F.array_distinct(F.flatten(F.transform("found", lambda x: x["slots"])))
    aligned = aligned.withColumn("pairs", pairs)
    size = F.array_size("pairs")
    steady = (F.array_size(F.array_distinct(F.col("pairs.ours"))) == size) & (F.array_size(F.array_distinct(F.col("pairs.theirs"))) == size)
    plain = F.transform("found", lambda x: F.struct(x["b"].alias("b"), F.forall(x["slots"], lambda y: y["ours"] == y["theirs"]).alias("same")))
    counted = aligned.select("doc_id", "item_id", "n_windows", F.explode(F.when(steady, plain).otherwise(_settled(F.col("found")))).alias("w"))
    return counted.select("doc_id", "item_id", "n_windows", F.col("w.same").alias("same"), F.col("w.b").alias("b"))


def _covered_whole_alignments(joined: DataFrame) -> DataFrame:
    """The same, where one clash costs all windows of the alignment."""
    aligned = joined.groupBy("doc_id", "item_id", "n_windows", (F.col("d") - F.col("b")).alias("shift")).agg(
        F.collect_set("b").alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("ours", "theirs")))).alias("pairs")
    )
    ours, theirs = F.array_distinct(F.col("pairs.ours")), F.array_distinct(F.col("pairs.theirs"))
    size = F.array_size("pairs")
    steady = aligned.filter((F.array_size(ours) == size) & (F.array_size(theirs) == size))
    same = F.forall("pairs", lambda x: x["ours"] == x["theirs"])
    return steady.select("doc_id", "item_id", "n_windows", same.alias("same"), F.explode("at").alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, exact): one row for each item that a document holds.

    ``exact`` is true if every slot holds the item's own value. Items are counted by item_id; a
    null id is a value like any other.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").repartition(F.col("id"))
    pieces = stored(items.mapInArrow(_windowed(p, None, None), SCHEMA), "windows")
    stats = pieces.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("w")).first()
    n, widths = stats["n"], sorted(stats["w"])  # widths: at most p.width numbers
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(pieces, n, p.bits_per_window))
    totals = pieces.groupBy(F.col("id").alias("i")).agg(F.count_if("counts").alias("n_windows"))
    bench = pieces.join(totals, F.col("id").eqNullSafe(F.col("i"))).select(F.col("id").alias("item_id"), "h", F.col("pos").alias("b"), F.col("slots").alias("ours"), "n_windows")

    def run(batches):
        yield from _windowed(p, widths, bits.value)(batches)

    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, SCHEMA)
    joined = found.select(F.col("id").alias("doc_id"), "h", (F.col("pos")).alias("d"), F.col("slots").alias("theirs")).join(bench, "h")
    covered = _covered(joined) if p.whole else _covered_whole_alignments(joined)
    pairs = covered.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("b").alias("n_matched"), F.count_distinct(F.when(F.col("same"), F.col("b"))).alias("n_same"))
    return pairs.filter(F.col("n_matched") >= p.share * F.col("n_windows")).select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_same") >= p.share * F.col("n_windows")).alias("exact"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents without those that leak an item; columns stay as they are."""
    (leaked,) = free_names(docs.columns, "_leaked")
    gone = leaks(docs, benchmark, p).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")
