"""Benchmark decontamination by templates (operator 5).

Texts are canonicalised to templates: marks are dropped and letters lower-cased; numbers,
names (capitalised words inside a sentence) and units (unit words behind a number, also
glued to it as in `5km`) become typed placeholders, so that a question with other numbers
or names has the same template.  A capitalised word that opens a sentence may be a name or
not, so its windows are read both ways, on both sides; a window of the item counts once,
whichever of its readings is met.  An opening word of the benchmark is never read as a name
if it is common: in lower case in the benchmark at least as often as capitalised inside
sentences, and never capitalised inside a sentence of the same item.  No reading makes a
window of placeholders only.  Words in capitals beside others in capitals are no names.
Windows of five template tokens of every benchmark item are joined
by hash with the windows of all documents.  A document is contaminated by an item if at
least 0.8 of the item's distinct windows occur in it and the slots are consistent: each
slot value of the item (a number, name or unit) stands for one value along an
occurrence, in at least 0.8 of the matched slots.  So a re-parameterised question is caught, and a text
that merely has the same shape with changing values is not.

Which windows a document shares is found in the scan when the benchmark's windows are
few enough to be sent to all tasks (`broadcast_windows`, counted first); a larger
benchmark is joined by a shuffle, with the same result.

Texts shorter than a window are one window of their whole template, so a very short item
is met by documents of the same template only.  Nulls and texts
without letters or digits match nothing, on either side; rows without an id take no part.
Rows that repeat an id count as one document (or item) with all their windows.  Whole
texts are read.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import BYTE_CODE, SPACES, STEP, Scratch, in_arrow, mix, rule, run_hashes, signed, spans, text_bytes, text_slices

WINDOW = 5
SHARE = 0.8
BROADCAST_WINDOWS = 2_000_000

# Unit words that become a placeholder behind a number.
UNITS = """mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg lb lbs oz pound pounds ton tons ml l litre litres
liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years
dollar dollars usd eur euro euros cent cents percent degree degrees celsius kelvin kmh mph hz khz mhz ghz w kw kwh v volt volts
j kj cal kcal mol pa kpa bar""".split()

WORD, NUMBER, NAME, UNIT = range(4)
HOLDER = rule(4, 71)
PLAIN = np.zeros(256, np.uint64)  # code of letters and digits; marks have none
PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = BYTE_CODE[[*range(48, 58), *range(97, 123), *range(128, 256)]]
PLAIN[65:91] = PLAIN[97:123]


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = spans(SPACES[data], np.array([0, len(data)]))
    return np.sort(run_hashes(data, starts, ends, PLAIN))


UNIT_HASHES = _unit_hashes()


def _units(hashes: np.ndarray) -> np.ndarray:
    return UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, hashes), len(UNIT_HASHES) - 1)] == hashes


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `templates`, and for each token whether it is a capitalised word that opens a sentence, and whether it starts with a capital."""
    data, offsets = text_bytes(column)
    # Latin-1 capitals in UTF-8 fold like A-Z
    folded = data
    if len(data):
        high = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        capital = ((data >= 65) & (data <= 90)) | np.append(high[1:], False)
        folded = np.where(high, data + 32, data).astype(np.uint8)
    starts, ends, rows = spans(SPACES[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), rows, np.zeros(0, bool), np.zeros(0, bool)
    letter = PLAIN[data] > 0
    digit = (data >= 48) & (data <= 57)
    digits = np.cumsum(np.append(0, digit))
    plain = np.cumsum(np.append(0, letter))
    # digits with a unit behind them are two tokens
    places = np.append(np.flatnonzero(letter & ~digit), len(data))
    other = places[np.searchsorted(places[:-1], starts)]  # the first letter of the token
    glued = np.flatnonzero((other < ends) & (digits[np.minimum(other, ends)] > digits[starts]) & (digits[ends] == digits[np.minimum(other, ends)]))
    glued = glued[_units(run_hashes(folded, other[glued], ends[glued], PLAIN))]
    rows = rows + np.searchsorted(glued, rows)
    starts, ends = np.insert(starts, glued + 1, other[glued]), np.insert(ends, glued, other[glued])
    n_plain, n_digits = plain[ends] - plain[starts], digits[ends] - digits[starts]
    # a token opens a sentence at the start of a row or line and behind one of . ! ? :
    stop = np.zeros(256, bool)
    stop[[33, 46, 58, 63, 10]] = True
    stops = np.cumsum(np.append(0, stop[data]))
    opens = np.append(True, stops[starts[1:]] - stops[np.maximum(ends[:-1] - 2, starts[:-1])] > 0)
    opens[rows[:-1][rows[:-1] < len(starts)]] = True
    first = np.searchsorted(np.flatnonzero(letter), starts)  # the first letter or digit of the token
    at = np.append(np.flatnonzero(letter), 0)[np.minimum(first, letter.sum())]
    used = n_plain > 0  # tokens of marks only are dropped
    capitals = np.cumsum(np.append(0, capital))
    lower = np.cumsum(np.append(0, ((data >= 97) & (data <= 122)) | ((data >= 128) & ~capital & ~np.append(False, capital[:-1] & (data[:-1] == 0xC3)))))
    loud = ((capitals[ends] - capitals[starts] > 1) & (lower[ends] == lower[starts]))[used]
    hashes = run_hashes(folded, starts, ends, PLAIN)[used]
    number = ((n_digits > 0) & (n_digits == n_plain))[used]
    upper, opens = (capital[at] & used)[used], opens[used]
    kept = np.cumsum(np.append(0, used))
    rows = kept[rows]
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    beside = loud[1:] & loud[:-1] & (of[1:] == of[:-1])
    named = upper & ~(np.append(beside, False) | np.append(False, beside))
    behind = np.append(False, number[:-1])
    behind[rows[:-1][rows[:-1] < len(hashes)]] = False
    unit = behind & _units(hashes)
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(named & ~opens, NAME, WORD))).astype(np.int8)
    return np.where(kind == WORD, hashes, HOLDER[kind]), hashes, kind, rows, named & opens & (kind == WORD), upper


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token, plain word hash and kind of every token, and the rows' token offsets; words that open a sentence are words."""
    return _tokens(column)[:4]


def common_words(items: DataFrame) -> np.ndarray:
    """The sorted hashes of the words that open sentences of the items and are common in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                _, plain, kind, _, opener, upper = _tokens(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "word": signed(plain), "opening": pa.array(opener.astype(np.int64)), "inside": pa.array((kind == NAME).astype(np.int64)), "lower": pa.array((~upper).astype(np.int64)),
                })

    counts = in_arrow(items.select("text"), count, "word long, opening long, inside long, lower long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("opening", "inside", "lower")))
    found = counts.where("opening > 0 and lower > 0 and lower >= inside").select("word").collect()
    return np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))


def _readings(tokens: np.ndarray, opener: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]]]:
    """For each choice of places read as names: where its windows start, their hashes, those of the first reading, and the places."""
    size = np.diff(rows)
    word = np.append(0, np.cumsum(kind == WORD))
    for length in range(1, WINDOW + 1):
        if length < WINDOW:  # a short text is one window
            starts = rows[:-1][size == length]
        else:
            of = np.repeat(np.arange(len(size)), size)
            starts = np.flatnonzero(np.arange(len(tokens)) + WINDOW <= rows[of + 1])
        if not len(starts):
            continue
        total = np.zeros(len(starts), np.uint64)
        for j in range(length):
            total += tokens[starts + j] * STEP[j]
        first = mix(total + np.uint64(length))
        yield starts, first, first, ()
        words = word[starts + length] - word[starts]
        for n in range(1, length + 1):
            for places in combinations(range(length), n):
                fits = words > n
                for j in places:
                    fits &= opener[starts + j]
                at = np.flatnonzero(fits)
                if len(at):
                    changed = total[at]
                    for j in places:
                        changed = changed + (HOLDER[NAME] - tokens[starts[at] + j]) * STEP[j]
                    yield starts[at], mix(changed + np.uint64(length)), first[at], places


def window_rows(texts: DataFrame, wanted: np.ndarray | None = None, common: np.ndarray | None = None) -> DataFrame:
    """id, window, first, at, slots: the distinct windows of each text in all their readings, the first reading of the same window, the plain hashes of the slots, and where each comes first.

    wanted: the sorted hashes to look for; all windows without it.
    common: the sorted hashes of opening words that are no names unless their text has them capitalised inside a sentence.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                tokens, plain, kind, rows, opener, _ = _tokens(part.column("text"))
                of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                if common is not None and len(common):
                    in_text = plain + mix(of.astype(np.uint64) + np.uint64(1))
                    opener &= ~np.isin(plain, common) | np.isin(in_text, in_text[kind == NAME])
                out: dict[tuple, int] = {}
                for starts, hashes, firsts, places in _readings(tokens, opener, kind, rows):
                    if wanted is not None:
                        found = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                        starts, hashes, firsts = starts[found], hashes[found], firsts[found]
                    for i, h, f in zip(starts.tolist(), hashes.view(np.int64).tolist(), firsts.view(np.int64).tolist(), strict=True):
                        r = int(of[i])
                        end = min(i + WINDOW, int(rows[r + 1]))
                        slot = kind[i:end] != WORD
                        slot[list(places)] = True
                        key = (r, h, f, *plain[i:end][slot].view(np.int64).tolist())
                        out[key] = min(out.get(key, i), i)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id").take(pa.array([k[0] for k in out], pa.int64())), "window": pa.array([k[1] for k in out], pa.int64()), "first": pa.array([k[2] for k in out], pa.int64()),
                    "at": pa.array([i - int(rows[k[0]]) for k, i in out.items()], pa.int32()), "slots": pa.array([list(k[3:]) for k in out], pa.list_(pa.int64())),
                })

    return in_arrow(texts, emit, "id long, window long, first long, at int, slots array<long>")


def contaminated(
    docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """id, item, matched (distinct windows), windows (of the item), slots, consistent: the pairs over both thresholds."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    own = scratch.table(window_rows(asked, common=common_words(asked)), "items").select(F.col("id").alias("item"), "window", F.col("first").alias("part"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    sizes = own.groupBy("item").agg(F.countDistinct("part").alias("windows"))
    distinct = scratch.table(own.select("window").distinct(), "windows")
    few = distinct.count() <= broadcast_windows
    wanted = np.sort(np.array([r.window for r in distinct.collect()], np.int64).view(np.uint64)) if few else None
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = scratch.table(window_rows(rows, wanted).drop("first").join(own, "window"), "hits")
    matched = hits.groupBy("id", "item").agg(F.countDistinct("part").alias("matched")).join(sizes, "item").where(F.col("matched") >= share * F.col("windows"))
    # an occurrence lies on one diagonal: the same value of the item must stand for the same value along it
    near = hits.join(matched.select("id", "item"), ["id", "item"], "left_semi")
    # of the readings of one place, the one with the most slots holds the others
    most = F.max(F.struct(F.size("slots").alias("n"), "slots", "item_slots")).alias("m")
    near = near.groupBy("id", "item", "part", "at", "item_at").agg(most).select("id", "item", "at", "item_at", "m.slots", "m.item_slots")
    slots = near.select("id", "item", (F.col("at") - F.col("item_at")).alias("diagonal"), F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
    values = slots.groupBy("id", "item", "diagonal", F.col("s.item_slots").alias("of"), F.col("s.slots").alias("value")).agg(F.count("*").alias("n"))
    best = values.groupBy("id", "item", "diagonal", "of").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    agree = best.groupBy("id", "item").agg((F.sum("best") / F.sum("n")).alias("consistent"), F.countDistinct("of").alias("slots"))
    out = matched.join(agree, ["id", "item"], "left").withColumns({"consistent": F.coalesce("consistent", F.lit(1.0)), "slots": F.coalesce("slots", F.lit(0))})
    return out.where(F.col("consistent") >= share).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "windows", "slots", "consistent")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that no item contaminates; rows without an id stay."""
    leaked = contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__leaked")).distinct()
    return docs.join(leaked, F.col(id_col).cast("long") == F.col("__leaked"), "left_anti")
