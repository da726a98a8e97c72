"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import SLICE_BYTES, SLICE_WORDS, U64, Words, bit_table, bound_batches, columns, mix, ngram_hashes, pieces, slices, text_buffer, text_of, written

#: Tokens of a template window; an item with fewer has one window of all its tokens. An item of under LEAST tokens says too
#: little to be sought inside texts: it is held by texts that are nothing but these tokens.
WINDOW = 8
LEAST = 4
#: Share of a window's tokens that must be literal, so that bare placeholders match nothing. Windows of RAW values match
#: whatever their share.
LITERAL = 0.5
#: A document holds an item if its windows with consistent slots cover this share of the item's tokens, and RUN tokens
#: or the whole item.
COVERAGE = 0.5
RUN = 13
# number words from two up (those for one are articles in most languages), English, French, German, Spanish
_NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen one"
    " deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cents mille millions milliard milliards demi tiers quart douzaine"
    " zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden halb drittel viertel dutzend"
    " cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones mitad tercio cuarto docena"
)
_UNITS = (
    "mm cm m km kms millimeter millimeters centimeter centimeters meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles"
    " mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons cup cups"
    " second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years"
    " dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit mph kmh kph watt watts kw kwh volt volts byte bytes kb mb gb"
    " millimètre millimètres centimètre centimètres mètre mètres kilomètre kilomètres pouce pouces pied pieds gramme grammes kilo kilos kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés pourcent tasse tasses livre livres"
    " zentimeter zoll fuß meile meilen gramm kilogramm tonnen unze unzen pfund sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad tasse tassen"
    " milímetro milímetros centímetro centímetros metro metros kilómetro kilómetros pulgada pulgadas pie pies milla millas gramo gramos kilogramo kilogramos tonelada toneladas onza onzas libra libras litro litros taza tazas segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados"
)
LITERAL_TOKEN, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: The variant in which every token is a literal, and that of whole texts of under LEAST tokens.
RAW, WHOLE = 2, 3
VARIANTS = (0, 1, RAW)
_SLOT_HASH = np.array([0, 0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003], U64) * U64(0x9E3779B97F4A7C15)

_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\n\"("]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[ord(c) for c in ".,/"]] = True


def _key(h: np.ndarray, variant: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + U64((4 * size + variant) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)


def _lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower case of ASCII and Latin-1 letters with lengths kept, whether a capital begins at each byte)."""
    low = data.copy()
    capital = (data >= 65) & (data <= 90)
    low[capital] += 32
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    low[wide + 1] += 32
    capital[wide] = True
    return low, capital


def _lexicon(words: str) -> np.ndarray:
    found = Words(pa.array([words]))
    return np.sort(found.hashes())


_NUMBER_HASHES, _UNIT_HASHES = _lexicon(_NUMBERS), _lexicon(_UNITS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 16, bool)
    low[(known & U64(0xFFFF)).astype(np.int64)] = True
    out = low[(h & U64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    out[some] = np.isin(h[some], known)
    return out


class Templates:
    """Tokens of a slice of texts: words, which begin with a letter, and numbers (digits, with . , / between them), in
    lower case, each with a kind: a literal, a number (digits or a number word), a unit (a unit word after a number), or a name (capitalised,
    not all in capitals, inside a sentence). `variant` 1 takes capitalised words that begin a sentence for names too; in
    RAW all tokens are literals, so that text full of numbers, units and names still matches word for word."""

    def __init__(self, texts: pa.Array):
        data, off = text_buffer(texts)
        low, capital = _lower(data) if len(data) else (data, np.zeros(0, bool))
        cls = _CLASS[data]
        n = len(data)
        begins = np.zeros(n, bool)
        begins[off[:-1][np.diff(off) > 0]] = True
        change = begins.copy()
        if n:
            change[1:] |= cls[1:] != cls[:-1]
        edges = np.flatnonzero(change)
        start, end, kind = edges, np.append(edges[1:], n), cls[edges] if n else np.empty(0, np.uint8)
        # a run of letters and digits is one word if it begins with a letter; else a number and, maybe, a word
        opens = np.append(True, (kind[1:] == 0) | (kind[:-1] == 0) | begins[start[1:]]) if len(start) else np.empty(0, bool)
        lead = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        stop_of_run = end[np.append(lead[1:], len(start)) - 1][run] if len(start) else end
        second = np.append(False, opens[:-1]) & ~opens
        number_first = kind[lead[run]] == 2 if len(start) else np.empty(0, bool)
        is_token = (kind > 0) & (opens | (second & number_first))
        t = np.flatnonzero(is_token)
        start, stop, digit = start[t], np.where(opens & number_first, end, stop_of_run)[t], kind[t] == 2
        # 1,000 and 2.5 are one number
        follows = np.zeros(len(t), bool)
        if len(t) > 1:
            gap = start[1:] - stop[:-1]
            follows[1:] = digit[1:] & digit[:-1] & (gap == 1) & _JOINS[data[stop[:-1].clip(max=n - 1)]] & ~begins[start[1:]] & ~begins[(start[1:] - 1).clip(min=0)]
        stop = stop[np.append(np.flatnonzero(~follows)[1:], len(t)) - 1] if len(t) else stop
        self.start, self.end, digit = start[~follows], stop, digit[~follows]
        self.first = np.searchsorted(self.start, off)
        words = Words.__new__(Words)
        words.data, words._table, words._sums = low, _PLAIN, None
        self.value = words.hashes(self.start, self.end)
        number = digit | _among(self.value, _NUMBER_HASHES)
        before = np.append(False, number[:-1])
        before[self.first[:-1][np.diff(self.first) > 0]] = False
        unit = ~number & before & _among(self.value, _UNIT_HASHES)
        cap = np.zeros(len(self.start), bool)
        if n:  # a capital and then none: text all in capitals holds no names
            second = self.start + 1 + (data[self.start] == 0xC3)
            cap = capital[self.start] & (second < self.end) & ~capital[np.minimum(second, n - 1)]
        # a sentence begins at the start of a text and after a gap that holds an end mark
        marks = np.append(0, np.cumsum(_ENDS[data]))
        since = np.append(0, self.end[:-1]) if len(self.start) else np.empty(0, np.int64)
        opening = marks[self.start] > marks[np.minimum(since, self.start)]
        opening[self.first[:-1][np.diff(self.first) > 0]] = True
        name = cap & ~number & ~unit
        self.kinds = []
        for variant in (0, 1):
            k = np.zeros(len(self.start), np.uint8)
            k[number], k[unit] = NUMBER, UNIT
            k[name & (~opening | bool(variant))] = NAME
            self.kinds.append(k)
        self.kinds.append(np.zeros(len(self.start), np.uint8))

    def windows(self, variant: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(first tokens, hashes) of the windows of `size` tokens that lie in one text and are literal enough."""
        k = self.kinds[variant]
        if len(k) < size:
            return np.empty(0, np.int64), np.empty(0, U64)
        h = ngram_hashes(np.where(k == LITERAL_TOKEN, self.value, _SLOT_HASH[k]), size)
        literal = np.append(0, np.cumsum(k == LITERAL_TOKEN))
        stop = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(len(h))
        fine = (at + size <= stop[: len(h)]) & (literal[size:] - literal[:-size] >= LITERAL * size)
        return at[fine], h[fine]

    def part(self, a: int, b: int) -> Templates:
        """The tokens [a, b), of one text, alone."""
        out = Templates.__new__(Templates)
        out.value, out.kinds, out.first = self.value[a:b], [k[a:b] for k in self.kinds], np.array([0, b - a])
        return out

    @classmethod
    def of(cls, texts: pa.Array) -> Templates:
        """Of a slice of texts; one long text is worked through in pieces that begin with the last token before them,
        on which the kind of the first one depends."""
        data, _ = text_buffer(texts)
        if len(texts) != 1 or len(data) <= SLICE_BYTES:
            return cls(texts)
        parts, last = [], None
        for a, b in pieces(data):
            begin = a if last is None else last
            t = cls(text_of(data[begin:b]))
            skip = int(last is not None)
            parts.append((t.value[skip:], [k[skip:] for k in t.kinds]))
            if len(t.start):
                last = begin + int(t.start[-1])
        out = cls.__new__(cls)
        out.value = np.concatenate([v for v, _ in parts])
        out.kinds = [np.concatenate(k) for k in zip(*(k for _, k in parts))]
        out.first = np.array([0, len(out.value)])
        return out

    def found(self, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(variant, size, first tokens, keys) of all windows of these sizes; a key stands for hash, size and variant."""
        n = len(self.value)
        step = SLICE_WORDS if len(self.first) == 2 else max(n, 1)
        for size in sizes:
            if size < LEAST:
                at = self.first[:-1][np.diff(self.first) == size]
                if len(at):
                    h = ngram_hashes(self.value, size)[at]
                    yield WHOLE, size, at, _key(h, WHOLE, size)
                continue
            for base in range(0, n, step):
                part = self if step >= n else self.part(base, min(n, base + step + size - 1))
                for variant in VARIANTS:
                    at, h = part.windows(variant, size)
                    if len(at):
                        yield variant, size, at + base, _key(h, variant, size)


_PLAIN = Words(pa.array(["x"]))._table


@dataclass
class Match:
    matched: int
    tokens: int
    slots: int
    changed: int


@dataclass
class Pair:
    """What a document holds of an item of `tokens` tokens, gathered alignment by alignment."""

    tokens: int
    covered: np.ndarray = field(init=False)
    slots: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.covered = np.zeros(self.tokens, bool)

    def add(self, variant: int, p: np.ndarray, kinds: np.ndarray, base: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Equal windows of one variant and one alignment: first tokens in the item, and for each window and token the
        kind, the kind in variant 0, the item's value and the document's.

        In an alignment every slot value of the item should stand for one value in the document and the other way
        round, by majority, and among equals the first in the item; a window with a slot that breaks this doesn't count."""
        size = kinds.shape[1]
        at, once = np.unique((p[:, None] + np.arange(size)).ravel(), return_index=True)
        if variant >= RAW:
            self.covered[at] = True
            for i, j in zip(at.tolist(), once.tolist()):
                if base.flat[j] != LITERAL_TOKEN:
                    self.slots.setdefault(i, (int(x.flat[j]), int(x.flat[j])))
            return
        kind, mine, other = kinds.flat[once], x.flat[once], y.flat[once]
        slots = np.flatnonzero(kind != LITERAL_TOKEN).tolist()
        pairs = list(zip(kind[slots].tolist(), mine[slots].tolist(), other[slots].tolist()))
        there: dict = {}
        back: dict = {}
        for k, a, b in pairs:
            there.setdefault((k, a), Counter())[b] += 1
            back.setdefault((k, b), Counter())[a] += 1
        good = np.ones(self.tokens, bool)
        for i, (k, a, b) in zip(slots, pairs):  # most_common keeps the order of the item among equals
            good[at[i]] = there[k, a].most_common(1)[0][0] == b and back[k, b].most_common(1)[0][0] == a
        bad = np.append(0, np.cumsum(~good))
        starts = p[bad[p + size] == bad[p]]
        self.covered[np.unique(starts[:, None] + np.arange(size))] = True
        for i, (_, a, b) in zip(slots, pairs):
            if self.covered[at[i]]:
                self.slots[int(at[i])] = (a, b)

    def match(self) -> Match | None:
        matched = int(self.covered.sum())
        if matched < COVERAGE * self.tokens or matched < min(self.tokens, RUN):
            return None
        return Match(matched, self.tokens, len(self.slots), sum(a != b for a, b in self.slots.values()))


def item_size(tokens: int) -> int:
    return min(tokens, WINDOW)


def _row_numbers() -> Iterator[int]:
    """Numbers that no two rows of a job share: the partition and the place in it."""
    return count(TaskContext.get().partitionId() << 33)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item_id, text): a row for each window of each item, with the values and kinds of its tokens."""
    number = _row_numbers()
    for batch in batches:
        for i in range(batch.num_rows):
            item = next(number)
            text = Templates.of(batch.column(1)[i : i + 1])
            n = len(text.value)
            for variant, size, at, key in text.found([item_size(n)] if n else []):
                inside = at[:, None] + np.arange(size)
                m = len(at)
                yield pa.record_batch(
                    [pa.array(key), pa.array(np.full(m, item)), batch.column(0)[i : i + 1].take(pa.array(np.zeros(m, np.int64))), *(pa.array(np.full(m, v, np.int32)) for v in (n, size, variant)), pa.array(at.astype(np.int32)),
                     *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (text.kinds[variant if variant < RAW else RAW][inside], text.kinds[0][inside], text.value[inside]))],
                    names=["window", "item", "item_id", "tokens", "size", "variant", "p", "kinds", "base", "x"],
                )


def _document_windows(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (doc_id, text): the windows that pass the filter, with the values of their tokens."""
        table = bits.value
        mask = len(table) * 8 - 1
        number = _row_numbers()
        for batch in batches:
            rows = np.array([next(number) for _ in range(batch.num_rows)], np.int64)
            for a, b in slices(batch.column(1)):
                texts = Templates.of(batch.column(1)[a:b])
                for _, size, at, key in texts.found(sizes):
                    bit = key & mask
                    some = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    if not len(some):
                        continue
                    at, key = at[some], key[some]
                    doc = np.searchsorted(texts.first, at, "right") - 1
                    values = texts.value[at[:, None] + np.arange(size)]
                    yield pa.record_batch(
                        [pa.array(key), pa.array(rows[a:b][doc]), batch.column(0)[a:b].take(pa.array(doc)), pa.array((at - texts.first[doc]).astype(np.int32)), pa.array([r.tobytes() for r in values], pa.binary())],
                        names=["window", "doc", "doc_id", "q", "y"],
                    )

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches from joined windows sorted by (doc, item, variant, shift, p); no more than an alignment, which has an
    item's windows at most, is held besides a batch."""
    pair, own = None, None  # the pair that goes on, and a row of it
    held: pa.RecordBatch | None = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if batch is not None or held is not None else None
        out = []
        if rows is not None:
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "item", "variant", "shift")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *change.tolist()] + ([] if batch is not None else [rows.num_rows])
            columns = [rows.column(c) for c in ("kinds", "base", "x", "y")]
            tokens, sizes, p = (rows.column(c).to_numpy() for c in ("tokens", "size", "p"))
            for f, l in zip(bounds, bounds[1:]):
                if own is None or (keys[0, f], keys[1, f]) != own[0]:
                    if own is not None and (m := pair.match()):
                        out.append((own, m))
                    pair, own = Pair(int(tokens[f])), ((keys[0, f], keys[1, f]), rows.column("doc_id")[f], rows.column("item_id")[f])
                size = int(sizes[f])
                kinds, base, x, y = (np.frombuffer(b"".join(c[f:l].to_pylist()), t).reshape(-1, size) for c, t in zip(columns, (np.uint8, np.uint8, np.int64, np.int64)))
                pair.add(int(keys[2, f]), p[f:l].astype(np.int64), kinds, base, x, y)
            held = rows.slice(bounds[-1]).combine_chunks().to_batches()[0] if batch is not None else None
        if batch is None and own is not None and (m := pair.match()):
            out.append((own, m))
        if out:
            kinds = rows.schema
            yield pa.record_batch(
                [pa.array([o[1].as_py() for o, _ in out], kinds.field("doc_id").type), pa.array([o[2].as_py() for o, _ in out], kinds.field("item_id").type), *(pa.array([getattr(m, c) for _, m in out], pa.int32()) for c in ("matched", "tokens", "slots", "changed"))],
                names=["doc_id", "item_id", "matched", "tokens", "slots", "changed"],
            )


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, tokens, slots, changed) for (doc_id, text) and (item_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    windows = items.where("text is not null").mapInArrow(_item_windows, f"window long, item long, item_id {item_kind}, tokens int, size int, variant int, p int, kinds binary, base binary, x binary")
    windows = written(windows, "windows")
    sizes = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}
    bits = spark.sparkContext.broadcast(bit_table(windows, "window", sum(sizes.values())))
    hits = docs.where("text is not null").mapInArrow(_document_windows(bits, sorted(sizes)), f"window long, doc long, doc_id {doc_kind}, q int, y binary")
    joined = hits.join(windows, "window").withColumn("shift", F.col("q") - F.col("p"))
    parts = joined.repartition("doc").sortWithinPartitions("doc", "item", "variant", "shift", "p")
    return parts.mapInArrow(_judge, f"doc_id {doc_kind}, item_id {item_kind}, matched int, tokens int, slots int, changed int")


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched_tokens, item_tokens, coverage, slots, slots_changed) of every document that holds an
    item of the benchmark, word for word or with other numbers, names and units.

    Texts become templates: numbers, units after numbers and names turn into typed placeholders. Windows of 8 tokens,
    at least half of them literal, are joined by hash, and slots are checked for consistency (see `Pair.add`). Windows
    of the tokens as they are count whatever they hold, so a word-for-word copy of any item is found. Items of 4 to 7
    tokens have one window of all; items of 1 to 3 are held by texts of just these tokens.

    One plan for every size: the windows of the benchmark set bits in a filter of at most 32 MB that all tasks get; only
    windows of documents that pass it are joined with those of the benchmark, with the values of their tokens, so
    texts are read once and never shuffled. A filter that is too small lets more pass, and changes no result.

    Null texts and texts without tokens: no rows. Repeated rows of either side: their rows each. Null ids pass through.
    Items that share windows are judged apart, each for itself. Very long texts are handled whole, in pieces. Empty
    tables: empty result. Columns other than doc_id, item_id and the texts are not read."""
    found = _matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", "item_id", F.col("matched").alias("matched_tokens"), F.col("tokens").alias("item_tokens"), (F.col("matched") / F.col("tokens")).alias("coverage"), "slots", F.col("changed").alias("slots_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that `find_contaminated` reports; all columns as they are. Texts are told apart by two 64-bit
    hashes. Null, empty and repeated rows, null ids, very long texts, ties and empty tables as there: what holds no item
    stays. Extra columns may have any name that doesn't begin with __tm_."""
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    bad = _matches(docs.select(F.struct(one.alias("__tm_1"), two.alias("__tm_2")).alias("doc_id"), "text"), benchmark.select("item_id", "text"))
    # written, so that its size is known when Spark chooses how to join
    bad = written(bad.select("doc_id.*").distinct(), "contaminated")
    return docs.withColumns({"__tm_1": one, "__tm_2": two}).join(bad, ["__tm_1", "__tm_2"], "left_anti").select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
