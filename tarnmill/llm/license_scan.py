"""License scans: fuzzy search for short notices by exact seeds and bounded-error verification."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import bound_batches, slices

#: (name, wording). Wordings are compared in ASCII lower case.
NOTICES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("GPL-3.0", "licensed under the gnu general public license, version 3"),
    ("GPL-2.0", "licensed under the gnu general public license, version 2"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license, version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license, version 3"),
    ("MPL-2.0", "subject to the terms of the mozilla public license, version 2.0"),
    ("BSD", "released under the bsd license"),
    ("BSD", "licensed under the bsd 3-clause license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("SPDX", "spdx-license-identifier:"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "confidential and proprietary"),
)
#: One edit is allowed for so many characters of a notice, so that each of the k + 1 seeds has about as many.
CHARS_PER_EDIT = 10

Notices = tuple[tuple[str, str], ...]


def edits_allowed(wording: str) -> int:
    return max(1, len(wording) // CHARS_PER_EDIT)


def seeds(wording: str) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length. By the pigeonhole principle k edits leave one unharmed."""
    k = edits_allowed(wording)
    at = [round(i * len(wording) / (k + 1)) for i in range(k + 2)]
    return [(a, wording[a:b]) for a, b in zip(at, at[1:])]


def lower(text: str) -> str:
    """ASCII lower case, so that positions stay."""
    return text.encode().lower().decode()


#: White space that is no single blank, with the comment marks of a line that begins after it: counts as one blank.
_GAP = regex.compile(r"\s*\n\s*(?:(?:[*#;%!]+|//+|--+|/\*+|<!--)(?=\s)\s*)*|[^\S \n]\s*|\s{2,}")
#: What follows an SPDX tag: names and operators.
_SPDX = regex.compile(r"[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+:\-]*\)*(?: (?:AND|OR|WITH) \(*[A-Za-z0-9][A-Za-z0-9.+:\-]*\)*)*)")


def fold(text: str) -> tuple[str, list[int], list[int]]:
    """(text with each gap as one blank, ends of the gaps in it, characters that had gone by each of them)."""
    parts, ends, gone = [], [], []
    at = size = lost = 0
    for m in _GAP.finditer(text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        lost += m.end() - m.start() - 1
        at = m.end()
        ends.append(size)
        gone.append(lost)
    if not parts:
        return text, ends, gone
    return "".join([*parts, text[at:]]), ends, gone


def unfold(at: int, ends: list[int], gone: list[int]) -> int:
    """Place in the text itself of a place in the folded one."""
    i = bisect.bisect_right(ends, at)
    return at + (gone[i - 1] if i else 0)


@functools.lru_cache(maxsize=4)
def _compiled(notices: Notices) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    where: dict[str, list[tuple[int, int]]] = {}
    for i, (_, wording) in enumerate(notices):
        for offset, piece in seeds(wording):
            where.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, uses in where.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(w)}){{e<={edits_allowed(w)}}}") for _, w in notices]


def candidates(low: str, notices: Notices) -> set[tuple[int, int, int]]:
    """(position of a seed, its notice, where that would begin if there were no edits before the seed)."""
    automaton, _ = _compiled(notices)
    found = set()
    for end, (size, uses) in automaton.iter(low):
        at = end + 1 - size
        found.update((at, i, at - offset) for i, offset in uses)
    return found


def matches(low: str, notices: Notices, found: set[tuple[int, int]], base: int = 0, stop: int | None = None) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of verified candidates in low[base:stop], best first where they overlap: fewest
    edits, then the longer, then the earlier."""
    _, patterns = _compiled(notices)
    stop = len(low) if stop is None else stop
    verified = set()
    for i, at in found:
        wording = notices[i][1]
        k = edits_allowed(wording)
        m = patterns[i].search(low, max(base, at - 2 * k), min(stop, at + len(wording) + 2 * k))
        if m and m.end() > m.start():
            verified.add((i, m.start(), m.end(), sum(m.fuzzy_counts)))
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(verified, key=lambda v: (v[3], v[1] - v[2], v[1], v[0])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda v: v[1])


def scan_texts(texts: list[str | None], notices: Notices = NOTICES) -> list[tuple[int, str, int, int, int, str, str | None]]:
    """(index of the text, name, start, end, edits, the passage, identifier after an SPDX tag)."""
    folded = [fold(t or "") for t in texts]
    joined = "\0".join(f[0] for f in folded)  # no seed holds \0, so none crosses texts
    low = lower(joined)
    starts = [0]
    for f in folded:
        starts.append(starts[-1] + len(f[0]) + 1)
    by_text: dict[int, set[tuple[int, int]]] = {}
    for seed, i, begin in candidates(low, notices):
        by_text.setdefault(bisect.bisect_right(starts, seed) - 1, set()).add((i, begin))
    rows = []
    for owner in sorted(by_text):
        base, text, (flat, ends, gone) = starts[owner], texts[owner], folded[owner]
        for i, a, b, edits in matches(low, notices, by_text[owner], base, base + len(flat)):
            x, y = unfold(a - base, ends, gone), unfold(b - base - 1, ends, gone) + 1
            tag = _SPDX.match(text, y) if notices[i][0] == "SPDX" else None
            rows.append((owner, notices[i][0], x, y, edits, text[x:y], tag[1] if tag else None))
    return rows


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Notices = NOTICES) -> DataFrame:
    """(id, license, start, end, edits, passage, identifier): every stretch of a text that is a notice but for a bounded
    number of edits (one for each 10 characters of the wording), in characters of the text, upper case counted as lower.
    White space of any length counts as one blank, comment marks at the beginning of a line included, so that wrapped
    notices are found; they cost no edits. Where verified stretches overlap, the one with the fewest edits counts, then
    the longer, then the earlier. `identifier` is the expression after an SPDX tag, null for other notices.

    Null or empty text: no rows. Repeated rows: their rows each. Very long texts are searched whole. Empty table:
    empty result. Columns other than the two are not read. No shuffle; texts without a seed cost one automaton pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                rows = scan_texts(texts[a:b].to_pylist(), notices)
                if rows:
                    owner, name, start, end, edits, passage, tag = zip(*rows)
                    yield pa.record_batch([ids[a:b].take(pa.array(owner)), pa.array(name), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()), pa.array(passage), pa.array(tag, pa.string())], names=["k", "license", "start", "end", "edits", "passage", "identifier"])

    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, license string, start long, end long, edits int, passage string, identifier string").withColumnRenamed("k", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
