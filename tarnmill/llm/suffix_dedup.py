"""Suffix-array dedup: longest-previous-factor arrays over what shares an anchor."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import SLICE_WORDS, U64, Words, _power, bound_batches, columns, drop_written, mix, ngram_hashes, pieces, slices, text_of, word_hashes, written

#: A passage of so many words that occurred earlier is removed.
LENGTH = 50
#: Words of an anchor. Of every LENGTH - ANCHOR + 1 consecutive runs of ANCHOR words the least by hash is an anchor,
#: so two equal passages of LENGTH words hold the same anchor at the same place.
ANCHOR = 20
REACH = LENGTH - ANCHOR
_LAST = np.int64(2**63 - 1)  # stands for a null doc_id: after all others
#: Fragments whose suffixes are sorted together.
FRAGMENTS = 2_048


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of anchors in word hashes; text i is first[i]:first[i + 1], and no anchor or passage crosses texts."""
    n = len(words)
    if n < LENGTH:
        return np.empty(0, np.int64)
    grams = ngram_hashes(words, ANCHOR)
    stop = np.repeat(first[1:], np.diff(first))  # end of the text of each word
    least = sliding(grams, REACH + 1, np.minimum)
    at = np.arange(len(least))
    least = np.where(at + LENGTH <= stop[: len(least)], least, U64(0))  # passages that cross texts count for nothing
    padded = np.concatenate([np.zeros(REACH, U64), least, np.zeros(REACH, U64)])
    greatest = sliding(padded, REACH + 1, np.maximum)  # over the passages that hold the run
    return np.flatnonzero((greatest[: len(grams)] == grams) & (grams != 0))


def _span_hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64))


def _word_slices(n: int, texts: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that are handled at once: all words of several texts, SLICE_WORDS of one."""
    step = SLICE_WORDS if texts == 1 else max(n, 1)
    for at in range(0, n, step):
        yield at, min(at + step, n)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An anchor row for the first of equal fragments of each text; a span (anchor null) for the later ones."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            all_h, all_first = word_hashes(batch.column(2)[lo:hi])
            seen = np.empty(0, U64)  # fragments of earlier stretches of the one text
            for w0, w1 in _word_slices(len(all_h), hi - lo):
                # a stretch with what anchors in it need on both sides
                c0, c1 = max(0, w0 - LENGTH - REACH), min(len(all_h), w1 + LENGTH + REACH)
                h, first = all_h[c0:c1], np.clip(all_first - c0, 0, c1 - c0)
                at = anchors(h, first)
                at = at[(at >= w0 - c0) & (at < w1 - c0)]
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, "right") - 1
                begin, end = first[doc], first[doc + 1]
                a, b = np.maximum(at - REACH, begin), np.minimum(at + LENGTH, end)
                power, inverse = _power(len(h))
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(h) + 1, U64)
                    np.cumsum(h * power[: len(h)], dtype=U64, out=sums[1:])
                    fragment = mix(_span_hash(sums, inverse, a, b) + (at - a).astype(U64))
                anchor = _span_hash(sums, inverse, at, at + ANCHOR)
                order = np.lexsort((at, fragment, doc))
                again = np.zeros(len(at), bool)
                x, y = order[1:], order[:-1]
                again[x] = (fragment[x] == fragment[y]) & (doc[x] == doc[y])
                if hi - lo == 1 and len(all_h) > w1 - w0:
                    again |= np.isin(fragment, seen)
                    seen = np.union1d(seen, fragment)
                new = ~again
                d = batch.column(0)[lo:hi].to_numpy()[doc]
                key = batch.column(1)[lo:hi].to_numpy()[doc]
                origin = begin - (c0 if hi - lo == 1 else 0)  # places count from the first word of the text
                yield pa.record_batch(
                    [pa.array(anchor[new].view(np.int64)), pa.array(fragment[new].view(np.int64)), pa.array(d[new]), pa.array(key[new]), pa.array((at - origin)[new].astype(np.int32)), pa.array((at - a)[new].astype(np.int32)), pa.array((b - at)[new].astype(np.int32))],
                    names=_ANCHOR_NAMES,
                )
                if again.any():
                    d, key, a, b = merge_spans(d[again], key[again], (a - origin)[again], (b - origin)[again])
                    n = len(d)
                    yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(d), pa.array(key), pa.array(a.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array((b - a).astype(np.int32))], names=_ANCHOR_NAMES)


_ANCHOR_NAMES = ["anchor", "fragment", "d", "h", "at", "left", "right"]
_ANCHOR_ROWS = "anchor long, fragment long, d long, h long, at int, left int, right int"
_FOUND = "kind int, d long, h long, x long, y long, z long"
_NAMES = ["kind", "d", "h", "x", "y", "z"]


def merge_spans(d: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching [a, b) of each document united."""
    order = np.lexsort((a, h, d))
    d, h, a, b = d[order], h[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(d):
        return d, h, a, b
    new_doc = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))
    # one running maximum for all: each document's numbers lie above the last one's
    base = (np.cumsum(new_doc) - 1) * (b.max() + 1)
    reach = np.maximum.accumulate(b + base)
    start = np.append(True, (a + base)[1:] > reach[:-1])
    first = np.flatnonzero(start)
    return d[first], h[first], a[first], (np.append(reach[first[1:] - 1], reach[-1]) - base[first])


def _found(kind: int, d: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> pa.RecordBatch:
    z = np.zeros(len(d), np.int64) if z is None else z
    return pa.record_batch([pa.array(np.full(len(d), kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in (d, h, x, y, z))], names=_NAMES)


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, fragment, d, h, at): a span for all but the first of equal fragments (kind 0), and
    the first ones of an anchor that has several fragments (kind 1: place, anchor, block), whose words have to be
    compared. The fragments of an anchor are dealt into blocks of FRAGMENTS; block -1 says that there is one only.

    Rows stream through: what is kept is the first row of a fragment that goes on, and up to FRAGMENTS rows of an
    anchor that goes on."""
    last: tuple | None = None
    held = [np.empty(0, np.int64)] * 4
    before = 0  # fragments of the anchor that goes on which have left
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            anchor, fragment, d, h, at, left, right = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.append(last is None or (anchor[0], fragment[0]) != last[:2], (anchor[1:] != anchor[:-1]) | (fragment[1:] != fragment[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            of = [np.where(first >= 0, c[first], 0 if last is None else last[2 + i]) for i, c in enumerate((d, h, at))]
            later = ~new & ((d != of[0]) | (h != of[1]) | (at != of[2]))
            if later.any():
                yield _found(0, *merge_spans(d[later], h[later], (at - left)[later], (at + right)[later]))
            last = (anchor[-1], fragment[-1], of[0][-1], of[1][-1], of[2][-1])
            held = [np.concatenate([x, y[new].astype(np.int64)]) for x, y in zip(held, (anchor, d, h, at))]
        anchor = held[0]
        if not len(anchor):
            continue
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(start, len(anchor)))
        gone = np.zeros(len(start), np.int64)  # of each anchor, the fragments that have left
        if before and anchor[0] == going:
            gone[0] = before
        group = np.repeat(np.arange(len(start)), size)
        rank = np.arange(len(anchor)) - start[group] + gone[group]
        block = np.where((gone + size > FRAGMENTS)[group], rank // FRAGMENTS, -1)
        ready = (gone + size > 1)[group]
        stays = batch is not None and gone[-1] + size[-1] <= FRAGMENTS  # the last anchor may go on
        if stays:
            ready[start[-1] :] = False
        if ready.any():
            yield _found(1, *(c[ready] for c in held[1:]), anchor[ready], block[ready])
        going, before = anchor[-1], 0 if stays else int(gone[-1] + size[-1])
        held = [c[start[-1] :] if stays else c[:0] for c in held]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, block, d, h, fragment's first word, words as 32-bit hashes) of the anchors asked for in each text."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            hashes, first = word_hashes(batch.column(2)[lo:hi])
            short = hashes.astype(np.uint32)
            asked = batch.column(3)[lo:hi]
            count = np.diff(np.frombuffer(asked.buffers()[1], np.int32)[asked.offset : asked.offset + len(asked) + 1])
            flat = asked.flatten()
            anchor, at, block = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy()
            row = np.repeat(np.arange(hi - lo), count)
            begin, end = first[row], first[row + 1]
            a, b = np.maximum(begin + at - REACH, begin), np.minimum(begin + at + LENGTH, end)
            d, h = batch.column(0)[lo:hi].to_numpy()[row], batch.column(1)[lo:hi].to_numpy()[row]
            for i in range(0, len(at), FRAGMENTS):
                s = slice(i, i + FRAGMENTS)
                offsets = np.concatenate([[0], np.cumsum((b - a)[s])])
                index = np.arange(offsets[-1]) + np.repeat(a[s] - offsets[:-1], (b - a)[s])
                data = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short[index]))])
                yield pa.record_batch([pa.array(anchor[s]), pa.array(block[s]), pa.array(d[s]), pa.array(h[s]), pa.array((a - begin)[s]), data], names=["anchor", "block", "d", "h", "a", "words"])


def suffix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """[(length, rank)] by prefix doubling up to `depth`: rank[i] orders the suffixes of text by their first `length`
    symbols. What runs past the end counts as before everything."""
    _, rank = np.unique(text, return_inverse=True)
    levels = [(1, rank.astype(np.int64) + 1)]
    while levels[-1][0] < depth:
        length, rank = levels[-1]
        step = min(length, depth - length)
        beyond = np.zeros(len(rank), np.int64)
        beyond[: len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (len(rank) + 2) + beyond, return_inverse=True)
        levels.append((length + step, rank.astype(np.int64) + 1))
    return levels


def longest_previous_factors(text: np.ndarray, where: np.ndarray, depth: int) -> np.ndarray:
    """LPF[i]: length, up to `depth`, of the longest prefix of suffix i that also begins at a lesser `where`.

    In suffix order the best earlier match of i is its previous or next suffix of lesser `where` (PSV, NSV); both are
    found for all i at once by jumping over greater ones along the neighbours' own jumps, with the least LCP on the
    way. `where` may repeat: occurrences at one place are no earlier match of each other."""
    n = len(text)
    levels = suffix_ranks(text, depth)
    order = np.argsort(levels[-1][1], kind="stable")
    place = where[order]
    # LCP of neighbours in suffix order, from the longest level down
    x, y = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    full = levels[-1][1][x] == levels[-1][1][y]
    lcp[full] = depth
    left = np.flatnonzero(~full)
    i, j, got = x[left], y[left], np.zeros(len(left), np.int64)
    powers = [1 << k for k in range(len(levels)) if (1 << k) <= depth]
    by_length = dict(levels)
    for length in reversed([p for p in powers if p in by_length]):
        rank = np.append(by_length[length], 0)
        same = (np.minimum(i, j) + length <= n) & (np.maximum(i, j) + length <= n) & (rank[np.minimum(i, n)] == rank[np.minimum(j, n)])
        got += same * length
        i, j = i + same * length, j + same * length
    lcp[left] = np.minimum(got, depth)
    best = np.zeros(n, np.int64)
    for place_, lcp_, index in ((place, lcp, order), (place[::-1], lcp[::-1], order[::-1])):
        to = np.arange(-1, n - 1)
        reach = np.append(0, lcp_)  # least LCP between a suffix and where it points
        active = np.arange(n)
        while len(active):
            via = to[active]
            on = (via >= 0) & (reach[active] > 0)
            active, via = active[on], via[on]
            on = place_[via] >= place_[active]  # the others have found theirs
            active, via = active[on], via[on]
            reach[active] = np.minimum(reach[active], reach[via])
            to[active] = to[via]
        best[index] = np.maximum(best[index], np.where(to >= 0, reach, 0))
    return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by (anchor, block): some FRAGMENTS rows, cut between blocks only. A block has FRAGMENTS
    rows at most."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            for i in range(0, batch.num_rows, FRAGMENTS):
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.slice(i, FRAGMENTS).columns])
                rows += len(held[-1][0])
                if rows < FRAGMENTS:
                    continue
                columns = [np.concatenate(c) for c in zip(*held)]
                held = [columns]
                change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
                if len(change):
                    cut = int(change[-1])
                    yield [c[:cut] for c in columns]
                    held = [[c[cut:] for c in columns]]
                    rows -= cut
        elif rows:
            yield [np.concatenate(c) for c in zip(*held)]


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated passages (kind 0) from fragments sorted by (anchor, block, d, h): one suffix array over some
    blocks, in which only suffixes of one block share symbols, since the block's number is a part of every symbol. Of
    an anchor with several blocks, every whole passage that is no repeat in its block (kind 2: place and a hash of anchor
    and passage), to be met by those of the other blocks."""
    for anchor, block, d, h, a, words in _blocks(batches):
        size = np.array([len(w) for w in words]) // 4
        symbols = np.frombuffer(b"".join(words), np.uint32).astype(U64)
        group = np.cumsum(np.append(False, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])))
        owner = np.repeat(np.arange(len(anchor)), size)
        start = np.cumsum(size) - size
        word = np.arange(len(symbols)) - start[owner] + a[owner]
        # a separator of its own after each fragment, so that no match runs into the next
        full = np.empty(len(symbols) + len(anchor), U64)
        at = np.arange(len(symbols)) + owner
        full[at] = (group[owner].astype(U64) << U64(32)) | symbols
        full[start + size + np.arange(len(anchor))] = (U64(1) << U64(63)) | np.arange(len(anchor)).astype(U64)
        # order of places: (d, h, word); the same word of one document is one place, in however many fragments
        place = np.lexsort((word, h[owner], d[owner]))
        dd, hh, ww = d[owner][place], h[owner][place], word[place]
        dense = np.empty(len(symbols), np.int64)
        dense[place] = np.cumsum(np.append(False, (dd[1:] != dd[:-1]) | (hh[1:] != hh[:-1]) | (ww[1:] != ww[:-1])))
        where = np.full(len(full), np.iinfo(np.int64).max)
        where[at] = dense
        lpf = longest_previous_factors(full, where, LENGTH)[at]
        hit = np.flatnonzero(lpf >= LENGTH)
        if len(hit):
            yield _found(0, *merge_spans(d[owner][hit], h[owner][hit], word[hit], word[hit] + lpf[hit]))
        if (block >= 0).any():
            passages = ngram_hashes(symbols, LENGTH)
            n = len(passages)
            own = np.flatnonzero((owner[:n] == owner[LENGTH - 1 :]) & (block[owner[:n]] >= 0) & (lpf[:n] < LENGTH))
            with np.errstate(over="ignore"):
                key = mix(passages[own] + anchor[owner[own]].view(U64))
            yield _found(2, d[owner[own]], h[owner[own]], word[own], key.view(np.int64))


def _place(docs: DataFrame) -> Column:
    """The number by which documents are ordered."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(number, F.lit(int(_LAST)))


def _spans(docs: DataFrame) -> DataFrame:
    """(d, h, start, end), merged."""
    bound_batches(docs.sparkSession)
    rows = docs.select(_place(docs).alias("d"), F.xxhash64("text").alias("h"), F.col("text").alias("t")).where("t is not null")
    found = written(rows.mapInArrow(_anchor_rows, _ANCHOR_ROWS), "anchors")
    own = found.where("anchor is null").select("d", "h", F.col("at").cast("long").alias("x"), (F.col("at") + F.col("right")).cast("long").alias("y"))
    sort = ["anchor", "fragment", "d", "h", "at"]
    shared = found.where("anchor is not null").repartition("anchor").sortWithinPartitions(*sort).mapInArrow(_share, _FOUND)
    shared = written(shared, "shared")
    asked = shared.where("kind = 1").groupBy("d", "h").agg(F.collect_list(F.struct(F.col("y").alias("anchor"), F.col("x").alias("at"), F.col("z").alias("block"))).alias("asked"))
    fragments = rows.join(asked.hint("shuffle_hash"), ["d", "h"]).select("d", "h", "t", "asked").mapInArrow(_fragments, "anchor long, block long, d long, h long, a long, words binary")
    factors = written(fragments.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "d", "h").mapInArrow(_factors, _FOUND), "factors")
    # passages of different blocks of one anchor: all but the first occurrence
    place = F.struct("d", "h", "x")
    met = factors.where("kind = 2").withColumn("first", F.first(place).over(Window.partitionBy("y").orderBy("d", "h", "x")))
    across = met.where(F.col("first") != place).select("d", "h", "x", (F.col("x") + LENGTH).alias("y"))
    spans = shared.where("kind = 0").select("d", "h", "x", "y").unionByName(own).unionByName(factors.where("kind = 0").select("d", "h", "x", "y")).unionByName(across)
    ordered = Window.partitionBy("d", "h").orderBy("x", "y")
    before = F.max("y").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(before >= F.col("x"), 0).otherwise(1)).withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("d", "h", "run").agg(F.min("x").alias("start"), F.max("y").alias("end")).drop("run")
    out = written(merged, "spans")
    drop_written(found, shared, factors)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): the words [start, end) of each document that are covered by passages of at
    least 50 words which also begin earlier, in an earlier document or in the same one. Documents come in order of
    doc_id, null last, then of a hash of the text; words are runs without ASCII white space, compared byte by byte.
    The first occurrence of a passage stays.

    A document of equal text under another id is a later copy; rows of equal id and text are one document. Null,
    empty and shorter texts: no rows. Very long texts are handled whole, in stretches that overlap. Empty table: empty
    result. Other columns are not read. Ids that are no whole numbers come in the order of their xxhash64 instead; the
    id 2^63 - 1 counts as null.

    Two equal passages share an anchor. Rows of anchors, not texts, are shuffled; equal surroundings of an anchor
    need no comparison, and only of the others the words are fetched. The fragments of an anchor are dealt into blocks
    of a bounded size; each block gets a suffix array and longest previous factors, and passages that are new to
    their block are met with those of the anchor's other blocks by hash, so that an anchor of any number of documents
    makes many small tasks. Words are compared by 32 bits of their hashes next to anchors that agree in 64."""
    spans = _spans(docs)
    start, end = F.col("start").alias("start_word"), F.col("end").alias("end_word")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return spans.select(F.when(F.col("d") != int(_LAST), F.col("d")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), start, end)
    ids = docs.select("doc_id", _place(docs).alias("d"), F.xxhash64("text").alias("h")).distinct()
    return spans.join(ids, ["d", "h"]).select("doc_id", start, end)


def _word_offsets(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bytes at which the words of these numbers (ascending) begin; the end of the text for a number beyond the last."""
    out = np.full(len(wanted), len(data))
    count = 0
    for a, b in pieces(data):
        start = Words(text_of(data[a:b])).start
        here = slice(*np.searchsorted(wanted, [count, count + len(start)]))
        out[here] = a + start[wanted[here] - count]
        count += len(start)
    return out


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts, spans):
        if not text.is_valid:
            out.append(None)
            continue
        data = np.frombuffer(text.as_buffer(), np.uint8)
        wanted = np.unique([x for s in own.as_py() for x in (s["start"], s["end"])])
        offset = dict(zip(wanted.tolist(), _word_offsets(data, wanted).tolist()))
        kept, at = [], 0
        for s in sorted(own.as_py(), key=lambda s: s["start"]):
            kept.append(data[at : offset[s["start"]]])
            at = offset[s["end"]]
        kept.append(data[at:])
        out.append(b"".join(kept))
    return pa.array(out, pa.binary()).cast(pa.string())


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the spans of `repeated_spans`: text from the first to before the next word that stays goes, and
    n_chars, if there, is counted anew. A document of which nothing but white space is left goes; all others stay,
    untouched ones (null, empty and blank texts among them) as they are. Rows of equal id and text are cut alike, since
    they are one document. Null ids come last; very long texts are cut whole. Empty table: empty result. Extra
    columns may have any name that doesn't begin with __tm_."""
    spans = _spans(docs).groupBy("d", "h").agg(F.collect_list(F.struct("start", "end")).alias("__tm_spans"))
    spans = spans.withColumnsRenamed({"d": "__tm_d", "h": "__tm_h"})
    keyed = docs.withColumns({"__tm_d": _place(docs), "__tm_h": F.xxhash64("text")})
    # shuffled at every size: texts are moved once, and spans, which grow with them, are never broadcast
    joined = keyed.join(spans.hint("shuffle_hash"), ["__tm_d", "__tm_h"], "left")
    hit = F.col("__tm_spans").isNotNull()
    joined = joined.withColumn("__tm_text", _cut(F.when(hit, F.col("text")), "__tm_spans")).where(~hit | F.col("__tm_text").rlike(r"\S"))
    changed = {"text": F.when(hit, F.col("__tm_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("__tm_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(changed).select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
