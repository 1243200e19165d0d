"""Suffix-array dedup: removes bytes of strings that also start in an earlier document.

A string counts if it has ``LENGTH`` bytes. Texts are cut into overlapping segments, one
for each run of strings that have the same smallest 20-byte part, so equal strings are
always in segments with the same such part, the anchor. Equal segments are settled by
their documents alone. What differs under one anchor, the edges of repeated passages, is
gathered by anchor; a suffix array of it and the common prefixes of neighbours show
which strings are equal.

A task holds a bounded part of its rows at a time, however many of them repeat: anchors,
texts and strings go through in pieces, and no mark becomes a Python object.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import SLICE_BYTES, give_back, id_and_text, mixed, prepared, shuffle_parts, slices, text_buffer
from volscribe.llm.suffix_array import Segments, common_prefixes, suffix_array
from volscribe.llm.words import raised, random_bytes
from volscribe.session import broadcast_if_small, measured_bytes, written

LENGTH, PART = 50, 20
# More different segments than these under one anchor do not meet in one task; their
# strings are dealt out one by one, which moves about ten times the bytes.
CROWD = 2_000
_SLICE = 4 << 20
# Text bytes whose segments meet in one bucket, if the shuffle partitions are fewer.
_BUCKET_BYTES = 20 << 20
# What a task holds as arrays at a time, one anchor or document at least: segments whose
# anchors repeat, strings of crowds, bytes to compare; and the rows it sends on at once.
_TOGETHER, _STRINGS, _COMPARED, _ROWS = 300_000, 200_000, 1 << 20, 1 << 15
# Bytes of such a row beside its segment.
_ROW_BYTES = 41
_LOWEST = -(2**63)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, strings, anchor, content, check of each segment.

    ``start`` counts from the text's start; ``strings`` is how many strings of LENGTH
    bytes the segment has. ``anchor``, ``content`` and ``check`` are hashes: of the
    smallest part, of the bytes, and of the hashes of all parts, which tells segments
    apart whose bytes happen to have one hash.
    """
    span = LENGTH - PART + 1
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    powers, inverses = raised(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(random_bytes(data) * powers[: len(data)])]
        least = mixed((total[PART:] - total[:-PART]) * inverses[: len(data) - PART + 1])
        parts = np.r_[np.uint64(0), np.cumsum(least * powers[: len(least)])]
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]] | edge[: len(least)])
        text = np.searchsorted(at, first, side="right") - 1
        last = np.minimum(np.r_[first[1:], len(least)], at[text + 1] - LENGTH + 1)
        keep = last > first
        first, last, text = first[keep], last[keep], text[keep]
        content = mixed((total[last + LENGTH - 1] - total[first]) * inverses[first])
        check = mixed((parts[last + LENGTH - PART] - parts[first]) * inverses[first])
    return text, first - at[text], last - first, least[first], content, check


# A segment is named by 128 bits beside its bucket: anchor, content and check.
_HASH_BYTES = (4, 8, 4)
# Packed bytes of a segment without and with them.
_PLACE_BYTES = 8 + 8 + 4 + 2


def _packed(doc: np.ndarray, version: np.ndarray, start: np.ndarray, strings: np.ndarray, *hashes: np.ndarray) -> bytes:
    """Columns one after the other; documents, versions and starts as differences, which compress well.

    Of the hashes, if any, the anchor keeps 4 bytes beside its bucket, and the content 8 and 4.
    """
    columns = [np.diff(c, prepend=0).astype("<i8") for c in (doc, version)]
    columns += [np.diff(start, prepend=0).astype("<i4"), strings.astype("<u2")]
    columns += [h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size] for h, size in zip(hashes, _HASH_BYTES, strict=False)]
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(stored: memoryview, n: int, keep: np.ndarray | None = None) -> list[np.ndarray]:
    """Columns of ``n`` packed segments; with ``keep``, of those rows only and with their hashes."""
    kinds = ("<i8", "<i8", "<i4", "<u2", *(f"<u{size}" for size in _HASH_BYTES if keep is not None))
    out, low = [], 0
    for k, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize * n
        column = np.frombuffer(stored[low : low + size], kind)
        column = np.cumsum(column, dtype=np.int64) if k < 3 else column
        out.append(column if keep is None else column[keep])
        low += size
    return out


def _anchors(stored: memoryview, n: int) -> np.ndarray:
    low = _PLACE_BYTES * n
    return np.frombuffer(stored[low : low + _HASH_BYTES[0] * n], f"<u{_HASH_BYTES[0]}")


def _first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    new[:1] = True
    return new


def _leaders(order: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group; rows come in ``order``, sorted by keys and document."""
    new = _first_of_groups(*(k[order] for k in keys))
    return doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]


def _segments_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Segments of all texts, which are hashed some at a time."""
    found, before = [], 0
    for some in slices([pa.RecordBatch.from_arrays([texts], ["text"])], SLICE_BYTES):
        text, *columns = segments(*text_buffer(some.column("text")))
        found.append((text + before, *columns))
        before += some.num_rows
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


MARKS = "doc_id bigint, version bigint, start bigint, strings bigint, anchor bigint, crowd boolean"
# anchor is null for what is settled: strings to remove. Else the segment is to be compared.
_MARK_TYPES = dict.fromkeys(("doc_id", "version", "start", "strings", "anchor"), pa.int64()) | {"crowd": pa.bool_()}
_LONGEST = 2**16 - 1


def _dealt(buckets: int):
    """Segments of a slice, packed by bucket of their anchors; copies within the slice are settled at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, _SLICE):
            ids, versions = (part.column(c).to_numpy() for c in ("doc_id", "version"))
            text, start, strings, anchor, content, check = _segments_of(part.column("text"))
            # Runs of one repeated part can be longer than the packed form can say.
            if len(strings) and strings.max() > _LONGEST:
                text, start, strings, anchor, content, check = _cut(text, start, strings, anchor, content, check)
            doc, version = ids[text], versions[text]
            order = np.lexsort((doc, check, content, anchor))
            settled = np.zeros(len(doc), bool)
            settled[order] = doc[order] > _leaders(order, doc, anchor, content, check)
            bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.lexsort((settled, bucket))
            edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                own = by_bucket[edges[k] : edges[k + 1]]
                if len(own):
                    o, d = np.sort(own[~settled[own]]), np.sort(own[settled[own]])
                    opened = _packed(doc[o], version[o], start[o], strings[o], anchor[o], content[o], check[o])
                    done = _packed(doc[d], version[d], start[d], strings[d])
                    out.append((k, len(o), len(d), press.compress(opened + done)))
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["bucket", "open", "settled", "stored"])

    return rows


def _cut(text, start, strings, anchor, content, check):
    """Segments of at most _LONGEST strings; a piece's content is named by its place and the whole's."""
    pieces = -(-strings // _LONGEST)
    which = np.repeat(np.arange(len(text)), pieces)
    place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(strings[which] - place * _LONGEST, _LONGEST)
    names = [np.where(pieces[which] > 1, mixed(h[which] + place.astype(np.uint64)), h[which]) for h in (content, check)]
    return text[which], start[which] + place * _LONGEST, size, anchor[which], *names


def _settled(crowd: int):
    """Marks of one bucket: strings to remove, and segments to compare because others differ under their anchor."""

    def marks(group: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        bucket = group.column("bucket")[0].as_py()
        anchors, done = [], []
        for n, stored, m in _blocks(group):
            anchors.append(_anchors(stored, n))
            done.append(_unpacked(stored[(_PLACE_BYTES + sum(_HASH_BYTES)) * n :], m))
            if sum(len(c[0]) for c in done) >= _ROWS:
                out += _mark_rows([np.concatenate(c) for c in zip(*done, strict=True)])
                done = []
        if done:
            out += _mark_rows([np.concatenate(c) for c in zip(*done, strict=True)])
        for wanted, rows in _anchor_ranges(anchors):
            columns = _of_anchors(group, wanted, rows)
            order = np.lexsort((columns[0], *columns[:3:-1]))
            doc, version, start, strings, anchor, content, check = (c[order] for c in columns)
            del columns, order
            copies = doc > _leaders(np.arange(len(doc)), doc, anchor, content, check)
            # Contents and documents under each anchor.
            new = _first_of_groups(anchor)
            group_of = np.cumsum(new) - 1
            contents = np.bincount(group_of, _first_of_groups(anchor, content, check))
            first = np.flatnonzero(new)
            several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            compare = ~copies & ((contents > 1) & several)[group_of]
            out += _mark_rows([doc[copies], version[copies], start[copies], strings[copies]])
            places = [doc[compare], version[compare], start[compare], strings[compare]]
            out += _mark_rows([*places, (np.int64(bucket) << 32) + anchor[compare].astype(np.int64), (contents > crowd)[group_of][compare]])
        give_back()
        return pa.Table.from_batches(out, pa.schema(list(_MARK_TYPES.items())))

    return marks


def _blocks(group: pa.Table) -> Iterator[tuple[int, memoryview, int]]:
    """Number of open segments, the packed bytes and the number of settled ones of each slice, one slice at a time."""
    unpress = zstandard.ZstdDecompressor()
    for n, m, stored in zip(*(group.column(c) for c in ("open", "settled", "stored")), strict=True):
        yield n.as_py(), memoryview(unpress.decompress(stored.as_buffer())), m.as_py()


def _runs_of(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of rows of about ``limit`` in sum, one row at least."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit, prepend=-1))
    yield from map(slice, cuts, [*cuts[1:], len(sizes)])


def _anchor_ranges(anchors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """Anchors that repeat, in runs that have about _TOGETHER segments, and their number of segments."""
    ordered = np.concatenate(anchors)
    anchors.clear()
    ordered.sort()
    first = np.flatnonzero(_first_of_groups(ordered))
    counts = np.diff(np.r_[first, len(ordered)])
    repeated, counts = ordered[first[counts > 1]], counts[counts > 1]
    del ordered, first
    for run in _runs_of(counts, _TOGETHER):
        yield repeated[run], int(counts[run].sum())


def _of_anchors(group: pa.Table, wanted: np.ndarray, rows: int) -> list[np.ndarray]:
    """The columns of the ``rows`` open segments of a bucket that have one of the anchors ``wanted``, which are sorted."""
    kinds = (np.int64, np.int64, np.int64, np.uint16, np.uint32, np.uint64, np.uint32)
    out, low = [np.empty(rows, kind) for kind in kinds], 0
    for n, stored, _ in _blocks(group):
        anchors = _anchors(stored, n)
        near = np.flatnonzero((anchors >= wanted[0]) & (anchors <= wanted[-1]))
        keep = near[wanted[np.searchsorted(wanted, anchors[near])] == anchors[near]]
        for column, some in zip(out, _unpacked(stored, n, keep), strict=True):
            column[low : low + len(keep)] = some
        low += len(keep)
    return out


def _mark_rows(columns: list[np.ndarray]) -> list[pa.RecordBatch]:
    """Marks of places, with anchors and crowds or without, that settles them."""
    out = []
    for low in range(0, len(columns[0]), _ROWS):
        some = [c[low : low + _ROWS] for c in columns]
        some += [None] * (len(_MARK_TYPES) - len(some))
        arrays = [pa.nulls(len(some[0]), kind) if c is None else pa.array(c, kind) for c, kind in zip(some, _MARK_TYPES.values(), strict=True)]
        out.append(pa.RecordBatch.from_arrays(arrays, list(_MARK_TYPES)))
    return out


def _with_texts(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """``docs``, whose texts move compressed, with the rows of ``by_doc`` (of, of_version, ...) for their doc_id and version."""

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, _SLICE):
            packed = [press.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            columns = [part.column("doc_id"), part.column("version"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "packed"])

    packed = docs.mapInArrow(pressed, "doc_id bigint, version bigint, packed binary")
    same = (F.col("doc_id") == F.col("of")) & (F.col("version") == F.col("of_version"))
    return packed.join(by_doc, same, how).drop("of", "of_version")


# A segment to compare, one string of a crowd to compare, or strings of a crowd to remove.
_SEGMENT, _STRING, _REMOVE = range(3)
CUT = "anchor bigint, doc_id bigint, version bigint, start bigint, strings bigint, kind tinyint, segment binary"


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about _SLICE bytes of text, the bytes of their texts, and where each text starts, with the end last."""
    unpress = zstandard.ZstdDecompressor()
    low, texts, size = 0, [], 0
    for k, packed in enumerate(batch.column("packed")):
        texts.append(unpress.decompress(packed.as_buffer()))
        size += len(texts[-1])
        if size >= _SLICE or k + 1 == batch.num_rows:
            at = np.cumsum([0, *map(len, texts)])
            data = np.frombuffer(b"".join(texts), np.uint8)
            texts = []
            yield batch.slice(low, k + 1 - low), data, at
            low, size = k + 1, 0


def _listed(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """The row of each struct in the lists of ``column``, and the structs' fields; a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _string_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each string that starts in ``data`` at ``at``."""
    windows, out = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.empty(len(at), np.uint64)
    for low in range(0, len(at), _ROWS):
        some = windows[at[low : low + _ROWS]]
        words = np.zeros((len(some), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = some
        name = np.zeros(len(some), np.uint64)
        for word in words.view("<u8").T:
            with np.errstate(over="ignore"):
                name = mixed(name * np.uint64(3) + word)
        out[low : low + _ROWS] = name
    return out


def _later_strings(data: np.ndarray, at: np.ndarray, doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which strings are equal to one of a smaller document here; of different ones with one name, some are left out."""
    windows, later = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.zeros(len(at), bool)
    order = np.lexsort((doc, name))
    new = _first_of_groups(name[order])
    least = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    after = doc[order] > doc[least]
    order, least = order[after], least[after]
    for low in range(0, len(order), _ROWS):
        some = slice(low, low + _ROWS)
        later[order[some]] = (windows[at[order[some]]] == windows[at[least[some]]]).all(axis=1)
    return later


def _runs(yes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and end; no run reaches beyond one of the places ``begins``."""
    edge = np.zeros(len(yes) + 1, bool)
    edge[begins], edge[-1] = True, True
    opens = np.flatnonzero(yes & (edge[:-1] | ~np.r_[False, yes[:-1]]))
    return opens, np.flatnonzero(yes & (edge[1:] | ~np.r_[yes[1:], False])) + 1


def _cut_rows(anchor, doc, version, start, strings, kind: int, segment: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(c.astype(np.int64, copy=False)) for c in (anchor, doc, version, start, strings)]
    arrays += [pa.array(np.full(len(doc), kind, np.int8)), segment]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "version", "start", "strings", "kind", "segment"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments to compare; in a crowd, each string by itself.

    Of a crowd's equal strings among about _STRINGS only the smallest document's go on; the
    others are to be removed and pass without bytes.
    """
    for batch in batches:
        for part, data, at in _opened(batch):
            ids, versions = (part.column(c).to_numpy() for c in ("doc_id", "version"))
            row, start, strings, anchor, crowd = _listed(part.column("wanted"), "start", "strings", "anchor", "crowd")
            whole = np.flatnonzero(~crowd)
            for some in _runs_of(strings[whole] + LENGTH - 1, SLICE_BYTES):
                own = whole[some]
                lengths = strings[own] + LENGTH - 1
                ends = np.cumsum(lengths)
                place = np.repeat(at[row[own]] + start[own] - ends + lengths, lengths) + np.arange(ends[-1])
                segment = _binary(data[place], lengths)
                yield _cut_rows(anchor[own], ids[row[own]], versions[row[own]], start[own], strings[own], _SEGMENT, segment)
            whole = np.flatnonzero(crowd)
            for some in _runs_of(strings[whole], _STRINGS):
                yield from _cut_strings(data, at, ids, versions, *(c[whole[some]] for c in (row, start, strings)))
    give_back()


def _cut_strings(data, at, ids, versions, row, start, strings) -> Iterator[pa.RecordBatch]:
    """The strings of a crowd's segments, some of which are to be removed at once."""
    begins = np.cumsum(strings) - strings
    row = np.repeat(row, strings)
    start = np.repeat(start - begins, strings) + np.arange(len(row))
    place, doc, version = at[row] + start, ids[row], versions[row]
    name = _string_names(data, place)
    later = _later_strings(data, place, doc, name)
    opens, closes = _runs(later, begins)
    doc_of, start_of = doc[opens], start[opens]
    if len(opens):
        yield _cut_rows(doc_of + start_of, doc_of, version[opens], start_of, closes - opens, _REMOVE, _binary(data[:0], 0 * opens))
    left = np.flatnonzero(~later)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for low in range(0, len(left), _ROWS):
        own = left[low : low + _ROWS]
        ones = np.ones(len(own), np.int64)
        yield _cut_rows(name[own].view(np.int64), doc[own], version[own], start[own], ones, _STRING, _binary(windows[place[own]].ravel(), LENGTH * ones))


def _distinct(found: list[bytes], doc: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different ones of ``found``, which of them each is, and the smallest document of each."""
    distinct = {s: k for k, s in enumerate(dict.fromkeys(found))}
    which = np.array([distinct[s] for s in found], np.int64)
    least = np.full(len(distinct), 2**63 - 1)
    np.minimum.at(least, which, doc)
    return list(distinct), which, least


def repeated_strings(found: list[bytes], doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, version, start and number of the strings in a row that also start in a segment of a smaller document."""
    distinct, which, least = _distinct(found, doc)
    text = Segments(distinct)
    order = suffix_array(text, LENGTH)
    prefixes = common_prefixes(text, order, LENGTH)
    group = np.cumsum(prefixes < LENGTH) - 1 if len(order) else np.empty(0, np.int64)
    group -= group[0] if len(group) else 0
    smallest = np.full(int(group[-1]) + 1 if len(group) else 0, 2**63 - 1)
    np.minimum.at(smallest, group, least[text.segment[order]])
    # The smallest document for the string at each place of the distinct segments.
    at_place = np.full(len(text.symbols), 2**63 - 1)
    at_place[order] = smallest[group]
    # All strings of all found segments, one after the other.
    low = text.first[which]
    strings = text.left[low] - LENGTH + 1 if len(low) else low
    ends = np.cumsum(strings)
    begins = ends - strings
    segment = np.repeat(np.arange(len(which)), strings)
    later = at_place[np.arange(len(segment)) + (low - begins)[segment]] < doc[segment]
    opens, closes = _runs(later, begins)
    own = segment[opens]
    return doc[own], version[own], start[own] + opens - begins[own], closes - opens


def _compare(group: pa.Table) -> pa.Table:
    def rows(kind: int) -> tuple[list[bytes], list[np.ndarray]]:
        own = group.filter(pc.equal(group.column("kind"), kind))
        return own.column("segment").to_pylist(), [own.column(c).to_numpy() for c in ("doc_id", "version", "start", "strings")]

    segments_found, places = rows(_SEGMENT)
    compared = repeated_strings(segments_found, *places[:3])
    # Strings by themselves have no suffix of LENGTH bytes but the whole, so they are equal or not.
    found, places = rows(_STRING)
    _, which, least = _distinct(found, places[0])
    later = [c[places[0] > least[which]] for c in places]
    parts = zip(compared, later, rows(_REMOVE)[1], strict=True)
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in parts], names=["doc_id", "version", "start", "strings"])


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by anchor, in pieces of about _COMPARED bytes that hold all rows of their anchors."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        before = np.r_[0, np.cumsum(pc.binary_length(batch.column("segment")).to_numpy() + _ROW_BYTES, dtype=np.int64)]
        edges, low = np.flatnonzero(np.r_[anchor[0] != last, anchor[1:] != anchor[:-1]]), 0
        while (k := np.searchsorted(before[edges], before[low] + _COMPARED - size)) < len(edges):
            yield pa.Table.from_batches([*held, batch.slice(low, edges[k] - low)])
            held, size, low = [], 0, int(edges[k])
        held.append(batch.slice(low))
        size, last = size + int(before[-1] - before[low]), anchor[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _by_anchor(batches):
        yield from _compare(piece).to_batches(_ROWS)
    give_back()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in _opened(batch):
            row, low, strings = _listed(part.column("marks"), "start", "strings")
            order = np.lexsort((low, row))
            row, low = row[order], low[order] + at[row[order]]
            reach = np.maximum.accumulate(low + strings[order] + LENGTH - 1)
            # Marks that touch are one span, but not across texts.
            new = np.flatnonzero(_first_of_groups(row) | (low > np.r_[-1, reach[:-1]][: len(low)]))
            row, low, high = row[new], low[new], reach[np.r_[new[1:], len(reach)][: len(new)] - 1]
            edge = np.zeros(len(data) + 1, np.int8)
            edge[low] += 1
            edge[high] -= 1
            sizes = np.diff(at)
            gone = np.bincount(row, high - low, len(sizes)).astype(np.int64)
            kept = _binary(data[np.cumsum(edge[:-1], dtype=np.int8) == 0], sizes - gone)
            ends = np.column_stack((low - at[row], high - at[row])).ravel()
            pairs = pa.ListArray.from_arrays(np.arange(0, len(ends) + 1, 2, np.int32), pa.array(ends, pa.int64()))
            spans = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32), pairs)
            ids = part.column("doc_id").to_numpy()
            columns = [pa.array(ids, mask=ids == _LOWEST), pa.array(sizes), pa.array(gone), spans, kept]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    give_back()


def _versioned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``version``, a hash of the text where rows share a doc_id, and 0 elsewhere, which packs to nothing."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("shared id"))
    ids = written(ids, "shared_ids")
    if ids.isEmpty():
        return docs.withColumn("version", F.lit(0).cast("bigint"))
    both = docs.join(broadcast_if_small(ids), F.col("doc_id") == F.col("shared id"), "left")
    return both.select("doc_id", "text", F.when(F.col("shared id").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("version"))


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end) and kept bytes of every row of ``docs`` (doc_id, text).

    A null text is empty; texts under LENGTH bytes lose nothing. A null doc_id counts as
    smaller than all others. Rows that share a doc_id, null or not, may have different
    texts; none of them removes anything from another, and each is cut by its own text's
    marks. Strings never reach across documents, and are
    judged on the input. Other columns are not read. An empty table gives no rows. More
    than ``crowd`` different segments under one anchor are compared string by string.
    """
    # A task of the JVM and of Python each hold such a batch or two.
    prepared(docs.sparkSession, _SLICE)
    docs = id_and_text(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)))
    buckets = max(shuffle_parts(docs), measured_bytes(docs.select("text")) // _BUCKET_BYTES)
    docs = _versioned(docs)
    dealt = docs.mapInArrow(_dealt(buckets), "bucket bigint, open bigint, settled bigint, stored binary")
    marks = written(dealt.groupBy("bucket").applyInArrow(_settled(crowd), MARKS), "marks")
    wanted = marks.where("anchor is not null").groupBy(F.col("doc_id").alias("of"), F.col("version").alias("of_version"))
    wanted = wanted.agg(F.collect_list(F.struct("start", "strings", "anchor", "crowd")).alias("wanted"))
    cut = _with_texts(docs, wanted, "inner").mapInArrow(_cut_out, CUT)
    by_anchor = cut.repartition("anchor").sortWithinPartitions("anchor")
    compared = by_anchor.mapInArrow(_compared, "doc_id bigint, version bigint, start bigint, strings bigint")
    settled = marks.where("anchor is null").select("doc_id", "version", "start", "strings").unionByName(compared)
    by_doc = settled.groupBy(F.col("doc_id").alias("of"), F.col("version").alias("of_version")).agg(F.collect_set(F.struct("start", "strings")).alias("marks"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    return _with_texts(docs, by_doc, "left").mapInArrow(_removed, schema)
