"""Exact removal of repeated passages by sorted suffixes.

A string of ``length`` bytes that also starts in a document with a smaller key is removed wherever it
covers a byte. Sorting every suffix of the corpus in one place is out of reach, so the work is cut in
two without loss:

1. *Anchors.* Of the byte grams inside a window of ``length`` bytes the one with the least hash is the
   window's anchor (the first among equals). Equal windows have equal anchors at equal places, so a
   window whose anchor gram occurs in no other document cannot be a repeat. Each part of the corpus
   sends the hashes of its distinct anchors to buckets, which answer with those that occur in more
   than one document.
2. *Suffixes.* Windows with such anchors travel as runs that share their text, dealt by anchor. A run
   whose text several documents of a part have is sent once, by the one with the smallest key; the
   others are repeats already. An anchor that many parts have in ever different runs, such as a line
   that stands in many texts, would fill one bucket. Its windows get anchors of longer grams instead, at
   last of whole windows, and those of anchors that no other document has are left out as in step 1,
   before any text travels. Each bucket sorts the suffixes it has to a depth of ``length`` bytes, deep-shallow: multikey quicksort on eight bytes at a time to a shallow depth, then a blind
   trie for every group that is still together. Suffixes in one leaf are equal; all but those of the
   smallest document are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.batches import documents, parts_for, slices, spread_indices

GRAM = 20
SHALLOW = 24
SLICE = 1 << 20
BUCKETS_PER_PART = 2
#: Planned bytes of a part, which is held whole in a task.
PART_BYTES = 6 << 20
#: Parts in which an anchor occurs, and different runs that each of them has of it on average, beyond which its windows
#: get anchors of longer grams.
HOT_PARTS = 256
HOT_RUNS = 2
NO_KEY = np.int64(2**63 - 1)
LOW = np.uint64(0xFFFFFFFF)

_TABLE = np.random.default_rng(20240229).integers(0, 2**32, 256, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    n %= 32
    return x if not n else (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Cyclic polynomial hash of the ``width`` bytes from each place on, by doubling."""
    cur, size, out, done = _TABLE[raw], 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = cur, size
            else:
                n = len(raw) - done - size + 1
                out, done = _rotate(out[:n], size) ^ cur[done : done + n], done + size
        if size * 2 > width:
            break
        cur, size = _rotate(cur[:-size], size) ^ cur[size:], size * 2
    return out * np.uint32(0x9E3779B1)


def words_at(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number that sorts as they do (raw has 8 bytes to spare)."""
    n = max(0, len(raw) - 7)
    return np.ndarray(n, np.dtype(">u8"), raw.data if raw.flags.c_contiguous else raw.tobytes(), strides=(1,))


def gram_widths(length: int) -> list[int]:
    """Bytes of the anchors of each level; the windows of hot anchors go on to the next one."""
    return [GRAM, (GRAM + length) // 2, length]


def anchor_places(raw: np.ndarray, length: int, width: int) -> np.ndarray:
    """Where the anchor of the window from each place on is."""
    span = length - width + 1
    if span == 1:
        return np.arange(len(raw) - length + 1)
    key = gram_hashes(raw, width).astype(np.uint64) << np.uint64(32)
    key |= np.arange(len(key), dtype=np.uint64)
    p = 1
    while 2 * p <= span:
        key, p = np.minimum(key[:-p], key[p:]), 2 * p
    if span > p:
        key = np.minimum(key[: len(key) - (span - p)], key[span - p :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(raw: np.ndarray, at: np.ndarray, length: int):
    """(anchor place, first start, end start, document) of every run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    anchor = anchor_places(raw, length, GRAM)
    fits = np.zeros(len(anchor) + 1, np.int8)  # windows that lie in one document
    long = np.diff(at) >= length
    np.add.at(fits, at[:-1][long], 1)
    np.add.at(fits, at[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(fits[:-1]))
    return _runs_of(start, anchor, at)


def _runs_of(start: np.ndarray, anchor: np.ndarray, at: np.ndarray):
    if not len(start):
        return start, start, start, start
    here = anchor[start]
    head = np.flatnonzero(np.concatenate([[True], (here[1:] != here[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.append(head[1:], len(start)) - 1
    first = start[head]
    return here[head], first, start[tail] + 1, np.searchsorted(at, first, "right") - 1


def anchor_names(raw: np.ndarray, places: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the anchor gram at each place."""
    if not len(places):
        return np.zeros(0, np.uint64)
    if width != GRAM:
        return _window_hash(raw, places, width)
    words = words_at(raw)
    name = _mix(words[places].astype(np.uint64)) + words[places + 8].astype(np.uint64)
    return _mix(_mix(name) + words[places + GRAM - 8].astype(np.uint64))


# --- sorting ---------------------------------------------------------------------------------


#: A difference of two words is at least the k-th of these if their first unequal byte has k behind it.
_BYTE_STEPS = np.array([1 << 8 * k for k in range(8)], np.uint64)


class _Open:
    """The suffixes that lie in open groups: their places in the order, numbers, and where groups begin."""

    def __init__(self, n: int, owner: np.ndarray | None):
        self.at, self.suffix, self.owner = np.arange(n), np.arange(n), owner
        self.head = np.zeros(n, bool)
        self.head[:1] = True

    def keep(self, members: np.ndarray) -> None:
        self.at, self.suffix, self.head = self.at[members], self.suffix[members], self.head[members]

    def groups(self) -> np.ndarray:
        return np.cumsum(self.head) - 1

    def close(self) -> None:
        """Leave out groups of one suffix and, where owners are known, of one owner."""
        inner = ~self.head
        if self.owner is not None and len(inner):
            mine = self.owner[self.suffix]
            inner[1:] &= mine[1:] != mine[:-1]
        group = self.groups()
        open_ = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        open_[group[inner]] = True
        self.keep(open_[group])

    def sort(self, members: np.ndarray, key: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Sort some whole groups by keys that begin with the group's number; returns the permutation."""
        by = np.argsort(key)
        key = key[by]
        self.suffix[members] = self.suffix[members[by]]
        self.head[members[1:]] |= key[1:] != key[:-1]
        order[self.at[members]] = self.suffix[members]
        head[self.at[members]] = self.head[members]
        return by


def sort_suffixes(
    raw: np.ndarray, places: np.ndarray, depth: int, owner: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``places`` by their first ``depth`` bytes, and the group of equal ones
    that each belongs to, in that order. ``raw`` must have 8 bytes after the last suffix. With ``owner``,
    a group whose suffixes all have one owner is left as it is."""
    n = len(places)
    order, head = np.arange(n), np.zeros(n, bool)
    if n < 2:
        return order, np.zeros(n, np.int64)
    head[0] = True
    words = words_at(raw)
    live = _Open(n, owner)
    # Multikey quicksort: a group is partitioned by its next bytes, as many as fit into a key behind the
    # group's number. Groups that agree in them are left alone, those that are done go no further.
    offset = 0
    while offset < min(SHALLOW, depth):
        live.close()
        if not len(live.at):
            return order, np.cumsum(head) - 1
        group = live.groups()
        width = min(8, (64 - int(group[-1]).bit_length()) // 8, depth - offset)
        key = words[places[live.suffix] + offset].astype(np.uint64) >> np.uint64(64 - 8 * width)
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[key != key[live.head][group]]] = True
        members = np.flatnonzero(mixed[group])
        key = key[members]
        if width < 8:
            key |= group[members].astype(np.uint64) << np.uint64(8 * width)
        live.sort(members, key, order, head)
        offset += width
    # Blind tries, all groups at once: members are compared with their group's first one, the path of
    # the trie; each leaves the path at the byte where they differ. A member that is smaller there goes
    # before the path (those that leave first in front), a larger one behind it (those that leave last
    # in front); members that leave at one place with one byte form the next, smaller trie.
    known = np.full(n, min(offset, depth), np.int64)  # by suffix
    bits = (2 * depth << 8 | 255).bit_length()
    while True:
        live.close()
        live.keep(known[live.suffix] < depth)
        if not len(live.at):
            return order, np.cumsum(head) - 1
        group, own = live.groups(), places[live.suffix]
        path = own[live.head]
        # members of a group are known equally far
        reach = known[live.suffix[live.head]]
        common = np.full(len(own), depth)
        byte = np.zeros(len(own), np.int64)
        less = np.zeros(len(own), bool)
        open_ = np.flatnonzero(~live.head)
        while len(open_):
            mine = group[open_]
            x = words[own[open_] + reach[mine]].astype(np.uint64)
            y = words[path + np.minimum(reach, depth)].astype(np.uint64)[mine]
            differ = x ^ y
            stop = np.flatnonzero(differ)
            same = 8 - np.searchsorted(_BYTE_STEPS, differ[stop], "right")
            got = reach[mine[stop]] + same
            inside = got < depth
            stop, same, got = stop[inside], same[inside], got[inside]
            shift = np.uint64(56) - np.uint64(8) * same.astype(np.uint64)
            left = open_[stop]
            common[left] = got
            byte[left] = (x[stop] >> shift) & np.uint64(255)
            less[left] = x[stop] < y[stop]
            open_ = open_[differ == 0]
            reach = reach + 8
            open_ = open_[reach[group[open_]] < depth]
        away = common < depth
        mixed = np.zeros(len(path), bool)
        mixed[group[away]] = True
        known[live.suffix] = np.where(away, common + 1, depth)
        members = np.flatnonzero(mixed[group])
        if len(members):
            # before the path: ascending place of leaving; the path; behind it: descending
            side = np.where(~away, depth, np.where(less, common, 2 * depth - common))[members]
            live.sort(members, (group[members] << bits) | (side << 8) | byte[members], order, head)


# --- tasks -----------------------------------------------------------------------------------


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("doc_id").fill_null(int(NO_KEY)).to_numpy(zero_copy_only=False)


def _padded(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw, np.zeros(64, np.uint8)])


class _Known:
    """The shared anchors of one level that a part has."""

    def __init__(self, shared: pa.Table, level: int, buckets: int):
        rows = [r for r in shared.to_pylist() if r["level"] == level]
        none = np.zeros(0, np.uint64)
        names = [np.frombuffer(r["names"], "<u4").astype(np.uint64) | (np.uint64(r["bucket"]) << np.uint64(32)) for r in rows]
        hot = [np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=len(r["names"]) // 4) for r in rows]
        names, hot = np.concatenate([none, *names]), np.concatenate([none, *hot]).astype(bool)
        by = np.argsort(names)
        self.names, self.hot, self.buckets = names[by], hot[by], buckets

    def of(self, name: np.ndarray):
        """Which names are shared, and which of those are hot."""
        if not len(self.names):
            return np.zeros(len(name), bool), np.zeros(len(name), bool)
        code = (name & LOW) | (_bucket_of(name, self.buckets).astype(np.uint64) << np.uint64(32))
        spot = np.minimum(np.searchsorted(self.names, code), len(self.names) - 1)
        shared = self.names[spot] == code
        return shared, shared & self.hot[spot]


def _levels(raw: np.ndarray, at: np.ndarray, length: int, known: list[_Known]):
    """(names, first starts, end starts, documents) of the runs of each level: the first level has all windows, the
    next one those of the hot anchors of the one before."""
    place, first, end, doc = anchor_runs(raw, at, length)
    padded = _padded(raw)
    name = anchor_names(padded, place)
    yield name, first, end, doc
    for width, before in zip(gram_widths(length)[1:], known):
        hot = before.of(name)[1]
        start = spread_indices(first[hot], (end - first)[hot])
        if not len(start):
            return
        place, first, end, doc = _runs_of(start, anchor_places(raw, length, width), at)
        name = anchor_names(padded, place, width)
        yield name, first, end, doc


def _run_texts(raw: np.ndarray, first: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A hash of the text of each run, which its first and last windows cover."""
    last = _window_hash(raw, end - 1, length) + (end - first).astype(np.uint64)
    return _mix(_window_hash(raw, first, length) + _mix(last))


def _distinct(part: int, held, buckets: int) -> pa.RecordBatch:
    """Distinct anchors of a part: one blob for each bucket, with whether two documents here share it and how many
    different runs it has (255 at most)."""
    names, docs, texts = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((texts, names))
    names, docs, texts = names[order], docs[order], texts[order]
    fresh = np.concatenate([[True], names[1:] != names[:-1]])[: len(names)]
    other = fresh | np.concatenate([[True], texts[1:] != texts[:-1]])[: len(names)]
    head = np.flatnonzero(fresh)
    many = np.zeros(0, bool)
    runs = np.zeros(0, np.uint8)
    if len(head):
        many = np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)
        runs = np.minimum(np.add.reduceat(other.astype(np.int64), head), 255).astype(np.uint8)
    names = names[head]
    # names are sorted, and buckets are ranges of them
    cuts = np.append(np.searchsorted(names, _edges(buckets)), len(names)).tolist()
    low = (names & LOW).astype("<u4")
    rows = [
        (b, part, low[i:j].tobytes(), np.packbits(many[i:j]).tobytes(), runs[i:j].tobytes())
        for b, (i, j) in enumerate(zip(cuts, cuts[1:]))
        if i < j
    ]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["bucket", "part", "names", "many", "runs"]
    )


def _anchors(buckets: int, length: int, counted: bool):
    """Distinct anchors of the first level of each part; ``counted``: with the number of their runs."""

    def run(batches):
        held, last = [], None
        for rows, raw, at in slices(batches, limit=SLICE):
            place, first, end, doc = anchor_runs(raw, at, length)
            padded = _padded(raw)
            names, ids = anchor_names(padded, place), _ids(rows)
            texts = _run_texts(padded, first, end, length) if counted else np.zeros(len(names), np.uint64)
            parts = rows.column("part").to_numpy(zero_copy_only=False)
            for part in np.unique(parts).tolist():  # the rows are sorted by part
                if part != last and held:
                    yield _distinct(last, held, buckets)
                    held = []
                last, mine = part, parts[doc] == part
                if mine.any():
                    held.append((names[mine], ids[doc[mine]], texts[mine]))
        if held:
            yield _distinct(last, held, buckets)

    return run


def _longer_anchors(buckets: int, length: int, level: int):
    """Distinct anchors of a later level of a part."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known = [_Known(shared, k, buckets) for k in range(level)]
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        if all(k.hot.any() for k in known):
            for rows, raw, at in slices(iter(docs.to_batches()), limit=SLICE):
                found = list(_levels(raw, at, length, known))
                if len(found) > level:
                    name, first, end, doc = found[level]
                    held.append((name, _ids(rows)[doc], _run_texts(_padded(raw), first, end, length)))
        return pa.Table.from_batches([_distinct(docs["part"][0].as_py() if docs.num_rows else 0, held, buckets)])

    return run


def _shared_anchors(level: int):
    """For one bucket: the anchors that more than one document has, back to every part that has them."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = np.concatenate([np.frombuffer(r["names"], "<u4") for r in rows])
        sizes = [len(r["names"]) // 4 for r in rows]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n) for r, n in zip(rows, sizes)])
        runs = np.concatenate([np.frombuffer(r["runs"], np.uint8) for r in rows])
        distinct, which, times = np.unique(names, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[which[many > 0]] = True
        hot = (times > HOT_PARTS) & (np.bincount(which, runs) > HOT_RUNS * times)
        out, at = [], 0
        for r, n in zip(rows, sizes):
            mine = which[at : at + n]
            keep = shared[mine]
            at += n
            if keep.any():
                out.append((r["part"], level, r["bucket"], distinct[mine[keep]].astype("<u4").tobytes(), np.packbits(hot[mine[keep]]).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "level", "bucket", "names", "hot"])

    return run


def _runs(buckets: int, length: int, levels: int):
    """Runs of windows with shared anchors, as rows (bucket, part, texts, starts, owners, done). Those without texts
    are repeats already."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        kinds = {
            "bucket": pa.int32(), "part": pa.int32(), "texts": pa.binary(), "sizes": pa.binary(),
            "keys": pa.binary(), "docs": pa.binary(), "starts": pa.binary(),
        }
        if not docs.num_rows or not shared.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        known = [_Known(shared, k, buckets) for k in range(levels)]
        part = docs["part"][0].as_py()
        texts, sizes, keys, names, starts, bucket = [], [], [], [], [], []
        for rows, raw, at in slices(iter(docs.to_batches()), limit=SLICE):
            data = raw.tobytes()
            for level, (name, first, end, doc) in enumerate(_levels(raw, at, length, known[:-1])):
                keep, hot = known[level].of(name)
                if level + 1 < levels:
                    keep &= ~hot
                if not keep.any():
                    continue
                name, first, end, doc = name[keep], first[keep], end[keep], doc[keep]
                size = end - first + length - 1
                texts += [data[i : i + n] for i, n in zip(first.tolist(), size.tolist())]
                sizes.append(size)
                bucket.append(_bucket_of(name, buckets))
                keys.append(_ids(rows)[doc])
                names.append(rows.column("row").to_numpy(zero_copy_only=False)[doc])
                starts.append(first - at[doc])
        if not texts:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        size, bucket, keys, names, starts = (np.concatenate(x) for x in (sizes, bucket, keys, names, starts))
        coded = pa.array(texts, pa.large_binary()).dictionary_encode()
        text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # the smallest key of each distinct text of the part stands for the others with a larger one
        least = np.full(len(coded.dictionary), NO_KEY)
        np.minimum.at(least, text, keys)
        local = keys > least[text]
        out = []
        mine = np.flatnonzero(local)
        if len(mine):  # repeats that need no bucket to tell
            out.append(_row(part % buckets, part, None, size[mine] - length + 1, keys[mine], names[mine], starts[mine]))
        rest = np.flatnonzero(~local)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[rest][1:] != bucket[rest][:-1]])) if len(rest) else []
        for i, j in zip(cuts, np.append(cuts[1:], len(rest)) if len(rest) else []):
            mine = rest[i:j]
            body = b"".join(texts[k] for k in mine.tolist())
            out.append(_row(int(bucket[mine[0]]), part, body, size[mine] - length + 1, keys[mine], names[mine], starts[mine]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

    return run


def _row(bucket, part, body, windows, keys, names, starts):
    return (
        bucket, part, body, windows.astype("<u4").tobytes(), keys.astype("<i8").tobytes(),
        names.astype("<i8").tobytes(), starts.astype("<u4").tobytes(),
    )


def _bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash: bucket b has those from b * 2**64 / buckets on."""
    return np.searchsorted(_edges(buckets), name, "right") - 1


def _edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def _window_hash(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each start on (raw has 8 bytes to spare)."""
    words, name = words_at(raw), np.zeros(len(starts), np.uint64)
    for offset in [*range(0, length - 7, 8), length - 8]:
        name = _mix(name + words[starts + offset].astype(np.uint64))
    return name


def _repeats(length: int):
    """For one bucket: sort its suffixes and report the windows that a smaller document has too."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = [r for r in rows if r["texts"] is None]
        rows = [r for r in rows if r["texts"] is not None]
        told = [_packed(r["part"], r["docs"], r["starts"], r["sizes"]) for r in done]
        if not rows:
            return pa.concat_tables(told)
        windows = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in rows]).astype(np.int64)
        keys = np.concatenate([np.frombuffer(r["keys"], "<i8") for r in rows])
        names = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
        starts = np.concatenate([np.frombuffer(r["starts"], "<u4") for r in rows]).astype(np.int64)
        parts = np.concatenate([np.full(len(r["sizes"]) // 4, r["part"], np.int32) for r in rows])
        body = np.frombuffer(b"".join(r["texts"] for r in rows), np.uint8)
        # Runs of one text: those of its smallest document are sorted, once; all others are repeats.
        run_at = np.concatenate([[0], np.cumsum(windows + length - 1)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(windows), [None, pa.py_buffer(run_at), pa.py_buffer(body)])
        text = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        least = np.full(int(text.max()) + 1, NO_KEY)
        np.minimum.at(least, text, keys)
        first = keys == least[text]
        later = np.flatnonzero(~first)
        by_text = np.flatnonzero(first)
        by_text = by_text[np.argsort(text[by_text], kind="stable")]
        number = np.bincount(text[by_text], minlength=len(least))
        shown = by_text[np.concatenate([[0], np.cumsum(number)[:-1]])]  # one run of each text
        raw = _padded(body)
        places = spread_indices(run_at[shown], windows[shown])
        owner = np.repeat(np.arange(len(shown)), windows[shown])
        order, group = sort_suffixes(raw, places, length, least[owner])
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(least[owner[order]], heads), np.diff(np.append(heads, len(order))))
        again = np.sort(order[least[owner[order]] > lowest])
        # neighbouring windows of a run as one span
        own = owner[again]
        cut = np.concatenate([[True], (again[1:] != again[:-1] + 1) | (own[1:] != own[:-1])])[: len(again)]
        head = np.flatnonzero(cut)
        count = np.diff(np.append(head, len(again)))
        inside, of_text = places[again[head]] - run_at[shown[own[head]]], own[head]
        # for every run of the text in its smallest document
        times = number[of_text]
        mine = by_text[spread_indices((np.cumsum(number) - number)[of_text], times)]
        begin = np.concatenate([starts[mine] + np.repeat(inside, times), starts[later]])
        count = np.concatenate([np.repeat(count, times), windows[later]])
        mine = np.concatenate([mine, later])
        return pa.concat_tables([*told, _spans(parts[mine], names[mine], begin, count)])

    return run


def _spans(parts, names, begin, windows) -> pa.Table:
    """One row for each part: rows and spans, packed."""
    by = np.argsort(parts, kind="stable")
    parts, names, begin, windows = parts[by], names[by], begin[by], windows[by]
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))[: len(parts)]
    out = [
        _packed(int(parts[i]), names[i:j].astype("<i8").tobytes(), begin[i:j].astype("<u4").tobytes(), windows[i:j].astype("<u4").tobytes())
        for i, j in zip(cuts, np.append(cuts[1:], len(parts)))
    ]
    return pa.concat_tables(out) if out else _packed()


def _packed(*row) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds)] or [pa.array([], t) for t in kinds], ["part", "docs", "starts", "windows"])


def _finish(length: int, schema: pa.Schema, emit):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        found = spans.to_pylist()
        names = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in found] or [np.zeros(0, "<i8")])
        begin = np.concatenate([np.frombuffer(r["starts"], "<u4") for r in found] or [np.zeros(0, "<u4")]).astype(np.int64)
        count = np.concatenate([np.frombuffer(r["windows"], "<u4") for r in found] or [np.zeros(0, "<u4")]).astype(np.int64)
        by = np.lexsort((begin, names))
        names, begin, end = names[by], begin[by], begin[by] + count[by] + length - 1
        out = []
        for rows, raw, at in slices(iter(docs.to_batches()), limit=8 * SLICE):
            data = raw.tobytes()
            mine = rows.column("row").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(names, mine, "left"), np.searchsorted(names, mine, "right")
            values = []
            for k, (i, j) in enumerate(zip(low.tolist(), high.tolist())):
                text = data[at[k] : at[k + 1]]
                kept, last, spans_, removed = [], 0, [], 0
                for b, e in zip(begin[i:j].tolist(), end[i:j].tolist()):
                    if spans_ and b <= spans_[-1][1]:
                        spans_[-1][1] = max(e, spans_[-1][1])
                    else:
                        spans_.append([b, e])
                for b, e in spans_:
                    kept.append(text[last:b])
                    removed, last = removed + e - b, e
                kept.append(text[last:])
                values.append((text, b"".join(kept), removed, spans_))
            out.append(emit(rows, values))
        # a part of spans alone has no documents, hence no rows
        return pa.Table.from_batches(out) if out else pa.table({c: [] for c in (schema or pa.schema([])).names})

    return run


def _repeated_spans(docs: DataFrame, length: int, id_col: str, text_col: str, extra=()):
    """The documents dealt to parts, and the packed spans of repeats of each part.

    All uses of the dealt documents are one exchange in the plan, which Spark runs once."""
    parts = parts_for(docs, PART_BYTES)
    buckets = BUCKETS_PER_PART * parts
    plain = documents(docs, id_col, text_col)
    if extra:
        plain = docs.select(
            *[F.col(f"`{c}`") for c in extra],
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        )
    row = F.xxhash64("doc_id", "text")
    dealt = plain.withColumn("row", row).withColumn("part", F.pmod(row, F.lit(parts)).cast("int")).repartition(parts, "part")
    # no anchor is in more parts than there are
    levels = len(gram_widths(length)) if parts > HOT_PARTS else 1
    blobs = "bucket int, part int, names binary, many binary, runs binary"
    anchors = dealt.sortWithinPartitions("part").mapInArrow(_anchors(buckets, length, levels > 1), blobs)
    shared = None
    for level in range(levels):
        if level:
            anchors = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_longer_anchors(buckets, length, level), blobs)
        found = anchors.groupBy("bucket").applyInArrow(
            _shared_anchors(level), "part int, level int, bucket int, names binary, hot binary"
        )
        shared = shared.union(found) if level else found
    runs = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        _runs(buckets, length, levels),
        "bucket int, part int, texts binary, sizes binary, keys binary, docs binary, starts binary",
    )
    spans = runs.groupBy("bucket").applyInArrow(_repeats(length), "part int, docs binary, starts binary, windows binary")
    return dealt, spans


def remove_repeats(
    docs: DataFrame, length: int = 50, with_text: bool = True, id_col="doc_id", text_col="text"
) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row.

    ``kept`` (binary) is the text without every byte that a string of ``length`` bytes covers which also
    starts in a document with a smaller key; ``spans`` are the removed byte ranges of the input. A null
    text is empty; a null key is larger than all others; rows with equal keys do not remove each other;
    texts shorter than ``length`` stay whole.
    """
    if length < GRAM + 4:
        raise ValueError(f"length must be at least {GRAM + 4}")
    dealt, spans = _repeated_spans(docs, length, id_col, text_col)
    schema = pa.schema(
        [("doc_id", pa.int64()), *([("kept", pa.binary())] if with_text else []), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
        + [("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
    )
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"

    def emit(rows, values):
        cols = [rows.column("doc_id")]
        if with_text:
            cols.append(pa.array([v[1] for v in values], pa.binary()))
        cols += [
            pa.array([len(v[0]) for v in values], pa.int64()),
            pa.array([v[2] for v in values], pa.int64()),
            pa.array([len(v[3]) for v in values], pa.int64()),
            pa.array([hashlib.sha256(v[1]).hexdigest() for v in values], pa.string()),
            pa.array([v[3] for v in values], pa.list_(pa.list_(pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    return dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(
        _finish(length, schema, emit), f"doc_id long, {'kept binary, ' if with_text else ''}{kind}"
    )


def cut_repeats(docs: DataFrame, length: int, id_col="doc_id", text_col="text", size_col: str | None = None) -> DataFrame:
    """All rows and columns, the text without its repeats; characters that a cut broke are dropped.

    ``size_col`` gets the new number of characters. A null text stays null.
    """
    columns = [c for c in docs.columns if c != text_col]
    names = {c: f"_c{i}" for i, c in enumerate(columns)}
    wide = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.col(f"`{text_col}`").isNull().alias("_null"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{id_col}`").alias("doc_id"),
    )
    dealt, spans = _repeated_spans(wide, length, "doc_id", "text", [*names.values(), "_null"])
    kind = ", ".join(f"{names[c]} {docs.schema[c].dataType.simpleString()}" for c in columns)
    kind += ", _null boolean, text string"

    def emit(rows, values):
        texts = [v[1].decode("utf-8", "ignore") for v in values]
        kept = [rows.column(n) for n in [*names.values(), "_null"]]
        return pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names.values(), "_null", "text"])

    cut = dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_finish(length, None, emit), kind)
    text = F.when(~F.col("_null"), F.col("text"))
    out = {c: F.col(names[c]) for c in columns} | {text_col: text}
    if size_col in names:
        out[size_col] = F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema[size_col].dataType)
    return cut.select(*[out[c].alias(c) for c in docs.columns])
