"""Removal of repeated byte strings by a distributed suffix merge sort.

A byte goes if it lies in a ``SPAN``-byte string (a window) that also starts
earlier: in a document before, or before in the same one.

Not all suffixes are sorted. Every window has an anchor, the first of its
``GRAM``-byte grams with the smallest hash; equal windows have equal anchors at
equal places, so only suffixes at anchors matter, about one in 35, and of these
only those whose gram occurs more than once:

1. Anchor hashes, sorted in runs, are exchanged by hash range (as 32 bits besides
   the range: a chance match only lets an anchor on to 2); those that occur twice
   come back as positions by document. Of a hash that a run holds several times
   one is sent with the count, the others follow and are streamed.
2. Documents meet their positions, and the suffixes there (with the bytes before
   them, as far as a window reaches) become sorted runs: a string is its gram's
   hash, the bytes from the anchor on, then the bytes before it backwards. Equal
   strings of a run are one; all but the earliest are done with. A run is
   front-coded (length of the prefix shared with the string before, rest) and
   exchanged by range of the leading bytes, which are uniform.
3. Each range is merged by a loser tree that knows how much of each run's next
   string agrees with the last one put out: strings that agree further are
   smaller without a look, and bytes known to be equal are not compared again.
   The common prefixes that the merge yields decide: suffixes between which no
   common prefix falls below ``n`` bytes share their first ``n`` bytes. A window
   with ``b`` bytes before its anchor repeats where an earlier member of the same
   class of ``SPAN - b`` bytes also shares ``b`` bytes backwards, which a second
   sort of those bytes decides alike. No hash has a say in it.
4. Removed stretches meet the documents again (the same shuffle as in 2).

A gram that occurs more than ``HOT`` times would be one group in one task. Its
suffixes are sent in pieces, each for the windows with so many bytes before the
anchor, under a hash of the bytes that all windows of the piece hold (84 and
more of 100), so only members of like surroundings meet. Merged strings are
decided in blocks that end between groups, with about 300 bytes a member.

Documents that equal an earlier one skip 2 and 3: all their windows repeat.

Defined cases: ``doc_id`` is of an integer type (any other raises); null text
is empty; rows that repeat id and text are one document and share its result;
rows that repeat an id with other text are put in order by a hash of the text
(rows are told apart by id and 96 bits of it); a null id comes first, in one
order with the smallest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import arrow

SPAN = 100
GRAM = 32
LEFT = SPAN - GRAM  # most bytes of a window before its anchor
WIDTH = 8 + SPAN + LEFT
#: Text that a task turns into one set of sorted runs, and the part of a text anchored at a time.
RUN_BYTES = 16 << 20
CHUNK = 4 << 20
SLICE = 1 << 18
#: Suffix strings sorted at a time, and members of groups compared at a time.
STRING_BYTES = 8 << 20
MEMBERS = 16_000
PARTS_PER_PARTITION = 4
#: Occurrences above which a gram's suffixes are sent in pieces, of so many windows each.
HOT = 50_000
PIECE = 17
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(SPAN + LEFT, _B, np.uint64))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h, k, power = raw.astype(np.uint64) + np.uint64(1), 1, _B
    while k < GRAM:
        h = h[:-k] * power + h[k:]
        k, power = 2 * k, power * power
    return _mixed(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor: document, place, first and last start of the windows it stands for, gram hash.

    Places and starts count from the document's beginning.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(1, len(raw) - SPAN + 1), CHUNK):
        piece = raw[at : at + CHUNK + SPAN - 1]
        if len(piece) < SPAN:
            break
        with np.errstate(over="ignore"):
            h = _gram_hashes(piece)
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), SPAN - GRAM + 1)
        ends = offsets[1:] - at
        start = np.arange(len(least))
        doc = np.searchsorted(ends, start, "right")
        inside = start + SPAN <= ends[np.minimum(doc, len(ends) - 1)]
        start, doc, place = start[inside], doc[inside], (least[inside] & _LOW).astype(np.int64)
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        spread = _mixed(h[place[new]] + _B)  # chosen hashes are small ones; ranges need even ones
        out.append((doc[new], place[new] + at, start[new] + at, start[last] + at, spread))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    doc, place, lo, hi, h = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))  # a chunk's end may halve one
    doc, place, lo, hi, h = doc[new], place[new], lo[new], hi[np.append(new[1:], len(hi)) - 1], h[new]
    base = offsets[doc]
    return doc, place - base, lo - base, hi - base, h


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of any type in one string."""
    head = np.array([len(columns), *[c.nbytes for c in columns]], np.int64).tobytes()
    return zstandard.compress(head + b"".join(c.tobytes() for c in columns), 1)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds), 8), 8 + 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    part, done, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(done, pa.bool_()), pa.array(blob, pa.binary())], ["part", "done", "blob"])


_BLOBS = "part int, done boolean, blob binary"


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers in a sorted array."""
    if len(parts):
        edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(parts[a]), a, b


# --- 1: grams that occur twice ----------------------------------------------

_KEY = ("<i8", "<i8", "<i4", "<i4")  # id, text hash, more of it, place
_PLACE = "_order long, _body long, _more int, _place long"


def _in_order(*key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort columns for ``lexsort`` by documents and places in them."""
    return key[::-1]


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The first of each set of equal rows (rows of one document may come twice), sorted by the columns."""
    at = np.lexsort(_in_order(*columns))
    new = np.zeros(len(at), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[at][1:] != c[at][:-1]
    return at[new]


def _anchor_runs(parts: int):
    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        at = _distinct(*columns)
        h, *key = (c[at] for c in columns)
        first = np.ones(len(h), bool)  # none at all where every text is shorter than a window
        first[1:] = h[1:] != h[:-1]
        times = np.diff(np.append(np.flatnonzero(first), len(h))).astype("<u4")
        part, low, rows = _range_of(h, parts), (h & _LOW).astype("<u4"), []
        for done, some, extra in ((False, first, [times]), (True, ~first, [])):
            cols = [low[some], *extra, *(k[some] for k in key)]
            for p, a, b in _by_part(part[some]):
                rows.append((p, done, _packed(*(c[a:b] for c in cols))))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            order, body, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for first, _, raw, off in arrow.slices(batch.column(3), SLICE):
                doc, place, _, _, h = anchors(raw, off)
                held.append((h, order[first + doc], body[first + doc], more[first + doc], place.astype(np.int32)))
                size += len(raw)
                if size >= RUN_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _positions(hot: np.ndarray, order: np.ndarray, body: np.ndarray, more: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    asked = place.astype(np.int64) * 2 + hot
    return pa.RecordBatch.from_arrays([pa.array(order), pa.array(body), pa.array(more), pa.array(asked)], ["_order", "_body", "_more", "_place"])


def _repeated_anchors(limit: int):
    """Places of grams that occur twice, doubled, and one more where the gram is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, hot = None, [], np.zeros(0, np.uint32)

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal hot
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            by = np.argsort(columns[1], kind="stable")[::-1]  # of equal rows of two runs the larger count
            times, *columns = (c[by] for c in (columns.pop(1), *columns))
            at = _distinct(*columns)
            (h, *key), times = (c[at] for c in columns), times[at]
            found, of = np.unique(h, return_inverse=True)
            total = np.bincount(of, times)
            hot = found[total > limit]
            tell = total[of] > 1
            yield _positions(total[of][tell] > limit, *(k[tell] for k in key))
            held.clear()

        for batch in batches:
            for part, rest, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part != now or rest) and held:
                    yield from settled()
                now = part
                if rest:  # a range's first ones come before its others
                    h, *key = _unpacked(blob, "<u4", *_KEY)
                    yield _positions(np.isin(h, hot), *key)
                else:
                    held.append(_unpacked(blob, "<u4", "<u4", *_KEY))
        if held:
            yield from settled()

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Blobs range by range; rows come sorted by range."""
    now, blobs, done = None, [], []
    for batch in batches:
        for part, over, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if now is not None:
                    yield now, blobs, done
                now, blobs, done = part, [], []
            (done if over else blobs).append(blob)
    if now is not None:
        yield now, blobs, done


# --- 2: front-coded sorted suffix runs ---------------------------------------

_RUN = ("u1", "u1", *_KEY, "u1", "u1")


def suffix_strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of suffixes as zero-padded rows, and how many bytes follow and precede the anchor."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    out[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    right, left = np.minimum(end - at, SPAN), np.minimum(at - begin, LEFT)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(SPAN, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + SPAN)[at]
    out[:, 8 : 8 + SPAN] = np.where(np.arange(SPAN) < right[:, None], view[:, LEFT:], 0)
    out[:, 8 + SPAN :] = np.where(np.arange(LEFT) < left[:, None], view[:, LEFT - 1 :: -1], 0)
    return out, right.astype(np.uint8), left.astype(np.uint8)


def shared_prefixes(strings: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = strings[1:] != strings[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    return out


def pieces(strings: np.ndarray, low: np.ndarray, high: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows to send for each suffix, the leading bytes and the windows each is for.

    A suffix of a hot gram is sent once per piece of its windows, under a hash of
    the bytes that all windows of the piece hold.
    """
    cold = np.flatnonzero(~hot)
    of, lead, lows, highs = [cold], [strings[cold, :8]], [low[cold]], [high[cold]]
    with np.errstate(over="ignore"):
        for a in range(0, LEFT + 1, PIECE) if hot.any() else ():
            b = min(a + PIECE - 1, LEFT)
            some = np.flatnonzero(hot & (low <= b) & (high >= a))
            core = np.concatenate([strings[some, 8 : 8 + SPAN - b], strings[some, 8 + SPAN : 8 + SPAN + a]], 1)
            h = _mixed(((core.astype(np.uint64) + np.uint64(1)) * _powers()[: core.shape[1]]).sum(1, dtype=np.uint64) + np.uint64(a) * _M)
            of.append(some)
            lead.append(h.astype(">u8").view(np.uint8).reshape(-1, 8))
            lows.append(np.maximum(low[some], a))
            highs.append(np.minimum(high[some], b))
    return np.concatenate(of), np.concatenate(lead), np.concatenate(lows).astype(np.uint8), np.concatenate(highs).astype(np.uint8)


def _suffix_runs(parts: int):
    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        strings, right, left, order, body, more, place, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        at = _distinct(order, body, more, place, low)
        at = at[np.argsort(np.ascontiguousarray(strings[at]).view(f"S{WIDTH}").reshape(-1), kind="stable")]
        strings, right, left, order, body, more, place, low, high = (x[at] for x in (strings, right, left, order, body, more, place, low, high))
        shared = shared_prefixes(strings)
        same = np.zeros(len(strings), bool)
        same[1:] = (shared[1:] == WIDTH) & (right[1:] == right[:-1]) & (left[1:] == left[:-1])
        rows = []
        spans = (order[same], body[same], more[same], (place[same] - high[same]).astype(np.int32), (place[same] - low[same] + SPAN).astype(np.int32))
        for a in range(0, len(spans[0]), 4096):
            rows.append((int((int(spans[3][a]) + a) % parts), True, _packed(*(x[a : a + 4096] for x in spans))))
        keep = ~same
        strings, right, left, order, body, more, place, low, high = (x[keep] for x in (strings, right, left, order, body, more, place, low, high))
        h = strings[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)
        shared, length = shared_prefixes(strings), 8 + SPAN + left.astype(np.int64)
        for p, a, b in _by_part(_range_of(h, parts)):
            lcp = np.minimum(shared[a:b], length[a:b])
            lcp[0] = 0
            lcp[1:] = np.minimum(lcp[1:], length[a : b - 1])
            mask = (np.arange(WIDTH) >= lcp[:, None]) & (np.arange(WIDTH) < length[a:b, None])
            rest = strings[a:b][mask]
            cols = (lcp.astype(np.uint8), left[a:b], order[a:b], body[a:b], more[a:b], place[a:b].astype(np.int32), low[a:b], high[a:b])
            rows.append((p, False, _packed(*cols, rest)))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            order, body, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            wanted = batch.column(4)
            for first, after, raw, off in arrow.slices(batch.column(3), SLICE):
                doc, place, lo, hi, h = anchors(raw, off)
                some = wanted.slice(first, after - first)
                of = np.repeat(np.arange(after - first), np.diff(some.offsets.to_numpy()))
                asked = (of << 40) | some.flatten().to_numpy().astype(np.int64)
                own = (doc << 40) | (place << 1)
                hot = np.isin(own | 1, asked)
                keep = hot | np.isin(own, asked)
                doc, place, lo, hi, h, hot = (x[keep] for x in (doc, place, lo, hi, h, hot))
                for a in range(0, len(doc), 4096):
                    d, p = doc[a : a + 4096], place[a : a + 4096]
                    strings, right, left = suffix_strings(raw, off[d], off[d + 1], off[d] + p, h[a : a + 4096])
                    of, lead, low, high = pieces(strings, p - hi[a : a + 4096], p - lo[a : a + 4096], hot[a : a + 4096])
                    strings = strings[of]
                    strings[:, :8] = lead
                    d, p = first + d[of], p[of]
                    held.append((strings, right[of], left[of], order[d], body[d], more[d], p, low, high))
                    size += strings.nbytes
                    if size >= STRING_BYTES:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


# --- 3: merging ---------------------------------------------------------------


class FrontCoded:
    """One sorted run, read string by string."""

    def __init__(self, shared: list[int], rests: list[bytes]):
        self.shared, self.rests, self.at = shared, rests, -1
        self.now: bytes | None = b""
        self.lcp = 0
        self.step()

    def step(self) -> None:
        """Go to the next string; ``lcp`` is what it shares with the one before."""
        self.at += 1
        if self.at < len(self.rests):
            self.lcp = self.shared[self.at]
            self.now = self.now[: self.lcp] + self.rests[self.at]
        else:
            self.now = None


def _agree(a: bytes, b: bytes, since: int) -> int:
    """Length of the common prefix, of which ``since`` bytes are known."""
    if a == b:
        return len(a)
    most = min(len(a), len(b))
    while since < most:
        x = int.from_bytes(a[since : since + 16], "big") ^ int.from_bytes(b[since : since + 16], "big") if since + 16 <= most else -1
        if x == 0:
            since += 16
        elif x > 0:
            return since + (128 - x.bit_length()) // 8
        else:
            while since < most and a[since] == b[since]:
                since += 1
            return since
    return most


class LoserTree:
    """Merges front-coded runs without comparing known prefixes again."""

    def __init__(self, runs: list[FrontCoded]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.known = [0] * self.size  # what each run's next string shares with the last winner on its path
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            run = node - self.size
            return run if run < len(self.runs) else -1
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lost
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or self.runs[a].now is None:
            return (b, a) if b >= 0 else (a, b)
        if b < 0 or self.runs[b].now is None:
            return a, b
        known = self.known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = self.runs[a].now, self.runs[b].now
        same = _agree(x, y, known[a])
        if x[same:] < y[same:] or (x == y and a < b):
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """Strings in order: prefix shared with the one before, run, place in the run, string."""
        while self.winner >= 0 and (run := self.runs[self.winner]).now is not None:
            won = self.winner
            yield self.known[won], won, run.at, run.now
            run.step()
            self.known[won] = run.lcp
            node = (won + self.size) // 2
            while node:
                won, self.losers[node] = self._play(won, self.losers[node])
                node //= 2
            self.winner = won


class _Rests:
    """The rests of a run's strings, cut from one buffer as they are read."""

    def __init__(self, data: bytes, ends: list[int]):
        self.data, self.ends = data, ends

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.ends[i - 1] if i else 0 : self.ends[i]]


def _classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """A number per row, equal where sorted rows share ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def repeated_windows(strings: np.ndarray, shared: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows (columns: bytes before the anchor) have an equal one at an earlier row.

    Rows come in merged order; ``shared`` is the common prefix with the row
    before, ``rank`` the place of each in document order.
    """
    n = len(strings)
    before = np.empty(n, np.int64)
    before[rank] = np.arange(n)  # row by rank
    left = np.ascontiguousarray(strings[:, 8 + SPAN :])
    back = np.argsort(left.view(f"S{LEFT}").reshape(-1), kind="stable")
    left_shared = shared_prefixes(left[back])
    if n:
        left_shared[0] = -1
    right, own = shared - 8, np.arange(n)
    found = np.zeros((n, LEFT + 1), bool)
    for b in range(LEFT + 1):
        rows = before[(low[before] <= b) & (high[before] >= b)]
        if len(rows) < 2:
            continue
        key = _classes(own, right, SPAN - b)[rows] * (n + 1) + _classes(back, left_shared, b)[rows]
        again = np.ones(len(rows), bool)
        again[np.unique(key, return_index=True)[1]] = False
        found[rows[again], b] = True
    return found


def merged_blocks(blobs: list[bytes], most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Members of groups of one range in merged order, in blocks of whole groups.

    Strings, prefix shared with the one before, key columns, and windows.
    """
    runs, meta = [], []
    for blob in blobs:
        lcp, left, *cols, rest = _unpacked(blob, *_RUN, "u1")
        ends = np.cumsum(8 + SPAN + left.astype(np.int64) - lcp)
        runs.append(FrontCoded(lcp.tolist(), _Rests(rest.tobytes(), ends.tolist())))
        meta.append(cols)
    base = np.cumsum([0, *[len(m[0]) for m in meta]])
    columns = [np.concatenate(c) for c in zip(*meta, strict=True)]
    text, shared, index, last = bytearray(), [], [], None
    for lcp, r, i, s in LoserTree(runs):
        if lcp >= 8 + GRAM:
            if last is not None:
                text += last[1].ljust(WIDTH, b"\0")
                shared.append(last[0])
                index.append(last[2])
                last = None
            text += s.ljust(WIDTH, b"\0")
            shared.append(lcp)
            index.append(base[r] + i)
            continue
        if len(index) >= (most or MEMBERS):
            yield np.frombuffer(bytes(text), np.uint8).reshape(-1, WIDTH), np.array(shared), *(c[index] for c in columns)
            text, shared, index = bytearray(), [], []
        last = (lcp, s, base[r] + i)
    if index:
        yield np.frombuffer(bytes(text), np.uint8).reshape(-1, WIDTH), np.array(shared), *(c[index] for c in columns)


_SPANS = "_order long, _body long, _more int, _start int, _end int"


def _spans(order: np.ndarray, body: np.ndarray, more: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    cols = (order, body, more, start.astype(np.int32), end.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_order", "_body", "_more", "_start", "_end"])


def _repeated_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, blobs, done in _ranges(batches):
        for blob in done:
            yield _spans(*_unpacked(blob, *_KEY, "<i4"))
        for columns in merged_blocks(blobs) if blobs else ():
            some = np.sort(_distinct(*columns[2:7]))  # equal rows are equal strings, so no prefix changes
            strings, shared, *key, low, high = (c[some] for c in columns)
            rank = np.empty(len(strings), np.int64)
            rank[np.lexsort(_in_order(*key))] = np.arange(len(strings))
            found = repeated_windows(strings, shared, rank, low, high)
            for at in range(0, len(found), MEMBERS):
                ends = np.diff(np.pad(found[at : at + MEMBERS].astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (row, first), (_, after) = np.nonzero(ends == 1), np.nonzero(ends == -1)
                *doc, place = (k[at + row] for k in key)
                yield _spans(*doc, place - (after - 1), place - first + SPAN)


# --- 4: the operator ----------------------------------------------------------


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Removed bytes, maximal removed runs, and what is left."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, raw[~gone]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, copy = batch.column(2), batch.column(3).to_pylist()
        rows = []
        for first, after, raw, off in arrow.slices(batch.column(1)):
            for i in range(first, after):
                text = raw[off[i - first] : off[i - first + 1]]
                found = spans[i].values
                if copy[i] and len(text) >= SPAN:
                    removed, runs, kept = len(text), 1, text[:0]
                elif found is None or not len(found):
                    removed, runs, kept = 0, 0, text
                else:
                    removed, runs, kept = _kept(text, found.field(0).to_numpy(), found.field(1).to_numpy())
                rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the bytes ``kept``."""
    arrow.check_integer(docs, "doc_id")
    spark, key = docs.sparkSession, ["_order", "_body", "_more"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS_PER_PARTITION * partitions
    text, doc_id = F.coalesce(docs["text"], F.lit("")), docs["doc_id"].cast("long")
    order = F.coalesce(doc_id, F.lit(NO_ID))
    keyed = docs.select(doc_id.alias("doc_id"), order.alias("_order"), F.xxhash64(text).alias("_body"), F.hash(text).alias("_more"), text.alias("text"))
    runs = arrow.mapped(keyed.select(*key, "text"), _BLOBS, _anchor_runs(parts))
    dealt = runs.repartition(partitions, "part").sortWithinPartitions("part", "done")
    places = arrow.mapped(dealt, _PLACE, _repeated_anchors(hot))
    places = places.groupBy(*key).agg(F.collect_set("_place").alias("_places"))
    long = keyed.filter(F.octet_length("text") >= SPAN).select(*key).distinct()
    earliest = long.groupBy("_body", "_more").agg(F.min("_order").alias("_order"))
    copies = long.join(earliest, key, "left_anti").withColumn("_copy", F.lit(True))  # dealt by the whole key: copies spread
    places = places.join(copies, key, "left_anti")
    met = keyed.join(places, key)
    # all columns of ``keyed`` are asked for here too, so that both joins with it read one exchange of the texts
    coded = arrow.mapped(met.select(*key, "text", "_places", "doc_id"), _BLOBS, _suffix_runs(parts))
    dealt = coded.repartition(partitions, "part").sortWithinPartitions("part")
    spans = arrow.mapped(dealt, _SPANS, _repeated_spans)
    spans = spans.groupBy(*key).agg(F.collect_set(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))).alias("_spans"))
    facts = spans.join(copies, key, "full")
    found = keyed.join(facts, key, "left").select("doc_id", "text", "_spans", F.coalesce("_copy", F.lit(False)).alias("_copy"))
    return arrow.mapped(found, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", _finish)
