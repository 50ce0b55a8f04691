"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it is covered by a ``length``-byte string that also starts somewhere else, in
another text or the same one. Strings never cross texts, and all are judged on the input.

1. Anchors. Every ``length``-byte string has one: the leftmost of its ``GRAM``-byte grams with the
   least hash. Equal strings have equal anchors at equal places, so a string repeats only among
   places of one anchor gram. Grams that occur once are dropped; that leaves few texts.
2. Suffix sort. The places of a gram are sorted by what follows and by what precedes them. Prefix
   polynomial hashes and binary search give the common extension of two places in a logarithm of
   steps, a merge sort needs a logarithm of such comparisons per place. Neighbours in the order
   are then compared byte by byte; a hash collision shows there and the sort is done again with
   another base.
3. A string that starts ``o`` bytes before its anchor repeats if another place shares ``o`` bytes
   before and ``length - o`` after. In both orders, places that share so much are one run, so
   the string repeats where two places have both runs in common. No pair of places is formed.

Scale. Texts cross the network once, places with their ``2 * length`` surrounding bytes only for
repeated grams. Equal surroundings are combined within each task before that. A gram with more
than ``hot`` places is not brought together at all: its strings are counted by digest, with
counts combined in each task. All texts that occur as a whole several times are settled by their
count, and one of them stands for all.

Cases: null is the empty text; texts below ``length`` bytes keep all; equal rows are judged like
equal texts of different rows; null keys are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import slices, utf8
from staywise.llm.ngram_join import mix
from staywise.session import ship_code, written

GRAM = 64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict = {}
_SEEN = 200_000
_CHUNK = 8192
PLACES = "h long, t1 long, t2 long, at long, back int, around binary"


def _powers(n: int, base: int, inverse: bool):
    """base ** 0..n (or of its inverse), modulo 2**64."""
    import numpy as np

    known = _POWERS.get((base, inverse))
    if known is None or len(known) <= n:
        factor = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, 1 << 16) + 1, factor, np.uint64)
        steps[0] = 1
        known = _POWERS[base, inverse] = np.cumprod(steps, dtype=np.uint64)
    return known


def _table(base: int):
    import numpy as np

    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def grams(data, size: int, base: int = _BASE):
    """Hashes of all ``size``-byte grams of a byte array, from its prefix polynomial hashes."""
    import numpy as np

    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_table(base)[data] * _powers(n, base, False)[:n], out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * _powers(n, base, True)[: n - size + 1])


def anchors(data, ends, length: int, gram: int = GRAM):
    """Positions of all anchors in joined texts that end at ``ends``, and their gram hashes."""
    import numpy as np

    hashes = grams(data, gram)
    wide = length - gram + 1
    m = len(hashes) - wide + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    half = np.uint64(32)  # of equal upper halves the leftmost, whatever else is in the batch
    key = (hashes >> half << half) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m])
    inside = np.ones(m, bool)  # the string that starts here lies in one text
    for end in ends[:-1]:
        inside[max(0, end - length + 1) : end] = False
    at = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, hashes[at]


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, "text", max_bytes=1 << 18):
        texts, names = [], []
        for text, one, two in zip(utf8(batch.column("text")), batch.column("t1").to_pylist(), batch.column("t2").to_pylist()):
            if len(text) >= length and (one, two) not in seen:
                seen.add((one, two))
                texts.append(text)
                names.append(one)
        if len(seen) > _SEEN:
            seen.clear()
        if not texts:
            continue
        ends = np.cumsum([len(t) for t in texts])
        at, hashes = anchors(np.frombuffer(b"".join(texts), np.uint8), ends.tolist(), length)
        if len(at):
            text = np.searchsorted(ends, at, side="right")
            begins = np.append(0, ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(np.array(names, np.int64)[text]), pa.array(at - begins[text])], ["h", "t1", "at"]
            )


def _surroundings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts with their anchors to places; a row without ``around`` is a repeat: ``at`` to ``at + back``."""
    import numpy as np

    reach = length - GRAM
    found: dict[bytes, tuple] = {}
    single: set[bytes] = set()
    repeats: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        rows = [(h, one, two, at, back, around) for around, (h, one, two, at, back) in found.items()]
        rows = [(h, one, two, at, back, around[2:]) for h, one, two, at, back, around in rows]
        rows += [(one ^ at, one, two, at, size, None) for one, two, at, size in repeats]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "t1", "t2", "at", "back", "around"])

    for batch in slices(batches, "text", rows=64, max_bytes=1 << 18):
        for text, one, two, places in zip(utf8(batch.column("text")), *(batch.column(n).to_pylist() for n in ("t1", "t2", "places"))):
            data = np.frombuffer(text, np.uint8)
            places = np.array(sorted(p for p in places if p + GRAM <= len(text)), np.int64)
            hashes = grams(data, GRAM).view(np.int64)[places].tolist() if len(places) else []
            for at, h in zip(places.tolist(), hashes):
                back = min(at, reach)
                around = text[at - back : at + length]
                key = back.to_bytes(2, "big") + around
                first = found.get(key)
                if first is None:
                    found[key] = (h, one, two, at, back)
                    single.add(key)
                    held += len(key)
                elif len(around) >= length and first[1:4] != (one, two, at):
                    if key in single:
                        single.discard(key)
                        repeats.append((first[1], first[2], first[3] - back, len(around)))
                    repeats.append((one, two, at - back, len(around)))
        if held > 16 << 20 or len(repeats) > 100_000:
            yield flushed()
            found, single, repeats, held = {}, set(), [], 0
    if found or repeats:
        yield flushed()


class _Sorted:
    """Places of several grams in suffix order, in one direction from the anchor.

    ``rows`` are byte strings side by side, ``size`` their lengths, ``group`` the gram of each
    (ascending). ``order`` lists the places sorted within their group and ``common`` the bytes
    that each shares with the one before it, -1 at the start of a group.
    """

    def __init__(self, rows, size, group):
        import numpy as np

        self.rows, self.size = rows, size
        opens = np.append(True, group[1:] != group[:-1])
        start = np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0))
        stop = np.append(np.flatnonzero(opens)[1:], len(group))[np.cumsum(opens) - 1]
        base = _BASE
        while True:
            table = _table(base)
            self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
            np.cumsum(table[rows] * _powers(rows.shape[1], base, False)[: rows.shape[1]], axis=1, out=self.prefix[:, 1:])
            self.order = self._merge_sort(start, stop)
            self.common = np.full(len(rows), -1, np.int64)
            after = np.flatnonzero(~opens)
            a, b = self.order[after - 1], self.order[after]
            self.common[after] = self._extension(a, b)
            if self._verified(a, b, self.common[after]):
                break
            base = (base * _BASE | 1) % (1 << 64)

    def _extension(self, a, b):
        """Bytes that rows ``a`` and ``b`` have in common from the start, by binary search on prefix hashes."""
        import numpy as np

        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live] + 1) >> 1
            same = self.prefix[a[live], mid] == self.prefix[b[live], mid]
            low[live[same]] = mid[same]
            high[live[~same]] = mid[~same] - 1

    def _less(self, a, b, or_equal):
        import numpy as np

        n = self._extension(a, b)
        short = np.minimum(self.size[a], self.size[b])
        inner = n < short
        last = self.rows.shape[1] - 1
        at = np.minimum(n, last)
        by_byte = self.rows[a, at] < self.rows[b, at]
        by_size = np.where(or_equal, self.size[a] <= self.size[b], self.size[a] < self.size[b])
        return np.where(inner, by_byte, by_size)

    def _merge_sort(self, start, stop):
        """Bottom-up: every element finds its rank in the run beside its own, all runs at once."""
        import numpy as np

        order = np.arange(len(start))
        slot = order - start  # place within the group
        width = 1
        longest = int((stop - start).max()) if len(start) else 0
        while width < longest:
            own = slot // width
            low = start + (own ^ 1) * width
            live = np.flatnonzero(low < stop)
            low = low[live]
            high = np.minimum(low + width, stop[live])
            first, right = low.copy(), (own[live] & 1).astype(bool)
            me = order[live]
            while True:
                busy = np.flatnonzero(low < high)
                if not len(busy):
                    break
                mid = (low[busy] + high[busy]) >> 1
                before = self._less(order[mid], me[busy], right[busy])
                low[busy[before]] = mid[before] + 1
                high[busy[~before]] = mid[~before]
            pair = start[live] + (own[live] & ~1) * width
            to = pair + slot[live] % width + (low - first)
            merged = order.copy()
            merged[to] = me
            order = merged
            width *= 2
        return order

    def _verified(self, a, b, common) -> bool:
        """Neighbours share the bytes they are said to share and then stand in byte order."""
        import numpy as np

        columns = np.arange(self.rows.shape[1])
        for k in range(0, len(a), 4096):
            i, j, n = a[k : k + 4096], b[k : k + 4096], common[k : k + 4096]
            if ((self.rows[i] != self.rows[j]) & (columns < n[:, None])).any():
                return False
            inner = n < np.minimum(self.size[i], self.size[j])
            at = np.minimum(n, len(columns) - 1)
            if (np.where(inner, self.rows[i, at] >= self.rows[j, at], self.size[i] > self.size[j])).any():
                return False
        return True


def repeated(rows: list[bytes], back, group, length: int):
    """(place, first, stop) of the repeated strings: places of equal ``group`` and their surroundings.

    ``first`` and ``stop`` are byte offsets from the anchor.
    """
    import numpy as np

    n, reach = len(rows), length - GRAM
    size = np.array([len(r) for r in rows], np.int64)
    ahead_size = size - back
    ahead = np.zeros((n, length), np.uint8)
    behind = np.zeros((n, max(1, reach)), np.uint8)
    for k, row in enumerate(rows):
        data = np.frombuffer(row, np.uint8)
        b = back[k]
        ahead[k, : len(data) - b] = data[b:]
        behind[k, :b] = data[:b][::-1]
    after, before = _Sorted(ahead, ahead_size, group), _Sorted(behind, back, group)

    def most(s: _Sorted):
        best = np.full(n, -1, np.int64)
        best[s.order] = np.maximum(s.common, np.append(s.common[1:], -1))
        return best

    reach_after, reach_before = most(after), most(before)
    live = np.flatnonzero((reach_after >= 0) & (reach_after + reach_before >= length))
    if not len(live):
        return np.zeros((0, 3), np.int64)
    hit = np.zeros((len(live), reach + 2), bool)  # one column more on the right: runs end there
    run_of = np.zeros(n, np.int64)

    def runs(s: _Sorted, least: int):
        run_of[s.order] = np.cumsum(s.common < least)
        return run_of[live]

    for o in range(max(0, length - int(reach_after[live].max())), min(reach, int(reach_before[live].max())) + 1):
        could = np.flatnonzero((reach_before[live] >= o) & (reach_after[live] >= length - o))
        if len(could) < 2:
            continue
        key = runs(before, o)[could] * n + runs(after, length - o)[could]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.append(same, False) | np.append(False, same)
        hit[could[order[twice]], o] = True
    edge = np.diff(np.concatenate([np.zeros((len(live), 1), np.int8), hit.astype(np.int8)], axis=1), axis=1)
    place, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)  # row by row, so starts and ends pair up
    return np.stack([live[place], -(high - 1), length - low], axis=1)


def _sort_places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Places sorted by gram to the byte ranges that repeat: t1, t2, start, stop."""
    import numpy as np

    group: list[tuple] = []
    ready: list[list[tuple]] = []
    held = 0

    def solved(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["t1", "t2", "start", "stop"])

    def settle() -> list[tuple]:
        out, rows, owners, groups = [], [], [], []
        for number, members in enumerate(ready):
            equal: dict[tuple, list] = {}
            for one, two, at, back, around in members:
                equal.setdefault((back, around), []).append((one, two, at))
            if len(equal) > 1:
                for (back, around), own in equal.items():
                    rows.append(around)
                    owners.append((own, back))
                    groups.append(number)
            for (back, around), own in equal.items():
                if len(own) > 1 and len(around) >= length:
                    out += [(one, two, at - back, at - back + len(around)) for one, two, at in own]
        if rows:
            back = np.array([b for _, b in owners], np.int64)
            for k, first, stop in repeated(rows, back, np.array(groups), length).tolist():
                out += [(one, two, at + first, at + stop) for one, two, at in owners[k][0]]
        return out

    def close() -> None:
        nonlocal group, held
        if len(group) > 1:
            ready.append(group)
            held += len(group)
        group = []

    last = None
    for batch in batches:
        direct = []
        for h, one, two, at, back, around in zip(*(batch.column(n).to_pylist() for n in ("h", "t1", "t2", "at", "back", "around"))):
            if around is None:
                direct.append((one, two, at, at + back))
                continue
            if h != last:
                close()
                last = h
                if held >= _CHUNK:
                    direct += settle()
                    ready, held = [], 0
            group.append((one, two, at, back, around))
        if direct:
            yield solved(direct)
    close()
    found = settle()
    if found:
        yield solved(found)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All strings around the anchors of hot grams by digest: w, t1, t2, start; equal ones of a task as one with n."""
    reach = length - GRAM
    for batch in slices(batches, "text", rows=64, max_bytes=1 << 18):
        counted: dict[bytes, dict] = {}
        for text, one, two, places in zip(utf8(batch.column("text")), *(batch.column(n).to_pylist() for n in ("t1", "t2", "places"))):
            starts = sorted({s for p in places for s in range(max(0, p - reach), min(p, len(text) - length) + 1)})
            for s in starts:
                counted.setdefault(hashlib.md5(text[s : s + length]).digest(), {})[one, two, s] = None
        rows = [(w, one, two, s, len(where)) for w, where in counted.items() for one, two, s in where]
        if rows:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["w", "t1", "t2", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated ranges to spans and what is kept."""
    for batch in slices(batches, "text"):
        out = []
        for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist()):
            spans: list[list[int]] = []
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], 0
            for start, stop in spans:
                kept.append(text[at:start])
                at = stop
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append(([{"start": a, "stop": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), rest if keep else None))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [batch.column("key"), batch.column("n_bytes"), pa.array([o[0] for o in out], kind)]
        columns += [pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = 20_000, keep: bool = False) -> DataFrame:
    """A row per input row: key, n_bytes, spans (removed byte ranges), kept_sha256, kept (its bytes, if ``keep``)."""
    spark = docs.sparkSession
    ship_code(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), body.alias("text")).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text")), "n_bytes": F.octet_length("text").cast("long")}
    )
    long = rows.filter(F.col("n_bytes") >= length)
    counted = long.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"))
    found = written(long.select("text", "t1", "t2").mapInArrow(partial(_find_anchors, length=length), "h long, t1 long, at long"), "anchors")
    places = found.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("at").alias("c"), F.max("at").alias("d")
    )
    often = places.filter("n > 1 and (a != b or c != d)").select("h", (F.col("n") > hot).alias("crowded"))
    often = written(often, "anchors-often")
    of_text = found.join(often, "h").groupBy("t1").agg(
        F.collect_set(F.when(~F.col("crowded"), F.col("at"))).alias("places"), F.collect_set(F.when(F.col("crowded"), F.col("at"))).alias("crowds")
    )
    known = written(counted.join(of_text, "t1", "left").filter("copies > 1 or places is not null"), "anchors-texts")

    # The one shuffle of texts; only those with a repeated gram stay.
    held = long.join(known, ["t1", "t2"], "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    needed = F.col("places").isNotNull() & (~copied | F.col("key").eqNullSafe(F.col("first")))
    held = held.select(
        "key",
        "t1",
        "t2",
        "n_bytes",
        copied.alias("copied"),
        "places",
        "crowds",
        F.when(needed, F.col("text")).alias("text"),
        F.when(copied, F.sha2(F.lit(b""), 256)).when(F.col("places").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        *([F.when(F.col("places").isNull() & ~copied, F.col("text").cast("binary")).when(copied, F.lit(b"")).alias("kept")] if keep else [F.lit(None).cast("binary").alias("kept")]),
    )
    held = written(held, "anchors-held")

    sources = held.filter("text is not null")
    around = sources.select("text", "t1", "t2", "places").mapInArrow(partial(_surroundings, length=length), PLACES)
    sorted_places = around.repartition("h").sortWithinPartitions("h", "around", "t1", "at")
    ranges = sorted_places.mapInArrow(partial(_sort_places, length=length), "t1 long, t2 long, start long, stop long")
    if often.filter("crowded").limit(1).count():
        crowds = sources.filter(F.size("crowds") > 0).select("text", "t1", "t2", F.col("crowds").alias("places"))
        strings = written(crowds.mapInArrow(partial(_strings, length=length), "w binary, t1 long, t2 long, start long, n long"), "crowds")
        same = strings.groupBy("w").agg(F.max("n").alias("m"), F.min(F.struct("t1", "t2", "start")).alias("a"), F.max(F.struct("t1", "t2", "start")).alias("b"))
        twice = strings.join(same.filter("m > 1 or a != b").select("w"), "w")
        ranges = ranges.unionByName(twice.select("t1", "t2", "start", (F.col("start") + length).alias("stop")))
    ranges = ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))

    named = "key long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string, kept binary"
    open_ = sources.filter("not copied").select("key", "n_bytes", "t1", "t2", "text")
    cut = open_.join(ranges, ["t1", "t2"], "left").select("key", "n_bytes", "text", "ranges").mapInArrow(partial(_cut, keep=keep), named)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    settled = held.filter("copied or places is null").select("key", "n_bytes", F.when(F.col("copied"), whole).otherwise(none).alias("spans"), "kept_sha256", "kept")
    short = rows.filter(F.col("n_bytes") < length)
    bytes_ = F.col("text").cast("binary")
    short = short.select("key", "n_bytes", none.alias("spans"), F.sha2(bytes_, 256).alias("kept_sha256"), (bytes_ if keep else F.lit(None).cast("binary")).alias("kept"))
    return cut.unionByName(settled).unionByName(short).withColumnRenamed("key", key)
