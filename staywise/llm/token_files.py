"""Token files: whole texts as token ids in Simple-8b words, read back without a loop over ids.

Format. A file is a row of frames; a frame holds whole consecutive documents, closes at
``frame_ids`` ids and ends with one newline byte:

    8 bytes  magic ``S8BFRAME``
    7 x u64  range number, ids of the range before this frame, ids, documents, blocks, words, escapes
    i64[documents] doc ids, u8[documents] flags (1: the id is null)
    u64[documents] ids of each document
    u32[blocks]    word at which each block of ``BLOCK`` ids starts
    u64[words]     selector in the top 4 bits, ids in the lower 60, first id lowest
    u64[escapes]   ids of 60 bits and more; selector 0 points into this list

All numbers are little-endian. The 15 packing selectors trade width for count; a block's last
word may have room to spare, which the block's length tells. Blocks start at whole words, so
any block is decoded alone, and all words of one selector are decoded at once.

Order. Documents are dealt into ranges of ascending doc_id (bounds from quantiles of the id
column), sorted within each range and written by Spark's own committed writer, so a lost
executor repeats its range. A range counts ids from 0; the manifest, one row per range, holds
how many ids come before it.

Cases: a null or empty text is just its end id; null doc ids come first; rows with equal doc
ids keep to one range, ordered by text; an empty table writes no frame; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.common import KEPT, bind, light_batches, not_above, slices, small_batches, utf8
from staywise.session import ship_code, written

MAGIC = b"S8BFRAME"
BLOCK = 1024
#: Ids per word and bits per id, by selector; selector 0 is the escape (fixed values of the format).
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0)

_TOKENIZERS: dict[str, tuple] = {}
KEPT.append(_TOKENIZERS)
#: Words, stems and runs of marks a worker keeps, besides those of one text; bytes of a word that is kept.
_CACHED_WORDS, _CACHED_STEMS, _CACHED_MARKS, _CACHED_BYTES = 500_000, 650_000, 10_000, 64
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# -- Simple-8b ---------------------------------------------------------------------------


def pack(ids):
    """(block starts, words, escapes) of an array of unsigned 64-bit ids.

    Every position first gets the densest selector that its block allows; then all blocks
    step through their words side by side.
    """
    import numpy as np

    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    blocks, gap = -(-n // BLOCK), max(COUNTS)
    # Each block is followed by zeros, so a word may end past its block.
    padded = np.zeros((blocks, BLOCK + gap), ids.dtype)
    for k in range(0, n, BLOCK):
        padded[k // BLOCK, : min(BLOCK, n - k)] = ids[k : k + BLOCK]
    padded = padded.reshape(-1)
    top = int(ids.max()).bit_length()
    selector = np.zeros(len(padded), np.uint8)
    for s in range(14, 0, -1):  # denser selectors overwrite
        if s > 1 and top <= WIDTHS[s - 1]:
            continue  # the next one overwrites all
        narrow = np.flatnonzero(padded < (1 << WIDTHS[s])) if top > WIDTHS[s] else np.arange(len(padded))
        span = COUNTS[s] - 1
        selector[narrow[: len(narrow) - span][narrow[span:] - narrow[: len(narrow) - span] == span]] = s
    selector = selector.reshape(blocks, -1)[:, :BLOCK].reshape(-1)[:n]
    free = np.flatnonzero(selector == 0)
    escapes = ids[free].astype(np.uint64)
    after = np.arange(n) + np.array(COUNTS)[selector]
    place = np.arange(0, n, BLOCK)
    ends = np.minimum(place + BLOCK, n)
    opens = np.zeros(n, bool)
    while len(place):
        opens[place] = True
        place = after[place]
        live = place < ends
        if not live.all():
            place, ends = place[live], ends[live]
    first = np.flatnonzero(opens)
    sel = selector[first]
    at = first + first // BLOCK * gap
    padded = padded.astype(np.uint64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        start, word = at[own], words[own]
        for k in range(COUNTS[s] if len(own) else 0):
            word |= padded[start + k] << np.uint64(k * WIDTHS[s])
        words[own] = word
    own = sel == 0
    words[own] |= np.searchsorted(free, first[own]).astype(np.uint64)
    return np.searchsorted(first, np.arange(0, n, BLOCK)).astype(np.uint32), words, escapes


def unpack(starts, words, escapes, n: int):
    """The ``n`` ids of packed blocks."""
    import numpy as np

    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS)[sel]
    block = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    before = np.cumsum(counts) - counts
    first = block * BLOCK + before - before[starts][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            to = first[own] + k
            has = to < stop[own]
            out[to[has]] = (words[own[has]] >> np.uint64(k * WIDTHS[s])) & mask
    own = np.flatnonzero(sel == 0)
    out[first[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def frame(number: int, before: int, docs: list[tuple[int | None, int]], ids) -> bytes:
    """One frame; ``docs`` are (doc id, number of ids)."""
    import numpy as np

    starts, words, escapes = pack(ids)
    head = np.array([number, before, len(ids), len(docs), len(starts), len(words), len(escapes)], "<u8")
    parts = (
        head.tobytes(),
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        bytes(d is None for d, _ in docs),
        np.array([k for _, k in docs], "<u8").tobytes(),
        starts.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(),
        escapes.astype("<u8").tobytes(),
    )
    return MAGIC + b"".join(parts)


def frames(data) -> Iterator[tuple[int, int, list, list, object]]:
    """(range, ids before, doc ids, ids per document, ids) of every frame in a file's bytes."""
    import numpy as np

    view, at = memoryview(data), 0
    while at < len(view):
        if bytes(view[at : at + 8]) != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        number, before, n, docs, blocks, words, escapes = (int(x) for x in np.frombuffer(view, "<u8", 7, at + 8))
        at += 64
        arrays = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks), ("<u8", words), ("<u8", escapes)):
            arrays.append(np.frombuffer(view, kind, count, at))
            at += arrays[-1].nbytes
        if view[at] != 0x0A:
            raise ValueError(f"no frame end at byte {at}")
        at += 1
        doc, flags, counts, starts, packed, rare = arrays
        ids = unpack(starts.astype(np.int64), packed, rare, n)
        yield number, before, [None if f else int(d) for d, f in zip(doc, flags)], counts.astype(np.int64).tolist(), ids


# -- Tokens ------------------------------------------------------------------------------


def _u32(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of words as u32 bytes, encoded when first asked for.

    Most words are Latin letters with ASCII marks behind, if any. For those the tokenizer's
    steps before its merges do nothing but lower-case, split off the marks as one piece and
    spell out bytes, so the merges are asked directly and once for all spellings of a word.
    Every other word goes through the whole tokenizer.

    Most different words come once, so a spelling is kept when its stem was met before.
    """

    def __init__(self, tokenizer):
        import re

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.stems, self.marks = tokenizer, {}, {}
        self.merge = tokenizer.model.tokenize
        self.plain = re.compile("([a-zà-öø-ÿß]+)([!-/:-@[-`{-~]*)").fullmatch
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def encode(self, word: str) -> bytes:
        return _u32(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > _CACHED_BYTES:
            return self.encode(word.decode())
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # of bytes: ASCII alone
            mark, stem = word[len(stem) :], stem.lower()
        else:
            text = word.decode()
            plain = self.plain(text.lower())
            if not plain:
                ids = self[word] = self.encode(text)
                return ids
            stem, mark = plain[1].encode(), plain[2].encode()
        ids = self.stems.get(stem)
        met = ids is not None
        if not met:
            ids = self.stems[stem] = _u32([t.id for t in self.merge(stem.decode().translate(self.spelling))])
        if mark:
            if mark not in self.marks:
                self.marks[mark] = self.encode(mark.decode())
            ids += self.marks[mark]
        if met:
            self[word] = ids
        return ids

    def trim(self) -> None:
        """Bounds what is kept: by beginning anew; a table of older words beside it took more time and memory."""
        for kept, most in ((self, _CACHED_WORDS), (self.stems, _CACHED_STEMS), (self.marks, _CACHED_MARKS)):
            if len(kept) > most:
                kept.clear()


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS[path] = tokenizer, _Words(tokenizer)
    return _TOKENIZERS[path]


def encode_texts(texts: list[bytes], path: str, by_word: bool) -> Iterator[bytes]:
    """The ids of each text as little-endian u32 bytes.

    ``by_word`` is for lower-casing byte-level tokenizers that drop white space and split words from
    marks, such as the supplied word vocabulary: words are encoded once and looked up again.
    """
    tokenizer, known = _tokenizer(path)
    if not by_word:
        for done in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
            yield _u32(done.ids)
        return
    for text in texts:
        known.trim()  # here, since a caller need not ask for more than the last text
        yield b"".join(map(known.__getitem__, text.split()))


def _write_frames(batches: Iterator[pa.RecordBatch], path: str, by_word: bool, end_id: int, frame_ids: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    end = np.array([end_id], "<u4").tobytes()
    number, before, docs, held, n = None, 0, [], [], 0

    def closed() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), "<u4")
        return pa.RecordBatch.from_arrays([pa.array([frame(number, before, docs, ids)], pa.binary())], ["frame"])

    for batch in slices(batches, "text"):
        texts = utf8(batch.column("text"))
        for rng, doc, data in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), encode_texts(texts, path, by_word)):
            if docs and (rng != number or n >= frame_ids):
                yield closed()
                before, docs, held, n = before + n, [], [], 0
            if rng != number:
                number, before = rng, 0
            held += [data, end]
            docs.append((doc, len(data) // 4 + 1))
            n += docs[-1][1]
    if docs:
        yield closed()


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 1,
    by_word: bool = True,
    key: str = "doc_id",
    text: str = "text",
    range_bytes: int = 8 << 20,
    frame_ids: int = 1 << 18,
    frames_per_file: int = 16,
) -> None:
    """Encode every text and write the frames below ``folder``, about ``range_bytes`` of text to a range.

    ``by_word``: see ``encode_texts``.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n = max(1, min(10_000, size // range_bytes))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("b")).first().b if n > 1 else None
    bounds = sorted(set(bounds or []))
    number = bind(F.col("doc_id"), lambda d: not_above(d, bounds)).alias("range")
    parts = max(min(n, 4 * spark.sparkContext.defaultParallelism), n // 4)  # a few ranges each, however many there are
    dealt = rows.select(number, "doc_id", "text").repartition(parts, "range").sortWithinPartitions("range", "doc_id", "text")
    encode = partial(_write_frames, path=tokenizer, by_word=by_word, end_id=end_id, frame_ids=frame_ids)
    encoded = dealt.mapInArrow(encode, "frame binary")
    lines = encoded.select(F.col("frame").cast("string").alias("value"))
    with small_batches(spark):
        lines.write.option("maxRecordsPerFile", frames_per_file).text(folder)


def _read_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for k in range(batch.num_rows):
            for number, before, docs, counts, ids in frames(batch.column("content")[k].as_buffer()):
                stops = np.cumsum(counts, dtype=np.int64)
                offsets = np.concatenate([[0], 4 * stops]).astype(np.int32)
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(docs), pa.int64()),
                        pa.array(docs, pa.int64()),
                        pa.array(before + stops - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets.tobytes()), raw]),
                    ],
                    ["range", "doc_id", "place", "n_tokens", "ids"],
                )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in the files: range, doc_id, place of the first id in the range, n_tokens, ids (little-endian u32)."""
    ship_code(spark)
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_read_frames, "range long, doc_id long, place long, n_tokens long, ids binary")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    read = read_token_files(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    with light_batches(spark):  # a file or so at a time
        index = written(read, "token-index")
    totals = index.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect()  # 10,000 ranges at most
    manifest, before = [], 0
    for row in totals:
        manifest.append((row.range, before))
        before += row.n
    if not manifest:
        return index.select("doc_id", F.col("place").alias("start"), "n_tokens", "ids_crc32")
    bases = spark.createDataFrame(manifest, "range long, base long")
    placed = index.join(F.broadcast(bases), "range")
    return placed.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
