"""Jaccard join of word n-gram sets by PartEnum signatures, and the components of its links.

Two sets link when ``100 * |A and B| >= percent * |A or B|``. Sizes are cut into bands so that
linked sets lie in one band or two neighbouring ones; an instance covers two neighbouring bands,
and linked sets of an instance differ in at most ``k`` features. The feature domain is cut by
hash into ``(k + 2) // 2`` parts, so linked sets differ by at most one feature in some part, and
each part into three pieces, so they agree on two of its pieces. A signature is the projection
of a set on two pieces of a part: three per part, and linked sets share at least one. At low
thresholds pieces are small; there are then a fifth more parts, so linked sets agree in many, and
projections without features, which unrelated sets share, are left out (see ``signatures``).

1. Fingerprints: equal sets (128-bit) become one node, the least of their documents.
2. Signatures are combined in each task: sets with the same one hang on the first, and only the
   first moves on, so a signature that a third of all sets share is a few rows a task. After the
   shuffle each signature's firsts hang on the least of them. No pair within a signature is
   formed beyond these trees.
3. The trees' distinct edges are held against sizes and parity sketches: every feature flips one
   bit, so two sets differ in at least as many features as bits (a short sketch first, then one
   that grows with the set). What is left is verified on the words themselves, first the edge of most common signatures of each node, then only edges
   between what is still apart; links make components.
4. A signature whose members lie in several components may hide a link between two members that
   are not on one tree edge. Only for such signatures, members of different components are held
   against each other by size and parity sketch, and only pairs that this leaves possible are
   formed and verified. What is then apart shares no signature, differs too much or was found not to link,
   so no link between components is missed.

Cases: null and empty texts have an empty set and link with nothing; fewer words than ``width``
are one feature; rows of one id with different texts are documents of their own with that id, a null id
stands for its text; texts of any length are taken whole; of equal texts the least id names the set; repeated rows are counted once in step 2 and returned as often as they come; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import KEPT, few, let_go, light_batches, slices, small_batches, utf8
from staywise.llm.components import components
from staywise.session import ship_code, written

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
_KEPT_WORDS = 150_000
_FLUSH = 1 << 19
#: Rows of a batch that a task sends.
_SENT = 1 << 16
#: Longs in a parity sketch.
_PARITY = 32


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
KEPT.append(_HASHES)


def mix(x):
    """A 64-bit finaliser on a numpy array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII case and white space only."""
    return text.lower().split()


def features(words: list[bytes], width: int):
    """The distinct n-grams of a text as sorted 64-bit hashes."""
    import numpy as np

    if len(_HASHES) > _KEPT_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    n = min(width, len(h))
    grams = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(_MIX[2]) + h[k : len(h) - n + 1 + k])
    return np.unique(grams)


def bands(percent: int) -> Iterator[tuple[int, int]]:
    """The size bands, smallest first; linked sizes lie in one band or two neighbouring ones."""
    low = 1
    while True:
        high = low * 100 // percent
        yield low, high
        low = high + 1


class _Plan:
    """Bands, and for each instance its parts and how many of them any linked sets agree in; extended as larger sets come.

    Instance j joins bands j - 1 and j, and the sets of band j - 1 with each other. With ``spare``
    parts beyond what is needed, linked sets differ by at most one feature in ``spare + 1`` parts.
    """

    def __init__(self, percent: int):
        self.percent, self.source, self.low, self.high = percent, bands(percent), [], []
        self.parts: list[tuple[int, int]] = []

    def _extend(self) -> None:
        low, high = next(self.source)
        before = self.high[-1] if self.high else 0
        k = (before + high) * (100 - self.percent) // (100 + self.percent)
        need = (k + 2) // 2 if k else 0
        # Where two pieces of a part would hold few features, some of them are empty.
        spare = need // 5 if need and 2 * (self.low[-1] if self.low else low) < 24 * need else 0
        self.low.append(low)
        self.high.append(high)
        self.parts.append((need + spare, spare))

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(instance, parts, spare) of the two instances of a set."""
        import bisect

        while len(self.low) < 2 or self.low[-2] <= size:
            self._extend()
        band = bisect.bisect_right(self.low, size) - 1
        return [(j, *self.parts[j]) for j in (band, band + 1)]


def signatures(grams, plan: _Plan):
    """All PartEnum signatures of one set, for its own band's instance and the next.

    Two pieces without features are shared by many sets that have nothing else in common. Linked
    sets agree in more than ``spare`` parts, so a set with such pieces in no more than ``spare``
    parts does without them: in some other part the two agree on features.
    """
    import numpy as np

    out = []
    for instance, parts, spare in plan.of(len(grams)):
        if not parts:  # only equal sets link there, and they are one node
            continue
        piece = (grams >> np.uint64(32)) % np.uint64(parts) * np.uint64(3) + (grams & np.uint64(0xFFFFFFFF)) % np.uint64(3)
        piece = piece.astype(np.int64)
        sums = np.zeros(parts * 3, np.uint64)
        np.add.at(sums, piece, mix(grams + np.uint64(_MIX[2])))
        sums = sums.reshape(parts, 3)
        kept = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        place = np.arange(parts * 3, dtype=np.uint64).reshape(parts, 3) + np.uint64(instance << 40)
        signed = mix(kept ^ mix(place))
        held = np.bincount(piece, minlength=parts * 3).reshape(parts, 3)
        bare = held.sum(axis=1)[:, None] == held
        out.append(signed[~bare] if bare.any(axis=1).sum() <= spare else signed.reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(grams, bits: int = 64 * _PARITY) -> bytes:
    """The parity sketch: for each of its bits (a power of two), whether an odd number of features hashes there."""
    import numpy as np

    odd = np.bincount(((grams >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parity(grams) -> bytes:
    """A parity sketch of four bits or more for each feature."""
    return parity(grams, max(64 * _PARITY, 1 << (4 * len(grams)).bit_length()))


def least_difference(one: bytes, two: bytes) -> int:
    """Features in which two sets differ at least, by sketches of any sizes: the larger is folded upon itself."""
    if len(one) < len(two):
        one, two = two, one
    x, y = int.from_bytes(one, "big"), int.from_bytes(two, "big")
    size = 4 * len(one)  # half its bits
    while size >= 8 * len(two):
        x = (x >> size) ^ (x & ((1 << size) - 1))
        size //= 2
    return (x ^ y).bit_count()


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that their wide sketches leave possible."""
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("na", "nb", "wa", "wb"))
        keep = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (m + n) for m, n, x, y in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in slices(batches, "text"):
        sizes, one, two, sketches, wide = [], [], [], [], []
        for text in utf8(batch.column("text")):
            grams = features(words_of(text), width)
            sizes.append(len(grams))
            one.append(int(grams.sum(dtype=np.uint64)))
            two.append(int(mix(grams ^ np.uint64(_MIX[1])).sum(dtype=np.uint64)))
            sketches.append(np.frombuffer(parity(grams), np.int64))
            wide.append(wide_parity(grams))
        as_long = lambda v: pa.array(mix(np.array(v, np.uint64)).view(np.int64))
        columns = [batch.column("doc_id"), batch.column("doc"), batch.column("print"), pa.array(sizes, pa.int64()), as_long(one), as_long(two)]
        columns += [pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "print", "n", "h1", "h2", "parity", "wide"])
    let_go()


def _signed(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """sig, set, parent: firsts of this task (parent null) and the sets that hang on them."""
    import numpy as np

    plan, sigs, owners, held = _Plan(percent), [], [], 0
    seen: set[int] = set()

    def flushed() -> Iterator[pa.RecordBatch]:
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        opens = np.append(True, sig[1:] != sig[:-1])
        fresh = opens | np.append(True, own[1:] != own[:-1])
        first = own[np.maximum.accumulate(np.where(opens, np.arange(len(sig)), 0))]
        keep = np.flatnonzero(fresh)
        keep = keep[np.argsort(own[keep], kind="stable")]  # rows of one set side by side compress well
        parent = pa.array(first[keep], mask=opens[keep])
        rows = pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(own[keep]), parent], ["sig", "set", "parent"])
        return (rows.slice(at, _SENT) for at in range(0, rows.num_rows, _SENT))

    for batch in slices(batches, "text"):
        for text in utf8(batch.column("text")):
            grams = features(words_of(text), width)
            if not len(grams):
                continue
            name = int(mix(grams.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
            if name in seen:
                continue
            seen.add(name)
            sig = signatures(grams, plan)
            if len(sig):
                sigs.append(sig.view(np.int64))
                owners.append(np.full(len(sig), name, np.int64))
                held += len(sig)
        if held >= _FLUSH:
            yield from flushed()
            sigs, owners, held = [], [], 0
            seen.clear()
    if held:
        yield from flushed()
        sigs, owners = [], []
    let_go()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig, firsts before the rest, to tree edges: sig, parent, child."""
    import numpy as np

    last, head, before = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column("sig").to_numpy()
        own = batch.column("set").to_numpy()
        is_first = batch.column("parent").is_null().to_numpy(zero_copy_only=False)
        hung = batch.column("parent").fill_null(0).to_numpy()
        opens = np.append(last is None or sig[0] != last, sig[1:] != sig[:-1])
        at = np.maximum.accumulate(np.where(opens, np.arange(len(sig)), -1))
        top = np.where(at >= 0, own[at], 0 if head is None else head)
        parent = np.where(is_first, top, hung)
        again = np.append(before is not None and last == sig[0] and before == (own[0], parent[0]), (sig[1:] == sig[:-1]) & (own[1:] == own[:-1]) & (parent[1:] == parent[:-1]))
        keep = (own != parent) & ~again
        last, head, before = sig[-1], top[-1], (own[-1], parent[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(parent[keep]), pa.array(own[keep])], ["sig", "parent", "child"])


def _linked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts' n-gram sets link, compared word by word."""
    sets: dict[int, set] = {}

    def grams(node: int, text: str) -> set:
        if node not in sets:
            if len(sets) >= 64 or sum(map(len, sets.values())) > 100_000:
                sets.clear()
            words = words_of((text or "").encode())
            sets[node] = set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)}
        return sets[node]

    for batch in slices(batches, "text_a", rows=64):
        links = []
        for a, b, ta, tb in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))):
            x, y = grams(a, ta), grams(b, tb)
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["u", "v"])
    let_go()


def _document(key: str, text: str) -> Column:
    """The document a row belongs to: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string")))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """A row per input row: key, n_shingles, component_id (least key reachable by links), n_links.

    ``n_links`` counts the verified links between different sets at the row's set: those that
    were needed to settle the components, not all that exist.
    """
    known = _settled(docs, key, text, width, percent)
    least = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its least document, once.

    A document is an id and a text: rows of one id with different texts are judged apart.
    """
    known = written(few(_settled(docs, key, text, width, percent).select("doc", "print", "root")), "gram-known")
    linked = known.filter(F.col("root").isNotNull())
    first = linked.groupBy("root").agg(F.min(F.struct("doc", "print")).alias("first")).select("first.doc", "first.print")
    names = ["__doc", "__print"]
    gone = linked.select("doc", "print").distinct().join(first, ["doc", "print"], "left_anti")
    gone = written(few(gone.toDF(*names)), "gram-gone")
    twice = written(few(known.groupBy("doc", "print").count().filter("count > 1").select("doc", "print").toDF(*names)), "gram-twice")
    own = docs.withColumns({"__doc": _document(key, text), "__print": F.xxhash64(F.col(text).cast("string"))}).join(gone, names, "left_anti")
    once = own.join(twice, names, "left_anti").unionByName(own.join(twice, names, "left_semi").dropDuplicates(names))
    return once.select(*docs.columns)


def _settled(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """A row per input row: doc_id, doc, print (of its text), n (features), root (a node of the component), component_id, n_links."""
    spark = docs.sparkSession
    ship_code(spark)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _document(key, text).alias("doc"), F.xxhash64(body).alias("print"), body.alias("text"))
    named = "doc_id long, doc long, print long, n long, h1 long, h2 long, parity array<bigint>, wide binary"
    with light_batches(spark):
        sets = written(rows.mapInArrow(partial(_fingerprints, width=width), named), "gram-sets")
    nodes = sets.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.min(F.struct("doc", "print")).alias("from"), F.max("n").alias("n"), F.min("doc_id").alias("least"), F.first("parity").alias("parity"), F.first("wide").alias("wide"))
    # A node is called after its least document; where an id has several texts, one node has its name.
    first = nodes.groupBy("doc").agg(F.min(F.struct("h1", "h2")).alias("first"))
    name = F.when(F.struct("h1", "h2") == F.col("first"), F.col("doc")).otherwise(F.xxhash64("doc", "h1", "h2"))
    nodes = written(nodes.join(first, "doc").withColumn("node", name).drop("doc", "first"), "gram-nodes")

    signed = rows.select("text").mapInArrow(partial(_signed, width=width, percent=percent), "sig long, set long, parent long")
    ordered = signed.repartition("sig").sortWithinPartitions("sig", F.col("parent").asc_nulls_first(), "set")
    with light_batches(spark):
        trees = written(ordered.mapInArrow(_trees, "sig long, parent long, child long"), "gram-trees")

    side = lambda s: nodes.select(F.col("h1").alias(f"h{s}"), F.col("node").alias(s), F.col("n").alias(f"n{s}"))

    def words(prefix: str = "") -> list[Column]:
        """The parity sketch folded once, as columns: plain longs keep a join's condition compact."""
        half = _PARITY // 2
        return [F.col("parity")[i].bitwiseXOR(F.col("parity")[i + half]).alias(f"{prefix}w{i}") for i in range(half)]

    sketch = lambda s: nodes.select(F.col("node").alias(s), *words(s))

    def may_link(x: str, y: str, px: str, py: str) -> Column:
        """Sizes and parity sketches leave a link possible."""
        bits = sum((F.bit_count(F.col(f"{px}w{i}").bitwiseXOR(F.col(f"{py}w{i}"))) for i in range(_PARITY // 2)), F.lit(0))
        sizes = 100 * F.least(x, y) >= percent * F.greatest(x, y)
        return sizes & ((100 + percent) * bits <= (100 - percent) * (F.col(x) + F.col(y)))

    def linked(candidates: DataFrame) -> DataFrame:
        wide = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("wide").alias(f"w{s}"))
        sketched = candidates.select("a", "b").join(wide("a"), "a").join(wide("b"), "b")
        candidates = sketched.mapInArrow(partial(_possible, percent=percent), "a long, b long").distinct()
        with small_batches(spark):
            candidates = written(few(candidates), "gram-possible")
        need = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct()
        # Written, so that Spark knows its size before it deals out the texts.
        wanted = written(few(nodes.join(need, "node").select("node", F.col("from.doc").alias("doc"), F.col("from.print").alias("print"))), "gram-wanted")
        found = rows.select("doc", "print", "text").join(wanted, ["doc", "print"]).dropDuplicates(["doc", "print"])
        texts = written(found.select("node", "text"), "gram-texts")
        held = candidates.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
        )
        with small_batches(spark, 128):
            return written(held.mapInArrow(partial(_linked, width=width, percent=percent), "u long, v long"), "gram-links")

    edges = trees.groupBy(F.col("parent").alias("ha"), F.col("child").alias("hb")).agg(F.count(F.lit(1)).alias("c"))
    both = edges.join(side("a"), "ha").join(side("b"), "hb").filter((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c", F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"))
    both = both.select(*ends, F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    both = both.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    tried = both.join(sketch("a"), "a").join(sketch("b"), "b").filter(may_link("na", "nb", "a", "b"))
    tried = written(tried.select("a", "b", "c"), "gram-pairs")
    # First each node with the one it shares most signatures with, then what is still apart.
    closest = tried.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    links = linked(closest)
    labels = written(few(components(links)), "gram-labels")
    joined = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    apart = tried.join(joined("a"), "a", "left").join(joined("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    apart = written(apart.select("a", "b").join(closest, ["a", "b"], "left_anti"), "gram-pairs")
    links = links.unionByName(linked(apart))
    labels = written(few(components(links)), "gram-labels")

    # Signatures whose members are not all in one component.
    label = nodes.join(labels, "node", "left").select("h1", "node", "n", "parity", F.coalesce("component", "node").alias("component"))
    label = written(label, "gram-label")
    of = lambda s: label.select(F.col("h1").alias(s), F.col("component").alias(f"c_{s}"))
    split = trees.join(of("parent"), "parent").join(of("child"), "child").filter("c_parent != c_child").select("sig").distinct()
    held = trees.join(split, "sig")
    members = held.select("sig", F.col("parent").alias("h1")).union(held.select("sig", F.col("child").alias("h1"))).distinct()
    crowd = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("h1").cast("decimal(38,0)")).alias("who"))
    once = crowd.filter("n > 2").groupBy("n", "who").agg(F.min("sig").alias("sig"))  # signatures with the same members say the same
    apart = members.join(once.select("sig"), "sig").join(label, "h1").select("sig", "node", "n", "component", *words())
    apart = written(apart, "gram-apart")
    x, y = apart.alias("x"), apart.alias("y")
    same = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") < F.col("y.component"))
    cross = x.join(y, same & may_link("x.n", "y.n", "x.", "y."))
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = written(cross.join(tried, ["a", "b"], "left_anti"), "gram-cross")
    extra = linked(more) if more.limit(1).count() else None
    if extra is not None and extra.limit(1).count():
        links = links.unionByName(extra)
        labels = written(few(components(links)), "gram-labels")

    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = nodes.drop("parity", "wide").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").join(degree, "node", "left").select("h1", "h2", "root", "component_id", "n_links")
    return sets.join(known, ["h1", "h2"], "left").select("doc_id", "doc", "print", "n", "root", "component_id", "n_links")
