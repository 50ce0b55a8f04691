"""Personal data and the words that give it away, in DataFrame operations only.

Base spans are e-mail and IP addresses, payment cards and phone numbers, found by patterns over
whole texts (starts and ends in code points). Each distinct address or number is a protected
entity. The words around its mentions are held against the corpus: with ``near(w, e)`` the
occurrences of word ``w`` within ``WINDOW`` words of a mention of ``e``, ``c(w)`` all occurrences
of ``w``, ``W(e)`` the sum of ``near`` over all words and ``N`` the number of all words,

    information of e   IC(e) = log2(N / W(e))
    w tells about e    PMI(w; e) = log2(near(w, e) * N / (c(w) * W(e)))

and ``w`` discloses ``e`` where ``PMI >= threshold * IC`` in ``support`` different texts or more,
so that words of one document alone, however often it is copied, prove nothing. Beside a mention
of ``e`` such a word is generalised to its first letters if these disclose less than the
threshold, by the same measure, and removed otherwise.

Patterns give no offsets, so a text is cut at its matches and lengths are summed up: in chunks,
which keeps a text with very many matches cheap. The patterns never go back within a match.

Scale: one narrow scan finds mentions and the words beside them; pairs are summed before they are
shuffled. Word counts are taken over all texts, but a word that cannot be in a pair is counted
under no name: a bitmap of fixed size, built from the pairs, tells most of them apart, and a
false hit is only counted in vain. Pairs that disclose are joined by Spark's own choice, a
broadcast only if their written size is small.

Cases: a null text is empty; a match that fails its test is no span and is not tried again;
repeated rows count as occurrences and get equal results; rows of one id with different texts
are different rows; an empty table gives an empty result; further columns are ignored, except
that ``sanitise`` keeps all of them and puts its results in place of columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import bind
from staywise.session import written

#: Patterns of the contract, with possessive repeats and no start inside a run that failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: A character that every match of a kind holds: texts without it are not searched.
_HOLDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words on each side of a mention, looked for within so many characters.
WINDOW, REACH = 8, 120
#: A word of letters only, with what may surround it up to the white space.
TERM = r"^[^\p{L}\d@]*(\p{L}[\p{L}'-]*)[^\p{L}\d@]*$"
_WORDS = r"(?<![^\x20\x09-\x0D])[^\p{L}\d@\x20\x09-\x0D]*+(\p{L}[\p{L}'-]*+)[^\p{L}\d@\x20\x09-\x0D]*+(?![^\x20\x09-\x0D])"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CHUNK = 64


@dataclass(frozen=True)
class Disclosure:
    """When a word gives an entity away, and how many letters its general form keeps."""

    threshold: float = 0.9
    support: int = 3
    letters: int = 3
    #: Longs in the bitmap of words that are counted by name.
    bitmap: int = 1 << 12


def lower(word: Column) -> Column:
    return F.translate(word, _UPPER, _UPPER.lower())


def running(lengths: Column) -> Column:
    """The sums of an array's first 1, 2, ... elements."""
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all"))

    def sums(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: bind(a["s"] + x, lambda s: F.struct(s.alias("s"), F.array_append(a["all"], s).alias("all"))))["all"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: sums(F.slice(lengths, c * _CHUNK + 1, _CHUNK)))

    def joined(parts: Column) -> Column:
        before = lambda totals: F.flatten(F.transform(parts, lambda p, c: bind(F.when(c > 0, F.get(totals, c - 1)).otherwise(0), lambda b: F.transform(p, lambda x: x + b))))
        return bind(sums(F.transform(parts, lambda p: F.element_at(p, -1))), before)

    return bind(chunks, joined)


def pieces(text: Column, pattern: str, group: int = 0) -> tuple[Column, Column]:
    """The matches of a pattern in a text, and the text cut at them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """A match's test."""
    if kind == "ip":
        part = lambda p: bind(F.regexp_replace(p, "^0+", ""), lambda q: (F.char_length(q) < 4) & (F.coalesce(F.try_to_number(q, F.lit("999")), F.lit(0)) < 256))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return bind(_digits(value), lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), {"email": lower, "ip": lambda v: v}.get(kind, _digits)(value))


def _terms(context: Column, base: Column, last: bool) -> Column:
    """The words of a context next to a mention: term, start, end; ``base`` is where the context starts."""
    words, gaps = pieces(context, r"[^\x20\x09-\x0D]+")

    def placed(words: Column, gaps: Column) -> Column:
        lengths = F.transform(words, lambda w, i: F.char_length(F.get(gaps, i)) + F.char_length(w))
        near = lambda ends: F.slice(F.zip_with(words, ends, lambda w, e: F.struct(w.alias("w"), e.alias("e"))), *((F.greatest(F.size(ends) - WINDOW, F.lit(0)) + 1, F.lit(WINDOW)) if last else (F.lit(1), F.lit(WINDOW))))
        return bind(running(lengths), near)

    def term(x: Column) -> Column:
        body = F.regexp_extract(x["w"], TERM, 1)
        start = base + x["e"] - F.char_length(x["w"]) + F.char_length(F.regexp_extract(x["w"], r"^([^\p{L}\d@]*)", 1))
        return bind(body, lambda b: bind(start, lambda s: F.struct(lower(b).alias("term"), s.alias("start"), (s + F.char_length(b)).alias("end"))))

    listed = bind(words, lambda w: F.when(F.size(w) > 0, bind(gaps, lambda g: placed(w, g))))
    return F.filter(F.transform(listed, term), lambda t: t["term"] != "")


def _found(text: Column, kind: str) -> Column:
    """The spans of a kind, with their entity and the words beside them."""
    matches, gaps = pieces(text, PATTERNS[kind])
    if kind in _HOLDS:
        matches = F.when(F.instr(text, _HOLDS[kind]) > 0, matches)

    def each(m: Column, g: Column, ends: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            end = F.get(ends, i)
            start = end - F.char_length(v)
            before, after = F.get(g, i), F.get(g, i + 1)
            cut = F.char_length(before) > REACH
            left = F.when(cut, F.regexp_replace(F.right(before, F.lit(REACH)), r"^[^\x20\x09-\x0D]*", "")).otherwise(before)
            right = F.when(F.char_length(after) > REACH, F.regexp_replace(F.left(after, F.lit(REACH)), r"[^\x20\x09-\x0D]*$", "")).otherwise(after)
            near = F.concat(
                F.coalesce(bind(left, lambda c: _terms(c, start - F.char_length(c), True)), F.array()),
                F.coalesce(_terms(right, end, False), F.array()),
            )
            return F.struct(start.alias("start"), end.alias("end"), _entity(kind, v).alias("entity"), near.alias("near"))

        return F.transform(F.filter(F.transform(m, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: _holds(kind, x["v"])), lambda x: one(x["v"], x["i"]))

    steps = lambda m, g: F.transform(m, lambda v, i: F.char_length(F.get(g, i)) + F.char_length(v))
    spans = lambda m: bind(gaps, lambda g: bind(running(steps(m, g)), lambda ends: each(m, g, ends)))
    return bind(matches, lambda m: F.when(F.size(m) > 0, spans(m)))


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, print (of its text), spans (start, rank, kind, end) of the base kinds, near (entity, term, start, end)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("text"))
    kinds = [F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind"), _found(F.col("text"), k).alias("found")) for r, k in enumerate(KINDS)]
    found = rows.select("doc_id", F.xxhash64("text").alias("print"), F.array(*kinds).alias("kinds"))
    span = lambda k: F.transform(k["found"], lambda f: F.struct(f["start"].alias("start"), k["rank"].alias("rank"), k["kind"].alias("kind"), f["end"].alias("end")))
    beside = lambda f: F.transform(f["near"], lambda t: F.struct(f["entity"].alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))
    held = F.filter("kinds", lambda k: k["found"].isNotNull())
    return found.select(
        "doc_id",
        "print",
        F.array_sort(F.flatten(F.transform(held, span))).alias("spans"),
        F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(held, lambda k: k["found"])), beside))).alias("near"),
    )


def _word_counts(docs: DataFrame, text: str, pairs: DataFrame, rule: Disclosure) -> DataFrame:
    """level, name, c: occurrences of the words and first letters of ``pairs``; all words under level 0, name null and the rest."""
    place = lambda word: F.pmod(F.xxhash64(word), F.lit(64 * rule.bitmap))
    bits = pairs.select(F.explode(F.array("term", "general")).alias("name")).select(place(F.col("name")).alias("p")).distinct()
    bits = bits.groupBy(F.floor(F.col("p") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    table = [0] * rule.bitmap
    for r in bits.collect():  # at most as many rows as the bitmap has longs
        table[r["at"]] = r["bits"]
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one literal
    known = lambda word: bind(place(word), lambda p: F.getbit(F.get(held, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_WORDS), F.lit(1))).alias("word"))
    words = words.select(lower(F.col("word")).alias("word"))
    both = F.array(F.struct(F.lit(0).alias("level"), F.col("word").alias("name")), F.struct(F.lit(1).alias("level"), F.left(F.col("word"), F.lit(rule.letters)).alias("name")))
    named = words.select(F.explode(both).alias("n")).select("n.level", F.when(known(F.col("n.name")), F.col("n.name")).alias("name"))
    return named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("c"))


def disclosing(docs: DataFrame, found: DataFrame, rule: Disclosure, text: str = "text") -> DataFrame:
    """term, entity, tells (share of the entity's information, 0 to 1), action: the words that disclose an entity."""
    near = found.select("print", F.explode("near").alias("n")).groupBy("n.entity", "n.term", "print").agg(F.count(F.lit(1)).alias("c"))
    pairs = near.groupBy("entity", "term").agg(F.sum("c").alias("near"), F.count(F.lit(1)).alias("texts"))
    pairs = written(pairs.withColumn("general", F.left("term", F.lit(rule.letters))), "near-pairs")
    around = pairs.groupBy("entity").agg(F.sum("near").alias("around"))
    general = pairs.groupBy("entity", "general").agg(F.sum("near").alias("general_near"))
    candidates = written(pairs.filter(F.col("texts") >= rule.support).join(around, "entity").join(general, ["entity", "general"]), "near-pairs")
    counts = written(_word_counts(docs, text, candidates, rule), "word-counts")
    total = counts.filter("level = 0").agg(F.sum("c")).first()[0] or 0
    named = lambda level, name, c: counts.filter((F.col("level") == level) & F.col("name").isNotNull()).select(F.col("name").alias(name), F.col("c").alias(c))
    held = candidates.join(named(0, "term", "c"), "term").join(named(1, "general", "general_c"), "general")
    n = F.lit(float(total))
    information = F.log2(n / F.col("around"))
    tells = lambda near, c: F.when(information > 0, F.round(F.log2(F.col(near) * n / (F.col(c) * F.col("around"))) / information, 6)).otherwise(F.lit(0.0))
    judged = held.select("term", "entity", tells("near", "c").alias("tells"), tells("general_near", "general_c").alias("general_tells"))
    action = F.when(F.col("general_tells") < rule.threshold, F.lit("generalise")).otherwise(F.lit("remove"))
    return judged.filter(F.col("tells") >= rule.threshold).select("term", "entity", "tells", action.alias("action"))


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """A row per input row: doc_id, print, spans (start, rank, kind, end) and words (start, end, action) that disclose."""
    rule = rule or Disclosure()
    found = written(mentions(docs, key, text), "mentions")
    telling = written(disclosing(docs, found, rule, text), "disclosing")
    near = found.select("doc_id", "print", F.explode("near").alias("n")).select("doc_id", "print", "n.*")
    hits = near.join(telling.select("term", "entity", "action"), ["term", "entity"])
    # Removal goes before a general form where a word tells about several entities.
    hits = hits.groupBy("doc_id", "print", "start", "end").agg(F.max("action").alias("action"))
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("words"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    return found.join(hits, same, "left").select("doc_id", "print", "spans", F.coalesce("words", none).alias("words"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """All columns of ``docs``, with ``sanitised`` (text without personal data) and ``disclosures`` (spans: start, end, kind, put).

    A base span becomes its kind in brackets, a word its first letters and an ellipsis, or nothing.
    Overlapping spans are replaced together by what stands for the first of them.
    """
    rule = rule or Disclosure()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = spans_of(docs, key, text, rule)
    base = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"].alias("kind"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put")))
    word = F.transform("words", lambda w: F.struct(w["start"], w["end"], F.lit("term").alias("kind"), F.when(w["action"] == "remove", F.lit("")).alias("put")))
    marked = marked.select(F.col("doc_id").alias("__doc"), F.col("print").alias("__print"), F.array_sort(F.concat(base, word)).alias("disclosures")).dropDuplicates(["__doc", "__print"])
    names = [c for c in docs.columns if c not in ("sanitised", "disclosures")]
    own = docs.select(*names, F.col(key).alias("__key"), body.alias("__text"))
    joined = own.join(marked, own["__key"].eqNullSafe(marked["__doc"]) & (F.xxhash64("__text") == marked["__print"]), "left")
    cell = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        part = F.col("__text").substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        put = F.coalesce(s["put"], F.concat(F.col("__text").substr(s["start"] + 1, F.lit(rule.letters)), F.lit("…")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(part, put))).alias("out"))

    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.col("__text").substr(a["at"] + 1, F.char_length("__text")))
    return joined.select(*names, F.aggregate("disclosures", cell, step, rest).alias("sanitised"), "disclosures")
