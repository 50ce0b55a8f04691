"""Quality rules: a threshold table compiled into one projection, without user functions.

The measures of a text (length, symbols, stop words, lines, repeated word windows) are
built-in expressions; each rule of the table bounds one ratio of them. Everything is
computed in one pass over the rows: no shuffle, no state, so skew and lost executors
cost nothing but the repeated tasks.

Cases: a null or empty text has no words and fails ``min_words``; ratios of a text without
words are 0; repeated rows are judged one by one; an empty table gives an empty result;
every input column is kept and the measures replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import SPACE, bind

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on with as at by from this be are or an "
    "der die das und in zu den von mit ist im des auf für ein eine als auch dem sich "
    "le la les de des et un une est dans que pour qui sur pas au avec par du en "
    "el los las del y que se por con para su una lo al como es de la en un"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is kept while ``low <= ratio <= high``."""

    name: str
    ratio: str
    low: float
    high: float


#: Limits after published heuristics for web text, loosened so that only clear junk falls.
DEFAULT_RULES = (
    Rule("length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", 0.0, 0.3),
    Rule("stop_words", "stop_word_share", 0.02, 1.0),
    Rule("lines", "dup_line_share", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


#: Up to so many repeated windows a text's words are held against the list of them; beyond, sorting is cheaper.
_SHORT_LIST = 24


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside a ``width``-word window that the text holds at least twice.

    Windows are compared by 64-bit hash. Sorting the hashes shows which repeat; only if
    any do, the positions of those are gathered, and their gaps give the covered words.
    """
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), x - F.get(places, i - 1))))
        return F.aggregate(gaps, none, lambda a, x: a + x)

    def by_list(hashes: Column, again: Column) -> Column:
        places = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
        return bind(places, covered)

    def by_sort(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
            hit = F.filter(pairs, lambda x, i: (same(i, i - 1) & (i > 0)) | (same(i, i + 1) & (i < F.size(pairs) - 1)))
            return bind(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

        return bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)

    def count(hashes: Column) -> Column:
        again = bind(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1))))
        return bind(
            again,
            lambda a: F.when(F.size(a) == 0, none).when(F.size(a) <= _SHORT_LIST, by_list(hashes, a)).otherwise(by_sort(hashes)),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) > width, bind(windows, count)).otherwise(none)


def _measures(body: Column, stop_words: list[str] | tuple[str, ...], window: int) -> Column:
    """All measures of a text as one struct."""
    known = sorted({v for w in stop_words for v in (w, w.capitalize())})
    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))
    long = lambda c, name: c.cast("long").alias(name)

    def measured(w: Column, a: Column) -> Column:
        return F.struct(
            long(F.size(w), "n_words"),
            long(F.char_length(F.array_join(w, "")), "word_chars"),
            long(F.regexp_count(body, F.lit(SYMBOLS)), "n_symbols"),
            long(F.size(a) - F.size(F.array_distinct(a)), "n_dup_lines"),
            _repeat_words(w, window).alias("n_repeat_words"),
            long(F.size(F.filter(w, lambda x: x.isin(known))), "n_stop_words"),
            long(F.size(a), "n_lines"),
        )

    return bind(words, lambda w: bind(lines, lambda a: measured(w, a)))


def with_measures(docs: DataFrame, text: str = "text", stop_words: list[str] | tuple[str, ...] = STOP_WORDS, window: int = 3) -> DataFrame:
    """Add the columns named in ``MEASURES``."""
    body = F.coalesce(F.col(text), F.lit(""))
    measured = docs.withColumn("__m", _measures(body, stop_words, window))
    return measured.withColumns({name: F.col(f"__m.{name}") for name in MEASURES}).drop("__m")


def _share(measures: Column, part: str, whole: str) -> Column:
    return F.when(measures[whole] > 0, measures[part] / measures[whole]).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...], measures: Column) -> Column:
    """The names of the broken rules, in table order, as one expression over the measures."""
    ratios = {
        "mean_word_length": _share(measures, "word_chars", "n_words"),
        "symbols_per_word": _share(measures, "n_symbols", "n_words"),
        "stop_word_share": _share(measures, "n_stop_words", "n_words"),
        "dup_line_share": _share(measures, "n_dup_lines", "n_lines"),
        "repeat_word_share": _share(measures, "n_repeat_words", "n_words"),
    }
    broken = [F.when(~ratios[r.ratio].between(r.low, r.high), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Add the measures, ``base_failed``, ``broken_rules`` and ``kept`` to every row.

    All of them are fields of one expression, so a filter on ``kept`` computes it once.
    """

    def judged(m: Column) -> Column:
        base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        decided = lambda d: F.struct(
            *[m[name].alias(name) for name in MEASURES],
            d["base"].alias("base_failed"),
            d["broken"].alias("broken_rules"),
            (~d["base"] & (F.size(d["broken"]) == 0)).alias("kept"),
        )
        return bind(F.struct(base.alias("base"), compile_rules(rules, m).alias("broken")), decided)

    body = F.coalesce(F.col(text), F.lit(""))
    verdict = docs.withColumn("__q", bind(_measures(body, STOP_WORDS, 3), judged))
    names = (*MEASURES, "base_failed", "broken_rules", "kept")
    return verdict.withColumns({name: F.col(f"__q.{name}") for name in names}).drop("__q")
