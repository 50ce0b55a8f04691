"""Order statistics that never bring a whole group into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.session import written

def running_counts(df: DataFrame, by: list[str], order: str, weights: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``before_<w>``: the total of weight ``w`` over smaller ``order`` values in the same group.

    ``order`` must be a number and unique within a group (aggregate first). Values
    are cut into ranges of similar size; range totals give the offsets, and only
    the rows of one range are sorted together. There are four ranges for each of the
    session's shuffle partitions unless ``ranges`` says otherwise, so they grow as a
    cluster is set up for more data.
    """
    ranges = ranges or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    # Only the balance of the ranges depends on the sketch, so a coarse one will do.
    found = df.agg(F.percentile_approx(order, shares, max(1000, 4 * ranges)).alias("q")).first()["q"] or []
    inner = sorted({float(q) for q in found if abs(q) != float("inf")})
    splits = [-float("inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol="_range", handleInvalid="keep").transform(df)
    per_range = cut.groupBy(*by, "_range").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_off_range"),
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_off_{w}") for w in weights],
    )
    same = F.col("_range") == F.col("_off_range")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, same, "left")
    result = joined.withColumns(
        {f"before_{w}": F.coalesce(F.sum(w).over(within), F.lit(0)) + F.col(f"_off_{w}") for w in weights}
    )
    return result.drop("_range", "_off_range", *[f"_by_{b}" for b in by], *[f"_off_{w}" for w in weights])


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None, accuracy: int = 10000
) -> list[dict]:
    """Exact linearly interpolated quantiles, one dict per (group, feature).

    A first scan sketches every column and brackets each wanted rank; a second scan
    counts what lies below each bracket and looks only at values inside it. The
    sketch's error only decides the bracket's width: the count below shows whether
    the rank is really inside, and a bracket that missed is searched again in full.
    ``by`` must have few values, ``MAX_GROUPS`` at most: the brackets are carried as literals.
    """
    by = by or []
    # A margin of three times the sketch's nominal rank error on both sides.
    margin = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)})
    aggregates = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        aggregates += [
            F.count(v).alias(f"n_{i}"),
            F.min(v).alias(f"lo_{i}"),
            F.max(v).alias(f"hi_{i}"),
            F.percentile_approx(v, probes, accuracy).alias(f"q_{i}"),
        ]
    sketched = df.groupBy(*by).agg(*aggregates).limit(fv.MAX_GROUPS + 1) if by else df.agg(*aggregates)
    sketches = sketched.collect()
    if len(sketches) > fv.MAX_GROUPS:
        raise ValueError(f"more than {fv.MAX_GROUPS} groups of {by}")

    wanted, results = [], {}
    for g, row in enumerate(sketches):
        for i, c in enumerate(columns):
            n = row[f"n_{i}"]
            results[(g, c)] = {**{b: row[b] for b in by}, "feature": c, "count": n, "quantiles": [None] * len(shares)}
            if not n:
                continue
            sketch = dict(zip(probes, row[f"q_{i}"]))
            for s_index, s in enumerate(shares):
                rank = s * (n - 1)
                first = int(rank)
                low = sketch[min(1.0, max(0.0, s - margin))] if s - margin > 0 else row[f"lo_{i}"]
                high = sketch[min(1.0, max(0.0, s + margin))] if s + margin < 1 else row[f"hi_{i}"]
                wanted.append(
                    {
                        "group": g,
                        "feature": c,
                        "share": s_index,
                        "first": first,
                        "second": min(first + 1, n - 1),
                        "weight": rank - first,
                        "low": low,
                        "high": high,
                        "full": (row[f"lo_{i}"], row[f"hi_{i}"]),
                    }
                )
    groups = {g: tuple(row[b] for b in by) for g, row in enumerate(sketches)}
    found = _look_inside(df, by, columns, groups, wanted)
    missed = [w for w in wanted if _key(w) not in found]
    if missed:
        found.update(_look_inside(df, by, columns, groups, [{**w, "low": w["full"][0], "high": w["full"][1]} for w in missed]))
    for w in wanted:
        a, b = found[_key(w)]
        value = a if w["weight"] == 0 else a + (b - a) * w["weight"]
        results[(w["group"], w["feature"])]["quantiles"][w["share"]] = value
    return list(results.values())


def _key(w: dict) -> tuple:
    return w["group"], w["feature"], w["share"]


def _group_number(by: list[str], groups: dict) -> Column:
    """The number of a row's group, as an array position."""
    number = None
    for g, values in groups.items():
        tests = [F.col(b).eqNullSafe(F.lit(v)) for b, v in zip(by, values)]
        mine = reduce(and_, tests, F.lit(True))
        number = F.when(mine, F.lit(g)) if number is None else number.when(mine, F.lit(g))
    return number


def _look_inside(df: DataFrame, by: list[str], columns: list[str], groups: dict, wanted: list[dict]) -> dict:
    """Values at both ranks of every request whose bracket holds them."""
    if not wanted:
        return {}
    # One slot per feature and share; its bounds are looked up by group number.
    slots = sorted({(w["feature"], w["share"]) for w in wanted})
    by_place = {_key(w): j for j, w in enumerate(wanted)}
    numbered = df.withColumn("_group", _group_number(by, groups))
    below, kept, hit_tests = [], [], []
    for k, (feature, share) in enumerate(slots):
        places = [by_place.get((g, feature, share)) for g in groups]

        def per_group(name: str) -> Column:
            return F.get(F.array(*[F.lit(None if j is None else float(wanted[j][name])) for j in places]), F.col("_group"))

        place = F.get(F.array(*[F.lit(j).cast("int") for j in places]), F.col("_group"))
        v = F.col(f"`{feature}`").cast("double")
        real = ~F.isnan(v)
        below.append(F.count_if(real & (v < per_group("low"))).alias(f"b_{k}"))
        hit = F.coalesce(real & (v >= per_group("low")) & (v <= per_group("high")), F.lit(False))
        hit_tests.append(hit)
        kept.append(F.when(hit, F.struct(place.alias("j"), v.alias("value"))))
    # Few rows fall in any bracket; they are found by plain comparisons before anything is built per row.
    touched = numbered.where(reduce(or_, hit_tests)).select(F.explode(F.array(*kept)).alias("hit"))
    inside = touched.where(F.col("hit").isNotNull()).select("hit.j", "hit.value")
    # Equal values collapse before the shuffle, so a value that fills a third of the table is one row.
    counted = written(inside.groupBy("j", "value").agg(F.count(F.lit(1)).alias("n")), "brackets")
    ranked = running_counts(counted, ["j"], "value", ["n"])
    totals = {r["_group"]: r for r in numbered.groupBy("_group").agg(*below).collect()}

    def rank_in_bracket(w: dict, name: str) -> int:
        return w[name] - totals[w["group"]][f"b_{slots.index((w['feature'], w['share']))}"]

    ranks = df.sparkSession.createDataFrame(
        [(j, rank_in_bracket(w, "first"), rank_in_bracket(w, "second")) for j, w in enumerate(wanted)],
        "wanted_j int, first bigint, second bigint",
    )
    # One row per request: groups x features x shares.
    hits = ranked.join(F.broadcast(ranks), F.col("j") == F.col("wanted_j"))

    def holds(rank: str) -> Column:
        return (F.col("before_n") <= F.col(rank)) & (F.col(rank) < F.col("before_n") + F.col("n"))

    rows = (
        hits.where(holds("first") | holds("second"))
        .groupBy("j")
        .agg(F.max(F.when(holds("first"), F.col("value"))).alias("a"), F.max(F.when(holds("second"), F.col("value"))).alias("b"))
        .collect()
    )
    return {_key(wanted[r["j"]]): (r["a"], r["b"]) for r in rows if r["a"] is not None and r["b"] is not None}
