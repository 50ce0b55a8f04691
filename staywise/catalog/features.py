"""Splits, fitted transforms, text vectors and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.catalog.data_checks import enriched
from staywise.catalog.registry import query
from staywise.catalog.sql_views import CUSTOMERS, ENRICHED
from staywise.functions.vectors import as_vector
from staywise.operators import notes, oversample, preprocess, splits
from staywise.operators.clean import prefixed_columns
from staywise.plans import stand_in
from staywise.plans.feature_build import build_features, wide_features
from staywise.session import new_folder, written
from staywise.sources import tables


def _quota_sql(source, label, key, order):
    """Exact test and validation quotas by largest remainder, then ranges of the seeded order."""
    return f"""
n AS (SELECT {label} AS y, count(*) AS n FROM {source} GROUP BY 1),
t0 AS (SELECT y, n, sum(n) OVER () AS total, CAST(ceil(sum(n) OVER () * 0.15::DOUBLE) AS BIGINT) AS draw FROM n),
t1 AS (SELECT *, CAST((n * draw) // total AS BIGINT) AS base, row_number() OVER (ORDER BY (n * draw) % total DESC, y) AS place FROM t0),
t2 AS (SELECT y, n, base + CASE WHEN place <= draw - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM t1),
w0 AS (SELECT y, n, test, n - test AS rest, sum(n - test) OVER () AS total,
              CAST(ceil(sum(n - test) OVER () * (0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))) AS BIGINT) AS draw FROM t2),
w1 AS (SELECT *, CAST((rest * draw) // total AS BIGINT) AS base, row_number() OVER (ORDER BY (rest * draw) % total DESC, y) AS place FROM w0),
w2 AS (SELECT y, test, base + CASE WHEN place <= draw - sum(base) OVER () THEN 1 ELSE 0 END AS val FROM w1),
rk AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS place FROM {source}),
sp AS (SELECT rk.* EXCLUDE (place), CASE WHEN place <= test THEN 'test' WHEN place <= test + val THEN 'val' ELSE 'train' END AS split
       FROM rk JOIN w2 ON rk.{label} = w2.y)
"""


_CUSTOMER_ORDER = "md5('42:' || customerID) || ':' || customerID"
_ORDERS_ORDER = "md5('42:' || CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR)"
_SPLIT = CUSTOMERS + ", " + _quota_sql("v", "Churn", "customerID", _CUSTOMER_ORDER)


@query("stratified_split", _SPLIT + "SELECT customerID, Churn, split FROM sp")
def stratified_split(spark, sf):
    return splits.stratified_split(stand_in.customers(spark, sf)).select(fv.ID, fv.TARGET, "split")


@query(
    "stratified_split_orders",
    "WITH " + _quota_sql("orders", "o_orderstatus", "o_orderkey", _ORDERS_ORDER) + "SELECT o_orderkey, o_orderstatus, split FROM sp",
)
def stratified_split_orders(spark, sf):
    orders = stand_in.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_split(orders, label="o_orderstatus", id_column="o_orderkey")


@query(
    "stratified_folds",
    CUSTOMERS
    + f""", rk AS (SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY {_CUSTOMER_ORDER}) AS place,
                        count(*) OVER (PARTITION BY Churn) AS n FROM v)
      SELECT customerID, Churn, CAST(CASE WHEN place <= n * 1 // 5 THEN 0 WHEN place <= n * 2 // 5 THEN 1 WHEN place <= n * 3 // 5 THEN 2
             WHEN place <= n * 4 // 5 THEN 3 ELSE 4 END AS BIGINT) AS fold FROM rk""",
)
def stratified_folds(spark, sf):
    return splits.stratified_folds(stand_in.customers(spark, sf)).select(fv.ID, fv.TARGET, "fold")


_SCALED = (
    _SPLIT
    + """, x AS (SELECT customerID, split, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges, TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges FROM sp),
m AS (SELECT median(tenure) AS m0, median(MonthlyCharges) AS m1, median(TotalCharges) AS m2 FROM x WHERE split = 'train'),
f AS (SELECT customerID, split, coalesce(tenure, m0) AS a, coalesce(MonthlyCharges, m1) AS b, coalesce(TotalCharges, m2) AS c FROM x, m),
p AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f WHERE split = 'train')
"""
)


@query(
    "impute_and_scale",
    _SCALED
    + "SELECT customerID, split, round((a - ma) / sa, 6) AS num__tenure, round((b - mb) / sb, 6) AS num__MonthlyCharges, "
    "round((c - mc) / sc, 6) AS num__TotalCharges FROM f, p",
)
def impute_and_scale(spark, sf):
    split = splits.stratified_split(stand_in.customers(spark, sf))
    fitted = preprocess.fit_structured(split.where("split = 'train'"), categories=[])
    scaled = fitted.apply(split, [fv.ID, "split"])
    return scaled.withColumns({n: F.round(n, 6) for n in fitted.names()})


@query(
    "fitted_numbers",
    _SCALED
    + "SELECT 'tenure' AS feature, round(m0, 6) AS median, round(ma, 6) AS mean, round(sa, 6) AS spread FROM m, p "
    "UNION ALL SELECT 'MonthlyCharges', round(m1, 6), round(mb, 6), round(sb, 6) FROM m, p "
    "UNION ALL SELECT 'TotalCharges', round(m2, 6), round(mc, 6), round(sc, 6) FROM m, p",
)
def fitted_numbers(spark, sf):
    """Fitted parameters, saved as a table and loaded again."""
    split = splits.stratified_split(stand_in.customers(spark, sf))
    path = new_folder(spark, "structured")
    preprocess.fit_structured(split.where("split = 'train'"), categories=[]).save(spark, path)
    fitted = preprocess.StructuredTransform.load(spark, path)
    rows = [(c, s.median, s.mean, s.spread) for c, s in fitted.numbers.items()]
    table = spark.createDataFrame(rows, "feature string, median double, mean double, spread double")
    return table.withColumns({n: F.round(n, 6) for n in ("median", "mean", "spread")})


_HOT = {"InternetService": fv.INTERNET_SERVICES, "Contract": fv.CONTRACTS, "SeniorCitizen": ["0", "1"]}


def _hot_sql(source):
    cells = [
        f"CASE WHEN coalesce(CAST({c} AS VARCHAR), 'Unknown') = '{v}' THEN 1.0::DOUBLE ELSE 0 END AS \"cat__{c}_{v}\""
        for c, values in _HOT.items()
        for v in values
    ]
    return f"SELECT customerID, split, {', '.join(cells)} FROM {source}"


@query("one_hot", _SPLIT + _hot_sql("sp"))
def one_hot(spark, sf):
    split = splits.stratified_split(stand_in.customers(spark, sf))
    fitted = preprocess.fit_structured(split.where("split = 'train'"), numbers=[], categories=list(_HOT))
    return fitted.apply(split, [fv.ID, "split"])


@query(
    "one_hot_unseen",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END AS \"cat__o_orderpriority_1-URGENT\", "
    "CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0 END AS \"cat__o_orderpriority_2-HIGH\" FROM orders",
)
def one_hot_unseen(spark, sf):
    """Values the fitting rows never had get no indicator at all."""
    orders = stand_in.table(spark, sf, "orders")
    seen = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    fitted = preprocess.fit_structured(seen, numbers=[], categories=["o_orderpriority"])
    return fitted.apply(orders, ["o_orderkey"])


@query(
    "one_hot_missing",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN o_orderkey % 3 <> 0 AND o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0 END AS \"cat__o_orderpriority_{v}\""
        for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + ", CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS \"cat__o_orderpriority_Unknown\" FROM orders",
)
def one_hot_missing(spark, sf):
    """A missing category is filled with a constant, which has an indicator of its own."""
    orders = stand_in.table(spark, sf, "orders")
    holed = orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    fitted = preprocess.fit_structured(holed, numbers=[], categories=["o_orderpriority"])
    return fitted.apply(holed, ["o_orderkey"])


@query(
    "category_vocabulary",
    CUSTOMERS
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM v" for c in fv.CATEGORICAL_FEATURES),
)
def category_vocabulary(spark, sf):
    fitted = preprocess.fit_structured(stand_in.customers(spark, sf), numbers=[])
    rows = [(c, v) for c, values in fitted.categories.items() for v in values]
    return spark.createDataFrame(rows, "feature string, value string")


_SPLIT_ENRICHED = ENRICHED + ", " + _quota_sql("e", "Churn", "customerID", _CUSTOMER_ORDER)


@query("feature_table_splits", _SPLIT_ENRICHED + "SELECT split, Churn, count(*) AS n, CAST(66 AS BIGINT) AS features FROM sp GROUP BY ALL")
def feature_table_splits(spark, sf):
    """The whole feature build, written partitioned by split and read back split by split."""
    path = new_folder(spark, "features")
    tables.write_feature_table(wide_features(build_features(written(enriched(spark, sf), "enriched"))), path)
    parts = None
    for name in ("train", "val", "test"):
        part = tables.read_split(spark, path, name)
        width = len(prefixed_columns(part, fv.STRUCTURED_PREFIXES + fv.TEXT_PREFIXES))
        counted = part.groupBy("split", fv.TARGET).agg(F.count(F.lit(1)).alias("n")).withColumn("features", F.lit(width).cast("long"))
        parts = counted if parts is None else parts.unionByName(counted)
    return parts


# --- text vectors -------------------------------------------------------------------------


@query("note_vectors")
def note_vectors(spark, sf):
    """Reduced vectors of whole documents."""
    documents = stand_in.table(spark, sf, "documents").select("doc_id", "text")
    fitted = notes.fit_notes(documents.select(F.col("text").alias(fv.NOTE)))
    return fitted.apply(documents, "text", "embedding").select("doc_id", "embedding")


_ENCODER_LIMIT = 2000


def measuring_encoder():
    """Length, blanks and line breaks of a text; texts over a limit are declined, as services do."""

    def encode(texts):
        return [None if len(t) > _ENCODER_LIMIT else [len(t), t.count(" "), t.count("\n")] for t in texts]

    return encode


@query(
    "zero_vectors_when_down",
    f"SELECT doc_id, length(text) <= {_ENCODER_LIMIT} AS available, "
    f"CAST(CASE WHEN length(text) <= {_ENCODER_LIMIT} THEN length(text) ELSE 0 END AS DOUBLE) AS largest, "
    f"CAST(CASE WHEN length(text) <= {_ENCODER_LIMIT} THEN length(text) - length(replace(text, ' ', '')) ELSE 0 END AS DOUBLE) AS second, "
    "CAST(3 AS BIGINT) AS width FROM documents",
)
def zero_vectors_when_down(spark, sf):
    """A plugged-in encoder that declines long texts: those rows get zero vectors and say so."""
    encode = notes.encoder_column(measuring_encoder, 3)
    rows = stand_in.table(spark, sf, "documents").select("doc_id", encode(F.col("text")).alias("e"))
    return rows.select(
        "doc_id",
        F.col("e.available").alias("available"),
        F.array_max(F.transform("e.vector", F.abs)).alias("largest"),
        F.get("e.vector", 1).alias("second"),
        F.size("e.vector").cast("long").alias("width"),
    )


@query("pca_variance")
def pca_variance(spark, sf):
    """Variance of each projected component next to the share the fit claims."""
    vectors = stand_in.table(spark, sf, "embeddings").select("vec_id", as_vector(F.col("embedding").cast("array<double>")).alias("x"))
    pca, mean = notes.fit_pca(vectors, "x", 5)
    fitted = notes.TextTransform(pca, mean, width=len(mean))
    projected = fitted.reduce(vectors, "x", "z")
    claimed = pca.explainedVariance.toArray()
    found = projected.agg(*[F.var_samp(F.col("z")[i]).alias(f"v{i}") for i in range(5)], *[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(5)])
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("component"),
            F.col(f"v{i}").alias("variance"),
            F.round(F.col(f"m{i}"), 9).alias("mean"),
            F.lit(float(claimed[i])).alias("explained"),
        )
        for i in range(5)
    ]
    return found.select(F.inline(F.array(*rows)))


@query(
    "vector_means",
    "WITH x AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) "
    "SELECT CAST(i - 1 AS BIGINT) AS position, round(avg(CAST(x AS DOUBLE)), 8) AS mean FROM x GROUP BY i",
)
def vector_means(spark, sf):
    """The centring vector of the component fit."""
    vectors = stand_in.table(spark, sf, "embeddings").select(as_vector(F.col("embedding").cast("array<double>")).alias("x"))
    _, mean = notes.fit_pca(vectors, "x", 5)
    return spark.createDataFrame([(i, m) for i, m in enumerate(mean)], "position bigint, mean double").withColumn("mean", F.round("mean", 8))


@query(
    "component_spectrum",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM x GROUP BY i), z AS (SELECT vec_id, i, x - m AS z FROM x JOIN m USING (i)),
c AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS v FROM z AS a JOIN z AS b USING (vec_id) GROUP BY a.i, b.i),
t AS (SELECT sum(v) AS t FROM c WHERE i = j),
c2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c AS a JOIN c AS b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 1 AS power, round(sum(v) / any_value(t), 9) AS moment FROM c, t WHERE i = j
UNION ALL SELECT 2, round(sum(v) / any_value(t * t), 9) FROM c2, t WHERE i = j
UNION ALL SELECT 3, round(sum(a.v * b.v) / any_value(t * t * t), 9) FROM c2 AS a JOIN c AS b ON a.i = b.j AND a.j = b.i, t
UNION ALL SELECT 4, round(sum(a.v * b.v) / any_value(t * t * t * t), 9) FROM c2 AS a JOIN c2 AS b ON a.i = b.j AND a.j = b.i, t""",
)
def component_spectrum(spark, sf):
    """Power sums of the shares of variance that all projected components have: the traces of the covariance's powers."""
    vectors = stand_in.table(spark, sf, "embeddings").select(as_vector(F.col("embedding").cast("array<double>")).alias("x"))
    width = len(vectors.first()["x"])
    pca, mean = notes.fit_pca(vectors, "x", width)
    projected = notes.TextTransform(pca, mean, width=width).reduce(vectors, "x", "z")
    found = projected.agg(*[F.var_samp(F.col("z")[i]).alias(f"v{i}") for i in range(width)]).first()
    total = sum(found)
    rows = [(p, sum((v / total) ** p for v in found)) for p in range(1, 5)]
    return spark.createDataFrame(rows, "power int, moment double").withColumn("moment", F.round("moment", 9))


# --- oversampling ------------------------------------------------------------------------------


def _labelled_vectors(spark, sf):
    return stand_in.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(fv.ID),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") < 3, 1).otherwise(0).cast("long").alias("label"),
    )


@query(
    "smote_counts",
    "WITH l AS (SELECT CASE WHEN label < 3 THEN 1 ELSE 0 END AS label FROM embeddings), "
    "n AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM l GROUP BY 1) "
    "SELECT label, false AS synthetic, n FROM n UNION ALL "
    "SELECT label, true, (SELECT max(n) FROM n) - n FROM n WHERE n < (SELECT max(n) FROM n)",
)
def smote_counts(spark, sf):
    grown = oversample.smote(_labelled_vectors(spark, sf))
    return grown.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_neighbours",
    """WITH d AS (SELECT a.vec_id AS vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance,
                        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS place
                 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
       SELECT vec_id, place, round(distance, 5) AS distance FROM d WHERE place <= 5""",
)
def nearest_neighbours(spark, sf):
    """The five exact neighbour distances of every vector whose id is divisible by 50, among all vectors."""
    points = stand_in.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("pid"), F.col("embedding").cast("array<double>").alias("x"), F.lit(1).cast("long").alias("copies")
    )
    asked = points.where(F.col("pid").cast("long") % 50 == 0).select("pid")
    near = oversample.nearest_neighbours(points, asked, 5)
    listed = near.select(F.col("pid").cast("long").alias("vec_id"), F.posexplode("near").alias("at", "n"))
    return listed.select("vec_id", (F.col("at") + 1).cast("long").alias("place"), F.round("n.distance", 5).alias("distance"))


