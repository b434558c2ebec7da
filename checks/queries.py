"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.views import load
from gleamline.functions import numeric, text
from gleamline.ml import features as M
from gleamline.ml import nearest as N
from gleamline.ml import silhouette as L
from gleamline.ml.split import split_exact as split_rows
from gleamline.operators import columns as C
from gleamline.operators import profile as P
from gleamline.operators import rows as R
from gleamline.operators import stats as S
from gleamline.plans import automl as A
from gleamline.plans import clean as K
from gleamline.plans import leaderboard as B
from gleamline.plans import suggest as G
from gleamline.sources import runs as H
from gleamline.sources import tables as T
from gleamline.session import staging_root
from gleamline.types import dtype_name

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def on(view: str, operator, *args, digits: int | None = None):
    """A query that applies one operator to a normalised view."""

    def run(spark, sf_dir):
        return rounded(operator(C.normalize_nulls(load(spark, sf_dir, view)), *args), digits)

    return run


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    if digits is None:
        return df
    doubles, scale = set(C.double_columns(df)), 10.0**digits
    return df.select(
        *[(F.rint(F.col(n) * scale) / scale).alias(n) if n in doubles else n for n in df.columns]
    )


STRATEGY = {
    "drop_duplicates": True,
    "drop_columns": ["order_id", "no_such_column"],
    "standardize_text": ["priority"],
    "extract_numbers": ["price_txt"],
    "fill_unknown": ["status", "priority"],
    "fill_mean": ["price_txt", "score"],
    "remove_outliers": ["amount", "price_txt"],
}


@query
def normalize_nulls(spark, sf_dir):
    return C.normalize_nulls(load(spark, sf_dir, "dirty_orders"))


@query
def default_nulls(spark, sf_dir):
    return C.normalize_nulls(load(spark, sf_dir, "text_cells"), text.DEFAULT_NULLS)


@query
def infer_types(spark, sf_dir):
    typed = T.infer_types(load(spark, sf_dir, "text_cells"))
    pairs = [(f.name, dtype_name(f.dataType)) for f in typed.schema]
    return spark.createDataFrame(pairs, "column string, dtype string")


@query
def infer_types_values(spark, sf_dir):
    return T.infer_types(load(spark, sf_dir, "text_cells"), infer="normalized")


QUERIES["drop_sparse_rows"] = on("dirty_wide", R.drop_sparse_rows)
QUERIES["drop_missing"] = on("dirty_wide", R.drop_missing)
QUERIES["drop_columns"] = on("dirty_wide", C.drop_columns, ["grade", "eighth", "no_such_column"])
QUERIES["drop_missing_target"] = on("dirty_orders", R.drop_missing_target, "status")


@query
def split_target(spark, sf_dir):
    features, target = C.split_target(load(spark, sf_dir, "dirty_orders"), "status")
    return features


QUERIES["dedupe_rows"] = on("dirty_orders", R.dedupe_rows)
QUERIES["remove_outliers"] = on("dirty_orders", R.remove_outliers, ["amount", "score", "status"])
QUERIES["preview"] = on("dirty_orders", R.preview, 10, ["order_id"])
QUERIES["profile_shape"] = on("dirty_orders", S.profile_shape)
QUERIES["missing_counts"] = on("dirty_orders", S.missing_counts)
QUERIES["table_health"] = on("dirty_orders", S.table_health)
QUERIES["dtype_counts"] = on("dirty_wide", P.dtype_counts)
QUERIES["correlation_matrix"] = on("const_cols", S.correlation_matrix, digits=6)
QUERIES["quartiles"] = on("const_cols", S.quartiles, digits=6)
QUERIES["numeric_share"] = on("unit_text", S.numeric_share)


@query
def profile(spark, sf_dir):
    """Missing cells and correlations of one profile in a single table."""
    parts = P.profile(load(spark, sf_dir, "dirty_orders"))
    missing = parts.missing.select(
        F.lit("missing").alias("part"), "column", F.lit("").alias("other"),
        F.col("missing").cast("double").alias("value"),
    )
    correlation = parts.correlation.select(
        F.lit("correlation"), F.col("col_x"), F.col("col_y"), F.col("r")
    )
    return rounded(missing.union(correlation), 6)


@query
def strip_text(spark, sf_dir):
    df = load(spark, sf_dir, "unit_text")
    return df.select(
        "part_key", *[text.strip_text(F.col(n)).alias(n) for n in ("weight", "label", "blurb")]
    )


@query
def title_case(spark, sf_dir):
    documents = load(spark, sf_dir, "documents")
    return documents.select("doc_id", text.title_case(F.col("text")).alias("titled"))


@query
def extract_number(spark, sf_dir):
    df = load(spark, sf_dir, "unit_text")
    return df.select(
        "part_key",
        numeric.extract_number(F.col("weight")).alias("weight"),
        numeric.extract_number(F.col("blurb")).alias("blurb"),
    )


@query
def to_number(spark, sf_dir):
    df = load(spark, sf_dir, "unit_text")
    return df.select("part_key", numeric.to_number(F.col("weight")).alias("weight"))


@query
def round_floats(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    half = (F.col("l_extendedprice") * F.col("l_discount") * 0.5).alias("half_discount")
    return C.round_floats(lines.select("l_orderkey", "l_linenumber", half))


@query
def demote_whole_floats(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return C.demote_whole_floats(lines.select("l_orderkey", "l_quantity", "l_extendedprice"))


@query
def safe_name(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        text.safe_name(F.col("url")).alias("safe"),
        text.clean_name(F.col("html")).alias("cleaned"),
    )


QUERIES["standardize_text"] = on("dirty_orders", C.standardize_text, ["priority", "status"])
QUERIES["extract_numbers"] = on("dirty_orders", C.extract_numbers, ["price_txt", "order_id"])
QUERIES["extract_numbers_auto"] = on("unit_text", C.extract_numbers_auto)
QUERIES["fill_unknown"] = on("dirty_orders", C.fill_unknown, ["priority", "status"])
QUERIES["fill_mean"] = on("dirty_orders", C.fill_mean, ["amount", "score", "price_txt"], digits=4)
QUERIES["fill_median"] = on("dirty_orders", C.fill_median, ["amount", "score"], digits=4)
QUERIES["fill_mode"] = on("dirty_orders", C.fill_mode, ["priority", "status"])
QUERIES["fill_auto"] = on("dirty_orders", C.fill_auto, digits=4)
QUERIES["cap_outliers"] = on("dirty_orders", C.cap_outliers, digits=4)
QUERIES["apply_strategy"] = on("dirty_orders", K.apply_strategy, STRATEGY, digits=4)
QUERIES["auto_clean"] = on("dirty_orders", K.auto_clean, digits=4)


def cleaned(view, mode, strategy=None):
    return lambda spark, sf_dir: K.clean(load(spark, sf_dir, view), mode, strategy).data


QUERIES["clean"] = cleaned("dirty_orders", "auto_smart")
QUERIES["clean_wide"] = cleaned("dirty_wide", "auto_smart")
QUERIES["clean_strategy"] = cleaned("dirty_orders", "ai_agent", STRATEGY)
QUERIES["clean_suggested"] = cleaned("dirty_orders", "ai_agent")
# A reply whose object is cut off holds no strategy, so the automatic run takes its place.
QUERIES["clean_fallback"] = cleaned("dirty_orders", "ai_agent", 'Sure: {"fill_mean": ["amount"}, which drops copies.')
QUERIES["clean_drop_missing"] = cleaned("dirty_wide", "drop_missing")
QUERIES["clean_fill_mean"] = cleaned("dirty_wide", "fill_mean")
QUERIES["clean_remove_outliers"] = cleaned("dirty_wide", "remove_outliers")
QUERIES["clean_manual"] = cleaned("dirty_wide", "manual")


@query
def run_log(spark, sf_dir):
    return K.clean(load(spark, sf_dir, "dirty_wide"), "auto_smart").log_table()


QUERIES["suggest_strategy"] = on("dirty_orders", G.strategy_table)


@query
def parse_strategy(spark, sf_dir):
    """Strategies written as fenced JSON text, one per part."""
    reply = F.format_string(
        '```json\nSure: {"standardize_text": ["%s", "%s"], "fill_mean": ["%s"], '
        '"drop_duplicates": %s}\n```',
        "p_brand", "p_type", "p_name", (F.col("p_size") > 25).cast("string"),
    )
    parsed = load(spark, sf_dir, "part").select(
        "p_partkey", G.parse_strategy(reply).alias("strategy")
    )
    return parsed.select(
        "p_partkey",
        F.array_join("strategy.standardize_text", "|").alias("standardize_text"),
        F.array_join("strategy.fill_mean", "|").alias("fill_mean"),
        F.size("strategy.fill_unknown").isNull().alias("no_fill_unknown"),
        F.col("strategy.drop_duplicates").alias("drop_duplicates"),
    )


@query
def strategy_outcomes(spark, sf_dir):
    """Replies of four kinds, one per part, by whether they hold a usable strategy."""
    name = F.to_json(F.struct(F.array("p_name").alias("fill_mean")))
    kind = F.col("p_partkey") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("No plan for "), "p_name"))
        .when(kind == 1, F.concat("p_name", F.lit(": {} as nothing is to be done")))
        .when(kind == 2, F.concat(F.lit('{"fill_mean": ["'), "p_name", F.lit('"}')))
        .when(kind == 3, F.concat(F.lit("```json\n"), name, F.lit("\n```")))
    )
    parts = load(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))
    return parts.select("p_partkey", G.strategy_outcome(F.col("reply")).alias("outcome"))


def run_tables(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    runs = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.col("o_orderpriority"), F.lit(".csv")).alias("original_filename"),
        text.clean_name(F.concat("o_orderpriority", F.lit(".csv"))).alias("cleaned_filename"),
        F.col("o_orderdate").alias("created_at"),
    )
    # Customers of one nation and segment share a name: names are not unique.
    name = F.concat_ws("_", "c_nationkey", "c_mktsegment")
    return runs, customer.select(F.col("c_custkey").alias("id"), name.alias("username"))


@query
def recent_runs(spark, sf_dir):
    return H.recent_runs(*run_tables(spark, sf_dir), order=("id",))


@query
def user_runs(spark, sf_dir):
    return H.recent_runs(*run_tables(spark, sf_dir), username="3_MACHINERY", order=("id",))


def model_scores(spark, sf_dir):
    """Each order priority as a model, scored by how often it guesses a late status."""
    orders = load(spark, sf_dir, "orders")
    share = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    scored = orders.groupBy("o_orderpriority").agg(share.alias("score"))
    return scored.select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("seq"),
        F.col("o_orderpriority").alias("model"),
        "score",
        F.lit("Accuracy").alias("metric"),
    )


@query
def leaderboard(spark, sf_dir):
    return B.leaderboard(model_scores(spark, sf_dir))


@query
def best_model(spark, sf_dir):
    return B.best_model(model_scores(spark, sf_dir))


@query
def accuracy(spark, sf_dir):
    pairs = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    guess = F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("guess")
    return rounded(S.accuracy(pairs.select("quality", guess), "quality", "guess"), 8)


@query
def r2(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    guess = (900 + (F.col("p_partkey") % 1000) / 10).alias("guess")
    return rounded(S.r2(part.select("p_retailprice", guess), "p_retailprice", "guess"), 8)


TASKS = (("ml_cls", "verdict"), ("ml_reg", "price"), ("ml_clu", "NONE"), ("labels", "toxic"))


@query
def infer_task(spark, sf_dir):
    found = [(v, t, A.infer_task(load(spark, sf_dir, v), t)) for v, t in TASKS]
    return spark.createDataFrame(found, "source string, target string, task string")


@query
def encode_label(spark, sf_dir):
    return M.encode_label(load(spark, sf_dir, "documents").select("doc_id", "source"), "source")


@query
def scale_standard(spark, sf_dir):
    df = load(spark, sf_dir, "ml_cls").select("doc_id", "n_chars", "blanks", "breaks")
    return rounded(M.scale_standard(df, ["n_chars", "blanks", "breaks"]), 6)


@query
def scale_minmax(spark, sf_dir):
    df = load(spark, sf_dir, "const_cols").select("partkey", "fixed", "product", "root")
    return rounded(M.scale_minmax(df, ["fixed", "product", "root"]), 8)


@query
def one_hot(spark, sf_dir):
    return M.one_hot(load(spark, sf_dir, "ml_reg").select("p_partkey", "kind"), ["kind"])


@query
def split_exact(spark, sf_dir):
    train, test = split_rows(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query
def features(spark, sf_dir):
    """Numbers and level slots of every row, fitted on the training rows."""
    df = load(spark, sf_dir, "ml_reg")
    train, _ = split_rows(df, ["p_partkey"])
    inputs = ["size", "code", "kind"]
    space = M.FeatureSpace.fit(train.select(*inputs))
    return rounded(
        space.transform(df.select("p_partkey", *inputs)).select(
            "p_partkey",
            F.col("num")[0].alias("size"),
            F.col("num")[1].alias("code"),
            F.col("slots")[0].cast("bigint").alias("kind_slot"),
        ),
        6,
    )


def vectors(spark, sf_dir):
    """Embeddings as rows to join, split into training rows and queries."""
    embeddings = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("num"),
        F.array().cast("array<int>").alias("slots"),
        F.col("label").cast("double").alias("label"),
    )
    return split_rows(embeddings, ["id"])


@query
def knn_join(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return rounded(N.knn_join(test, train), 5)


@query
def knn_join_cells(spark, sf_dir):
    """The same join cut into cells, as for a training side too large to broadcast."""
    train, test = vectors(spark, sf_dir)
    return rounded(N.knn_join(test, train, broadcast_cells=0), 5)


@query
def knn_classify(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return N.knn_predict(test, train, classify=True)


@query
def knn_regress(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return rounded(N.knn_predict(test, train, classify=False), 6)


def clusters(spark, sf_dir):
    """Customers in feature space, clustered by region of the nation code."""
    df = load(spark, sf_dir, "ml_clu")
    space = M.FeatureSpace.fit(df)
    named = df.withColumn("cluster", (F.col("nation") % 3).cast("int"))
    return space.transform(named).select("num", "slots", "cluster")


@query
def silhouette(spark, sf_dir):
    value = L.silhouette(clusters(spark, sf_dir))
    return rounded(spark.createDataFrame([(value,)], "silhouette double"), 6)


@query
def silhouette_squared(spark, sf_dir):
    value = L.silhouette(clusters(spark, sf_dir), "squared")
    return rounded(spark.createDataFrame([(value,)], "silhouette double"), 6)


def trained(view, target, mode="auto", config=None):
    def run(spark, sf_dir):
        return A.automl(load(spark, sf_dir, view), target, mode, config).leaderboard

    return run


QUERIES["train_classification"] = trained("ml_cls", "verdict")
QUERIES["train_regression"] = trained("ml_reg", "price")
QUERIES["train_clustering"] = trained("ml_clu", "NONE")
QUERIES["train_manual"] = trained(
    "ml_cls",
    "verdict",
    "manual",
    A.MlConfig(drop_columns=["doc_id"], scaling="minmax", models=["linear", "tree"]),
)


@query
def automl(spark, sf_dir):
    """Task, ranked models, and which of them is kept."""
    config = A.MlConfig(models=["linear", "knn", "tree"])
    result = A.automl(load(spark, sf_dir, "ml_reg"), "price", "manual", config)
    return result.leaderboard.withColumn("task", F.lit(result.task)).withColumn(
        "is_best", F.col("model") == result.best.name
    )


@query
def score_table(spark, sf_dir):
    """Train, save, load, and score the whole table."""
    df = load(spark, sf_dir, "ml_reg")
    config = A.MlConfig(models=["linear", "tree"])
    path = f"{staging_root(spark)}/model-{uuid.uuid4().hex}"
    A.automl(df, "price", "manual", config).best.save(path)
    return A.score_table(spark, path, df)
