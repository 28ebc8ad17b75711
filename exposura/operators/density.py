"""Domain classifier between standard and randomized exposure, on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from exposura.functions.columns import uniform_hash
from exposura.functions.scale import values_at
from exposura.operators.probability import ranking_areas
from exposura.session import materialize

# The exposure-time features of the domain classifier.
DOMAIN_FEATURES = (
    "tab", "hour", "day_of_week", "session_position", "hist_item_exposure", "hist_item_reward_rate",
    "hist_user_exposure", "hist_user_long_view_rate",
)
CATEGORICAL = ("tab",)
MIN_CATEGORY_ROWS = 5
# The level that seldom seen categories share; no text of a log starts with this character.
RARE = "\u0000rare"


@dataclass
class DomainClassifier:
    model: PipelineModel
    features: tuple[str, ...]
    levels: dict[str, DataFrame]
    usual: dict[str, str]
    random_prior: float
    validation_auc: float
    rows: dict[str, int]

    def probabilities(self, rows: DataFrame, name: str = "domain_probability") -> DataFrame:
        missing = sorted(set(self.features) - set(rows.columns))
        if missing:
            raise ValueError(f"the domain classifier was fitted on columns that are not there: {missing}")
        scored = self.model.transform(_typed(rows, self.features, self.levels, self.usual))
        return scored.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def _typed(rows: DataFrame, features: Sequence[str], levels: dict[str, DataFrame], usual: dict[str, str]) -> DataFrame:
    """Doubles for numeric features; categories as text.

    A null category is the most frequent one, those seldom seen in training share a level, and one never seen
    there keeps its text, which the encoder gives no level.
    """
    typed = rows.withColumns({f"_{n}": F.col(n).cast("double") for n in features if n not in CATEGORICAL})
    for name in (n for n in features if n in CATEGORICAL):
        text = F.coalesce(F.col(name).cast("string"), F.lit(usual[name]))
        known = levels[name].select(F.col("level").alias(f"_{name}_text"), F.col("shown").alias(f"_{name}_shown"))
        typed = typed.withColumn(f"_{name}_text", text).join(known, f"_{name}_text", "left")
        typed = typed.withColumn(f"_{name}", F.coalesce(f"_{name}_shown", f"_{name}_text"))
    return typed


def _levels(train: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Every training level with the one it is encoded as, as a table, and the most frequent level."""
    counts = materialize(
        train.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("rows"))
    )
    first = counts.orderBy(F.desc("rows"), "level").first()
    shown = F.when(F.col("rows") >= MIN_CATEGORY_ROWS, F.col("level")).otherwise(F.lit(RARE))
    return counts.select("level", shown.alias("shown")), first["level"] if first else RARE


def sample_domain(rows: DataFrame, keys: Sequence[str], maximum: int, seed: int) -> DataFrame:
    """At most ``maximum`` rows by seeded hash order (the sampling step of the classifier)."""
    hashed = rows.withColumn("_u", uniform_hash(*[F.col(k) for k in keys], seed))
    cutoff = values_at(hashed, "_u", {"cut": F.least(F.col("_n"), F.lit(maximum)) - 1}).select("cut")
    return hashed.where(F.col("_u") <= cutoff.scalar()).drop("_u")


def fit_domain_classifier(
    standard: DataFrame, randomized: DataFrame, keys: Sequence[str] = ("user_id", "item_id", "timestamp_ms"),
    features: Sequence[str] = DOMAIN_FEATURES, seed: int = 42, max_rows_per_domain: int = 300_000, max_iter: int = 300,
) -> DomainClassifier:
    """Logistic regression of the domain on exposure-time features, with a stratified 80/20 hold-out."""
    present = tuple(n for n in features if n in standard.columns and n in randomized.columns)
    if not present:
        raise ValueError("the two domains share none of the feature columns")
    if max_rows_per_domain < 2:
        raise ValueError("a domain cannot be limited to fewer than two rows")
    columns = [*keys, *[n for n in present if n not in keys]]
    both = None
    for domain, rows in ((0, standard), (1, randomized)):
        part = sample_domain(rows.select(*columns), keys, max_rows_per_domain, seed).withColumn("_domain", F.lit(domain))
        both = part if both is None else both.unionByName(part)
    # the hash order inside each domain makes the split stratified: its lowest fifth validates
    both = both.withColumn("_v", uniform_hash(*[F.col(k) for k in keys], "split", seed))
    edge = values_at(both, "_v", {"cut": F.greatest(F.floor(F.col("_n") * 0.2), F.lit(1)) - 1}, by=["_domain"])
    marked = both.join(F.broadcast(edge.select("_domain", "cut")), "_domain").withColumn("_holdout", F.col("_v") <= F.col("cut"))
    marked = marked.persist()
    sizes = {int(r["_domain"]): int(r["n"]) for r in marked.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2:
        raise ValueError(f"too few rows to tell the domains apart: {sizes}")
    train = marked.where(~F.col("_holdout"))
    levels, usual = {}, {}
    for name in (n for n in present if n in CATEGORICAL):
        levels[name], usual[name] = _levels(train, name)
    numeric = [f"_{n}" for n in present if n not in CATEGORICAL]
    categorical = [f"_{n}" for n in present if n in CATEGORICAL]
    stages = []
    if numeric:
        stages += [
            Imputer(strategy="median", inputCols=numeric, outputCols=[f"{n}_filled" for n in numeric]),
            VectorAssembler(inputCols=[f"{n}_filled" for n in numeric], outputCol="_numeric"),
            StandardScaler(withMean=True, withStd=True, inputCol="_numeric", outputCol="_scaled"),
        ]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=[f"{n}_index" for n in categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{n}_index" for n in categorical], outputCols=[f"{n}_hot" for n in categorical]),
        ]
    train_rows, train_random = train.agg(F.count(F.lit(1)), F.sum("_domain")).first()
    stages += [
        VectorAssembler(
            inputCols=(["_scaled"] if numeric else []) + [f"{n}_hot" for n in categorical], outputCol="features"
        ),
        LogisticRegression(
            labelCol="_domain", maxIter=max_iter, regParam=1.0 / train_rows, elasticNetParam=0.0, standardization=False
        ),
    ]
    model = Pipeline(stages=stages).fit(_typed(train, present, levels, usual))
    classifier = DomainClassifier(
        model, present, levels, usual, train_random / train_rows, float("nan"), {"standard": sizes[0], "randomized": sizes[1]}
    )
    held = classifier.probabilities(marked.where("_holdout"))
    area = ranking_areas(held, "_domain", "domain_probability").first()["roc_auc"]
    classifier.validation_auc = float("nan") if area is None else float(area)
    marked.unpersist()
    return classifier
