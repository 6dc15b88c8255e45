"""Scorers that are Spark jobs (K1–K5).

Prototypes are a K×D table (bounded by classes × feature width), broadcast
to every task as one ``array<array<double>>`` row; the per-row dot products
are higher-order functions, so scoring is a map-only stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import vec


def fit_prototypes(lb: DataFrame, feat: str = "feat", label: str = "label") -> DataFrame:
    """K1: unit-normalised class mean of the labelled features ("weight imprinting").

    ``posexplode`` + ``groupBy(label, pos).avg`` is a partial/final aggregate:
    map tasks combine locally, only K×D partial sums are shuffled.
    """
    long = lb.select(F.col(label), F.posexplode(F.col(feat)).alias("pos", "x"))
    means = long.groupBy(label, "pos").agg(F.avg("x").alias("m"))
    arr = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("__s"))
    return arr.select(label, vec.l2norm(F.transform("__s", lambda s: s["m"])).alias("proto"))


def prototype_matrix(protos: DataFrame, K: int, label: str = "label", col: str = "proto") -> DataFrame:
    """One row holding the K prototypes in class order (missing class → NULL)."""
    m = protos.agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col(col)))).alias("__m"))
    return m.select(F.transform(F.sequence(F.lit(0), F.lit(K - 1)),
                                lambda k: F.element_at(F.col("__m"), k)).alias("__P"))


def score_prototypes(df: DataFrame, protos: DataFrame, K: int, T: float = 0.1, feat: str = "feat",
                     out: str = "logits", cosine: bool = False, label: str = "label") -> DataFrame:
    """K2: logits_k = <proto_k, x>/T (``cosine`` normalises x first); a class
    without a prototype scores 0."""
    P = F.broadcast(prototype_matrix(protos, K, label))
    x = vec.l2norm(feat) if cosine else F.col(feat)
    return (df.crossJoin(P)
              .withColumn(out, F.transform("__P", lambda p: F.coalesce(vec.dot(p, x) / F.lit(T), F.lit(0.0))))
              .drop("__P"))


def fit_linear(lb: DataFrame, feat: str = "feat", label: str = "label", weight_col: str | None = None,
               max_iter: int = 50, reg: float = 0.0):
    """K3: multinomial logistic regression on labelled rows (optionally weighted)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    d = lb.withColumn("__features", array_to_vector(F.col(feat))).withColumn("__label", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=max_iter, regParam=reg,
                            family="multinomial")
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(d)


def fit_with_pseudo(lb: DataFrame, ulb_pseudo: DataFrame, lambda_u: float = 1.0, feat: str = "feat",
                    label: str = "label", pseudo: str = "pseudo_label", mask: str = "mask", **kw):
    """K4: refit with labelled rows at weight 1 and accepted unlabelled rows
    at weight λ_u·mask under their pseudo-label."""
    a = lb.select(F.col(feat), F.col(label).cast("int").alias(label), F.lit(1.0).alias("__w"))
    b = (ulb_pseudo.filter(F.col(mask) > 0)
         .select(F.col(feat), F.col(pseudo).cast("int").alias(label),
                 (F.lit(float(lambda_u)) * F.col(mask).cast("double")).alias("__w")))
    return fit_linear(a.unionByName(b), feat, label, weight_col="__w", **kw)


def predict_linear(model, df: DataFrame, feat: str = "feat", out: str = "logits") -> DataFrame:
    """K5 for a fitted linear model: raw margins as ``logits``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = df.withColumn("__features", array_to_vector(F.col(feat)))
    p = model.setFeaturesCol("__features").setPredictionCol("__pred").setProbabilityCol("__prob") \
        .setRawPredictionCol("__raw").transform(d)
    return p.withColumn(out, vector_to_array("__raw")).drop("__features", "__pred", "__prob", "__raw")


def predict(df: DataFrame, logits: str = "logits", label: str | None = "label",
            keep: tuple[str, ...] = ("idx",), feat: str | None = None) -> DataFrame:
    """K5: prediction, probabilities and truth per row (optionally features)."""
    cols = [F.col(c) for c in keep]
    cols += [vec.argmax(vec.softmax(logits)).alias("pred"), vec.softmax(logits).alias("probs")]
    if label:
        cols.append(F.col(label).alias("truth"))
    if feat:
        cols.append(F.col(feat))
    return df.select(*cols)
