"""Apply a stored one-layer perceptron to cell measurements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_classifier(text: str) -> dict:
    """Weights, scaling and class names from the classifier's JSON document."""
    doc = json.loads(text)
    extractor, model = doc["featureExtractor"], doc["classifier"]["statmodel"]
    if model["activation_function"] != "SIGMOID_SYM" or len(model["layer_sizes"]) != 2:
        raise ValueError("only a single symmetric-sigmoid layer is supported")
    n_in, n_out = model["layer_sizes"]
    flat = model["weights"][0]
    norm = extractor["normalizer"]
    return {
        "features": extractor["featureExtractor"]["measurements"], "classes": [c["name"] for c in doc["pathClasses"]],
        "offsets": norm["offsets"], "scales": norm["scales"], "missing": norm["missingValue"],
        "in_scale": [tuple(model["input_scale"][2 * i:2 * i + 2]) for i in range(n_in)],
        "weights": [flat[i * n_out:(i + 1) * n_out] for i in range(n_in)], "bias": flat[n_in * n_out:],
        "alpha": model["f_param1"], "beta": model["f_param2"],
    }


def classify(measurements: DataFrame, model: dict) -> DataFrame:
    """``(id, feature, value)`` -> ``(id, label, score)``: affine map, symmetric sigmoid, first maximum.

    Missing measurements take the stored replacement. Everything stays a sum over features, so
    no wide table is built.
    """
    spark = measurements.sparkSession
    rows, constant = [], list(model["bias"])
    for i, name in enumerate(model["features"]):
        a, b = model["in_scale"][i]
        off, scale = model["offsets"][i], model["scales"][i]
        filled = (model["missing"] + off) * scale * a + b
        # Contribution relative to a missing value, which is part of the constant.
        rows.append((name, float(scale * a), float(off * scale * a + b - filled), [float(w) for w in model["weights"][i]]))
        constant = [c + filled * w for c, w in zip(constant, model["weights"][i])]
    table = spark.createDataFrame(rows, "feature string, gain double, shift double, w array<double>")
    value = F.when(~F.isnan("value"), F.col("value"))
    part = measurements.join(table, "feature").withColumn(
        "_x", F.coalesce(value * F.col("gain") + F.col("shift"), F.lit(0.0)))
    sums = part.groupBy("id").agg(*[
        (F.sum(F.col("_x") * F.col("w")[j]) + F.lit(float(c))).alias(f"s{j}") for j, c in enumerate(constant)])
    out = []
    for j, name in enumerate(model["classes"]):
        e = F.exp(-F.lit(float(model["alpha"])) * F.col(f"s{j}"))
        out.append(F.struct((F.lit(float(model["beta"])) * (1 - e) / (1 + e)).alias("score"), F.lit(-j).alias("rank"), F.lit(name).alias("label")))
    best = F.array_max(F.array(*out))
    return sums.select("id", best["label"].alias("label"), best["score"].alias("score"))
