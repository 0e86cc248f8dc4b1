"""Detection evaluation with ignored boxes, size ranges and detection limits, and per-class report arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.split import running_sums
from gristmill.sources.materialize import materialize

#: Fixed values of the evaluation: overlap thresholds, box areas from and to, (size range, detections an image may have), recall points.
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
CASES = (("all", 1), ("all", 10), ("all", 100), ("small", 100), ("medium", 100), ("large", 100))
POINTS, MOST_DETS, EPS = 101, 100, float(np.spacing(1))
#: Boxes and detections that one task matches at a time.
GROUP = 2000


def overlaps(dets: np.ndarray, boxes: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """[detection, box]: intersection over union, over the detection's own area for crowd boxes. Rows are x, y, w, h."""
    d, g = dets[:, None, :], boxes[None, :, :]
    side = lambda p, s: np.maximum(0, np.minimum(d[..., p] + d[..., s], g[..., p] + g[..., s]) - np.maximum(d[..., p], g[..., p]))
    inter, own = side(0, 2) * side(1, 3), d[..., 2] * d[..., 3]
    whole = np.where(crowd[None, :], own, own + g[..., 2] * g[..., 3] - inter)
    return np.where(whole > 0, inter / np.where(whole > 0, whole, 1), 0)


def match(dets: np.ndarray, boxes: np.ndarray, area: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[detection, size range, threshold]: matched, and counted at all.

    Detections come in score order; each takes the free box of most overlap, one that counts before one that is
    ignored (crowd, or outside the size range), the later of equals; a crowd box is never used up. All ranges and thresholds are matched at once.
    """
    lo, hi = np.array(list(AREAS.values())).T
    ignored = np.repeat(crowd[None, :] | (area[None, :] < lo[:, None]) | (area[None, :] > hi[:, None]), len(THRESHOLDS), axis=0)
    least = np.tile(np.minimum(THRESHOLDS, 1 - 1e-10), len(AREAS))
    iou, free = overlaps(dets, boxes, crowd), np.ones(ignored.shape, dtype=bool)
    n, m = len(least), len(boxes)
    hit, counts = np.zeros((len(dets), n), dtype=bool), np.ones((len(dets), n), dtype=bool)
    size = dets[:, 2] * dets[:, 3]
    outside = np.repeat((size[:, None] < lo) | (size[:, None] > hi), len(THRESHOLDS), axis=1)
    for d in range(len(dets)):
        if m:
            ok = (free | crowd[None, :]) & (iou[d][None, :] >= least[:, None])
            real = ok & ~ignored
            ok = np.where(real.any(axis=1)[:, None], real, ok)
            v = np.where(ok, iou[d][None, :], -1.0)
            at = m - 1 - v[:, ::-1].argmax(axis=1)
            hit[d] = ok.any(axis=1)
            free[hit[d], at[hit[d]]] = False
            counts[d] = np.where(hit[d], ~ignored[np.arange(n), at], ~outside[d])
        else:
            counts[d] = ~outside[d]
    shape = (len(dets), len(AREAS), len(THRESHOLDS))
    return hit.reshape(shape), counts.reshape(shape)


def _matched(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """category_id, det_id, score, rank (in its image), area, threshold, tp of the detections that count."""
    k = ["image_id", "category_id"]
    w = Window.partitionBy(*k).orderBy(F.desc("score"), "det_id")
    dets = detections.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MOST_DETS)
    dets = dets.select(*k, "det_id", "score", "rank", *[F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"])
    boxes = truth.select(*k, "gt_id", "area", "iscrowd", *[F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"])
    types = {f.name: f.dataType.simpleString() for f in dets.schema}
    names, thresholds = np.array(list(AREAS), dtype=object), np.array(THRESHOLDS)
    # images are dealt to groups of about GROUP boxes: one image and category is never divided
    groups = truth.count() // GROUP + detections.count() // GROUP + 1
    deal = lambda df: df.withColumn("_g", F.pmod(F.xxhash64(*k), F.lit(groups)).cast("int"))

    def run(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        d, g = d.sort_values([*k, "rank"], ignore_index=True), g.sort_values([*k, "gt_id"], kind="stable", ignore_index=True)
        boxes, area, crowd = g[list("xywh")].to_numpy(dtype=float), g["area"].to_numpy(dtype=float), g["iscrowd"].to_numpy(dtype=float) > 0
        there = g.groupby(k, sort=False).indices
        xywh, at, flags = d[list("xywh")].to_numpy(dtype=float), [], []
        for key, i in d.groupby(k, sort=False).indices.items():
            j = there.get(key, np.zeros(0, dtype=int))
            hit, counts = match(xywh[i], boxes[j], area[j], crowd[j])
            n, a, t = np.nonzero(counts)
            at.append(i[n])
            flags.append(np.stack([a, t, hit[n, a, t]], axis=1))
        if not at:
            return pd.DataFrame({c: [] for c in ("category_id", "det_id", "score", "rank", "area", "threshold", "tp")})
        i, f = np.concatenate(at), np.concatenate(flags)
        return pd.DataFrame({"category_id": d["category_id"].to_numpy()[i], "det_id": d["det_id"].to_numpy()[i], "score": d["score"].to_numpy(dtype=float)[i], "rank": d["rank"].to_numpy()[i],
                             "area": names[f[:, 0]], "threshold": thresholds[f[:, 1]], "tp": f[:, 2]})

    out = deal(dets).groupBy("_g").cogroup(deal(boxes).groupBy("_g")).applyInPandas(run, f"category_id {types['category_id']}, det_id {types['det_id']}, score double, rank int, area string, threshold double, tp int")
    return materialize(out, "matched")  # a range sort reads its input twice


def _point(r: Column) -> Column:
    """Number of the last recall point (0, 0.01, ..., 1) at or below r."""
    k = F.floor(r * (POINTS - 1))
    return F.when(r >= (k + 1) * 0.01, k + 1).when(r >= k * 0.01, k).otherwise(k - 1).cast("int")


def evaluate(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """(category_id, area, max_dets, threshold, ap, recall): interpolated average precision and greatest recall.

    truth: gt_id, image_id, category_id, box (x, y, w, h), and optionally area (else w * h) and iscrowd (else 0); detections: det_id, image_id, category_id,
    score, box. Detections are matched inside one image and category, best score first, ties by det_id, at most 100. Crowd boxes and boxes outside
    the size range are ignored, as are detections matched to them and unmatched ones outside the range. A category without a box that counts
    has no row for that range; one without detections scores 0. Precision comes from running sums over the score order of a category,
    which are made by range partitions, so a category with a third of all boxes is many tasks.
    """
    truth = truth if "area" in truth.columns else truth.withColumn("area", F.col("box.w") * F.col("box.h"))
    truth = truth if "iscrowd" in truth.columns else truth.withColumn("iscrowd", F.lit(0))
    truth = truth.withColumns({"area": F.col("area").cast("double"), "iscrowd": F.coalesce("iscrowd", F.lit(0))})
    cases = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(n).alias("max_dets")) for a, n in CASES])
    spans = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, (lo, hi) in AREAS.items()])
    n = truth.filter("iscrowd = 0").withColumn("s", F.explode(spans)).filter("area >= s.lo AND area <= s.hi").groupBy("category_id", F.col("s.area").alias("area")).agg(F.count("*").alias("n"))
    rows = _matched(truth, detections).withColumn("c", F.explode(cases)).filter("c.area = area AND rank <= c.max_dets").withColumn("max_dets", F.col("c.max_dets")).drop("c")
    keys = ["category_id", "area", "max_dets", "threshold"]
    run = running_sums(rows.withColumns({"neg": -F.col("score"), "one": F.lit(1)}), keys, ["neg", "det_id"], {"tps": "tp", "seen": "one"})
    pr = run.join(n, ["category_id", "area"]).select(*keys, (F.col("tps") / F.col("n")).alias("r"), (F.col("tps") / (F.col("seen") + EPS)).alias("p"))
    best = pr.groupBy(*keys, _point(F.col("r")).alias("k")).agg(F.max("p").alias("p"), F.max("r").alias("r"))
    # at most POINTS rows each; the precision at a point is the best one from there on
    got = best.groupBy(*keys).agg(F.collect_list(F.struct("k", "p")).alias("kp"), F.max("r").alias("recall"))
    at = lambda i: F.coalesce(F.array_max(F.transform(F.filter("kp", lambda x: x["k"] >= i), lambda x: x["p"])), F.lit(0.0))
    ap = F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0.0), lambda s, i: s + at(i)) / POINTS
    dims = n.join(n.sparkSession.createDataFrame(CASES, "area string, max_dets int"), "area").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))).select(*keys)
    return dims.join(got.select(*keys, ap.alias("ap"), "recall"), keys, "left").na.fill(0.0, ["ap", "recall"])


def average_precision(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """(category_id, threshold, ap, recall) over boxes of all sizes and 100 detections an image."""
    return evaluate(truth, detections).filter(f"area = 'all' AND max_dets = {MOST_DETS}").select("category_id", "threshold", "ap", "recall")


def summary(per_class: DataFrame) -> tuple[float, float]:
    """(AP50:95, AP50); (0.0, 0.0) for empty data."""
    r = per_class.agg(F.avg("ap"), F.avg(F.when(F.col("threshold") == 0.5, F.col("ap")))).first()
    return tuple(0.0 if v is None or np.isnan(v) else float(v) for v in r)


#: The twelve figures of a report: name, column, size range, detections, threshold.
REPORT = (("AP", "ap", "all", 100, None), ("AP50", "ap", "all", 100, 0.5), ("AP75", "ap", "all", 100, 0.75), ("AP_small", "ap", "small", 100, None), ("AP_medium", "ap", "medium", 100, None), ("AP_large", "ap", "large", 100, None),
          ("AR1", "recall", "all", 1, None), ("AR10", "recall", "all", 10, None), ("AR100", "recall", "all", 100, None), ("AR_small", "recall", "small", 100, None), ("AR_medium", "recall", "medium", 100, None), ("AR_large", "recall", "large", 100, None))


def report(evaluated: DataFrame) -> DataFrame:
    """(metric, value): the means of :func:`evaluate` over categories and thresholds; -1 where no box counts."""
    cond = lambda a, n, t: (F.col("area") == a) & (F.col("max_dets") == n) & (F.lit(True) if t is None else F.col("threshold") == t)
    one = evaluated.agg(*[F.coalesce(F.avg(F.when(cond(a, n, t), F.col(c))), F.lit(-1.0)).alias(name) for name, c, a, n, t in REPORT])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r[0]).alias("metric"), F.col(r[0]).alias("value")) for r in REPORT])).alias("m")).select("m.*")


def class_means(evaluated: DataFrame) -> DataFrame:
    """(category_id, ap, ar): per category, over the thresholds, boxes of all sizes and 100 detections an image."""
    return evaluated.filter("area = 'all' AND max_dets = 100").groupBy("category_id").agg(F.avg("ap").alias("ap"), F.avg("recall").alias("ar"))


def class_report(df: DataFrame) -> DataFrame:
    """Adds val_delta and improved; NULL test scores stay NULL."""
    delta = F.round(F.col("pretrained_val_ap") - F.col("scratch_val_ap"), 3)
    return df.withColumns({"val_delta": delta, "improved": delta > 0})


def class_report_summary(df: DataFrame) -> DataFrame:
    r = class_report(df)
    return r.agg(F.count("*").alias("classes"), F.count("test_ap").alias("measurable_test_classes"), F.count_if("improved").alias("improved_classes"),
                 F.round(F.avg("scratch_val_ap"), 4).alias("mean_scratch_ap"), F.round(F.avg("pretrained_val_ap"), 4).alias("mean_pretrained_ap"), F.round(F.avg("test_ap"), 4).alias("mean_test_ap"))
