"""Secret scanning with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found in whole texts, their values hashed, and each hash is aggregated over the corpus: distinct owners
(``source``) and repositories (``doc_id``). A value seen with ``EXAMPLE_OWNERS`` owners or in ``EXAMPLE_REPOS`` repositories or more is a
copied example, otherwise it looks live. Base kinds are always reported; vendor formats and opaque mixed strings that neither hold nor lie in a
base span are added to them where they look live; an opaque string is also kept clear of vendor formats, so a secret is reported once.

Positions are code points, end exclusive. They come from splitting the text at the matches: each match becomes a row with the length
of the gap before it, and a running sum over a text's matches gives its place, so the work is linear in the length of a text. Owners
and repositories are counted in two steps (equal ones are merged first), and the few that are copied are what the candidates are joined with, so a value copied
everywhere is no hot key.

Null text counts as empty and has no span. Repeated rows are reported each; a null source counts as one owner, a null doc_id as one
repository. Only id, text and owner are read, so other columns cannot clash. Very long texts are scanned whole. Empty input
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import small, table, text_or_empty
from gristmill.sources.materialize import materialize

EXAMPLE_OWNERS, EXAMPLE_REPOS = 5, 50
# fixed values: the base kinds, in the order of the contract. {24,} and {16,} find what the open-ended forms keep
# after short matches are dropped; assign needs its short matches, since they use up text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 0), ("hex", "[0-9a-f]{24,}", 0, 0))
ADDED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{28,}+={0,2}+(?![A-Za-z0-9+/_=-])", 0, 0),
)
KINDS = [k for k, *_ in BASE + ADDED]
BASE_KINDS = len(BASE)


def _matches(text: Column, o: int, pattern: str, group: int) -> Column:
    """Array of (o, i, gap, size, v) of the leftmost matches of kind number ``o``: the i-th one, after ``gap`` other characters."""
    found, values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    one = lambda x, i: F.struct(F.lit(o).alias("o"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("v"))
    return F.when(text.rlike(pattern), F.transform(F.slice(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), 1, F.size(found)), one))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(rows: DataFrame) -> DataFrame:
    """rid, id, owner, o (kind), s, e, v of all spans; ``rows`` has rid, id, owner and matches. Base spans, and others clear of them."""
    least = F.create_map(*[F.lit(x) for o, k in enumerate(BASE + ADDED) for x in (o, k[3])])
    found = rows.select("rid", "id", "owner", F.explode("matches").alias("m")).select("rid", "id", "owner", "m.*").repartition("rid")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "o").orderBy("i"))
    found = found.withColumn("e", end.cast("int")).withColumn("s", F.col("e") - F.col("size")).filter(F.length("v") >= least[F.col("o")])
    # of the base spans that start no later, the furthest end; of those that start no earlier, the nearest end
    up, down = (Window.partitionBy("rid").orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in ("s", F.desc("s")))

    def clear_of(kinds: int) -> Column:
        """Whether a span neither holds nor lies in one of the first ``kinds`` kinds."""
        end = F.when(F.col("o") < kinds, F.col("e"))
        return ~(F.coalesce(F.max(end).over(up) >= F.col("e"), F.lit(False)) | F.coalesce(F.min(end).over(down) <= F.col("e"), F.lit(False)))

    opaque = KINDS.index("opaque")
    clear = F.when(F.col("o") == opaque, clear_of(opaque)).otherwise(clear_of(BASE_KINDS))
    mixed = F.col("v").rlike("[0-9]") & F.col("v").rlike("[a-z]") & F.col("v").rlike("[A-Z]")
    fine = (F.col("o") < BASE_KINDS) | clear & ((F.col("o") != opaque) | mixed)
    return found.withColumn("fine", fine).filter("fine").select("rid", "id", "owner", "o", "s", "e", "v")


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of ``df``: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example (candidates that look live, and copied ones)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), text_or_empty(text).alias("t"))
    every = F.flatten(F.array_compact(F.array(*[_matches(F.col("t"), o, *k[1:3]) for o, k in enumerate(BASE + ADDED)])))
    rows = materialize(rows.select("id", "owner", every.alias("matches"), F.monotonically_increasing_id().alias("rid")), "matches")
    each = materialize(candidates(rows).select("rid", "id", "owner", "o", "s", "e", F.md5("v").alias("hash")), "secrets")
    repo = F.coalesce(F.col("id").cast("string"), F.lit(""))
    copied = each.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct(repo).alias("repos")).filter((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos))
    copied = materialize(copied.select("hash", F.lit(True).alias("copied")), "copied")
    seen = each.join(small(copied, copied.count(), 48), "hash", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    span = F.struct("s", "o", "e")
    n = lambda o: F.count_if(F.col("o") == o).alias(f"n_{KINDS[o]}")
    kept = seen.groupBy("rid").agg(*[n(o) for o in range(BASE_KINDS)], F.count_if("copied").alias("n_example"), F.count_if(~F.col("copied")).alias("n_live"),
                                   F.collect_list(F.when(F.col("o") < BASE_KINDS, span)).alias("base"), F.collect_list(F.when((F.col("o") < BASE_KINDS) | ~F.col("copied"), span)).alias("all"))
    kept = kept.select("rid", *[f"n_{KINDS[o]}" for o in range(BASE_KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_live", "n_example")
    out = rows.select("rid", "id").join(kept, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), *[zero(f"n_{KINDS[o]}") for o in range(BASE_KINDS)], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
