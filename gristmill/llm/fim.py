"""Fill-in-middle transformation in relational units.

A text is cut into the matches of a pattern (lines, unless another is given). Matches are exploded with their positions and only
their lengths travel: running sums give the code point after each unit, cut requests find theirs by a join on the unit's ordinal,
the cuts of a document are aggregated to two offsets, and substrings of the whole text make the output.

Distribution: rows with the same id and text are one key (a hash of both) and have the same cuts, so lengths of copies are merged by a
map-side maximum before they are shuffled. What is shuffled is a length per unit and two numbers per document; a text goes through
a shuffle once, and only if the counted offsets are too large to be broadcast.

Null text counts as empty, and an empty text is ``plain`` like one that holds a sentinel. A null id is hashed as empty text. Repeated rows
get equal results, a row each. Very long texts are cut whole. Columns of the input are held under names of their own meanwhile, so
none can clash; added columns replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import small, table, text_or_empty
from gristmill.sources.materialize import materialize

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _draw(id_col: Column, seed: int, i: int) -> Column:
    """The i-th (from 1) group of eight hex digits of the sha256 of ``seed:id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def cut_offsets(keyed: DataFrame, pattern: str) -> DataFrame:
    """_fk, _a, _b (code points before the first and the second cut) of the keys that have units.

    ``keyed`` has _fk (one text and one id for each), _fid and _ft.
    """
    units = keyed.select("_fk", F.posexplode(F.regexp_extract_all("_ft", F.lit(pattern), F.lit(0))).alias("pos", "unit"))
    units = units.select("_fk", (F.col("pos") + 1).alias("ordinal"), F.length("unit").cast("long").alias("len"))
    units = units.groupBy("_fk", "ordinal").agg(F.max("len").alias("len"))  # copies of a row merge here, map-side first
    ends = units.select("_fk", "ordinal", F.sum("len").over(Window.partitionBy("_fk").orderBy("ordinal")).alias("end"))
    requests = keyed.filter("_fn > 0").select("_fk", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.col("_lo").alias("ordinal")), F.struct(F.lit(2).alias("cut"), F.col("_hi").alias("ordinal")))).alias("r"))
    requests = requests.select("_fk", F.col("r.cut").alias("cut"), F.col("r.ordinal").alias("ordinal")).groupBy("_fk", "cut").agg(F.max("ordinal").alias("ordinal"))
    found = requests.join(ends, ["_fk", "ordinal"], "left").withColumn("end", F.coalesce("end", F.lit(0)))
    at = lambda i: F.max(F.when(F.col("cut") == i, F.col("end")))
    return found.groupBy("_fk").agg(at(1).alias("_a"), at(2).alias("_b"))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", pattern: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The columns of ``df`` and n (units), form, prefix_chars, middle_chars (null if plain), output.

    ``rate`` percent of the documents are transformed, ``spm`` percent of those suffix first; cuts, rate and form are drawn
    from the id alone. The pattern's matches must tile the text.
    """
    p, s, m = sentinels
    held = df.select(*[df[c].alias(f"_in{i}") for i, c in enumerate(df.columns)], df[id_col].alias("_fid"), text_or_empty(df[text].cast("string")).alias("_ft"))
    held = held.withColumn("_fk", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("_fid").cast("string"), F.lit("")), F.col("_ft")))))  # 16 bytes
    n = F.regexp_count("_ft", F.lit(pattern)).cast("long")
    plain = (F.col("_ft") == "") | F.contains("_ft", F.lit(p)) | F.contains("_ft", F.lit(s)) | F.contains("_ft", F.lit(m)) | (_draw(F.col("_fid"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("_fid"), seed, 4) % 100 < spm, "spm").otherwise("psm")
    cuts = [_draw(F.col("_fid"), seed, i) % (F.col("_fn") + 1) for i in (1, 2)]
    head = held.select("_fk", "_fid", "_ft", n.alias("_fn")).withColumns({"_lo": F.least(*cuts).cast("int"), "_hi": F.greatest(*cuts).cast("int")})
    offsets = materialize(cut_offsets(head, pattern), "offsets")
    rows = held.join(small(offsets, offsets.count(), 64), "_fk", "left").withColumns({"_fn": n, "_form": form})
    t, a, b = F.col("_ft"), F.coalesce("_a", F.lit(0)).cast("int"), F.coalesce("_b", F.lit(0)).cast("int")
    first, mid, rest = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
    out = (F.when(F.col("_form") == "psm", F.concat(F.lit(p), first, F.lit(s), rest, F.lit(m), mid))
           .when(F.col("_form") == "spm", F.concat(F.lit(s), rest, F.lit(p), first, F.lit(m), mid)).otherwise(t))
    chars = lambda c: F.when(F.col("_form") != "plain", c.cast("long"))
    keep = [F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns) if c not in ADDED]
    return rows.select(*keep, F.col("_fn").alias("n"), F.col("_form").alias("form"), chars(a).alias("prefix_chars"), chars(b - a).alias("middle_chars"), out.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from. No sentinel can stand in or across the parts, so the first of each is the one set."""
    p, s, m = sentinels
    head, middle = F.split_part(output, F.lit(m), F.lit(1)), F.split_part(output, F.lit(m), F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, F.lit(p), F.lit(2)), F.lit(s), F.lit(1)), middle, F.split_part(head, F.lit(s), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(p), F.lit(2)), middle, F.split_part(F.split_part(head, F.lit(s), F.lit(2)), F.lit(p), F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
