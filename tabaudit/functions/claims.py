"""Checkable claims in captions, compared as sets; column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues of each kind of claim.
CUES = {
    "increase": r"increas|\brises?\b|\bgrows?\b|\bhigher\b|upward|\bgain",
    "decrease": r"decreas|\bfalls?\b|\bdrops?\b|\blower\b|downward|declin|reduc",
    "shift": r"level shift|regime|shifts? to|\bjumps?\b|step change|\bbreak",
    "outlier": r"outlier|anomal|stands? out|\bspike|extreme",
    "best": r"\bbest\b|outperform|\bwins?\b|superior|\btop\b|highest|lowest",
}


def claims(text: Column) -> Column:
    """Sorted distinct claims: kinds by their cues, and numbers to two decimals without table numbers and years."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kinds = [F.when(low.rlike(cue), F.lit(kind)) for kind, cue in CUES.items()]
    # The number of a table or figure is a name; any other run of digits, with a part after its point, is a value.
    plain = F.regexp_replace(low, r"\b(?:fig(?:ure)?|tab(?:le)?)(?:\.?\s*)[0-9]+", " ")
    printed = F.regexp_extract_all(plain, F.lit(r"(-?[0-9]+(?:\.[0-9]*)?)"), F.lit(1))
    numbers = F.transform(printed, lambda s: F.rtrim(s, F.lit(".")).try_cast("double"))
    values = F.filter(numbers, lambda v: ~(v.between(1900, 2099) & (v == F.rint(v))))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*kinds)), F.transform(values, lambda v: F.format_string("value %.2f", v)))))


def compare(df: DataFrame, generated: str, real: str) -> DataFrame:
    """Adds shared, generated_only, real_only, recall and precision of two captions' claims."""
    g, r = F.col("_g"), F.col("_r")
    df = df.withColumn("_g", claims(F.col(generated))).withColumn("_r", claims(F.col(real)))
    both = F.array_intersect(g, r)
    share = lambda of: F.size(both) / F.nullif(F.size(of), F.lit(0))
    return df.withColumn("shared", both).withColumn("generated_only", F.array_except(g, r)).withColumn("real_only", F.array_except(r, g)).withColumn("recall", share(r)).withColumn("precision", share(g)).drop("_g", "_r")
