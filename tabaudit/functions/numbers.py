"""Numbers as they are printed in tables: parsing, decimals, rounding keys; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "no value".
MISSING = ("", "--", "-", "n/a", "na", "nan", "none", "null")

_NUM = r"[+-]?(?:\d+(?:_\d+)*\.?\d*|\.\d+)"
#: A cell that prints a number: its digits (1) and exponent (2), and one ending: a power of ten (3), a magnitude (4), or a bracket.
#: Both parsers, of columns here and of small grids in sources/infer.py, read cells by it.
CELL = rf"^({_NUM})([eE][+-]?\d+)?(?:\s*(?:[×xX]|\\times)?\s*10\s*\^\s*\{{?\s*([+-]?\d+)\s*\}}?|\s?([kKMB])|\s*(?:\[[^\]]+\]|\([^)]*\)))?$"
#: Powers of ten by magnitude.
MAGNITUDES = {"k": 3, "K": 3, "M": 6, "B": 9}


def parse_number(cell: Column) -> Column:
    """The number in a cell, or null: separators and percent signs dropped, powers of ten, k/K/M/B, and what comes before a bracket."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(cell), "[,%]", ""), "−", "-"))

    def read(text: Column) -> Column:
        digits, exponent, power, unit = (F.regexp_extract(text, CELL, i) for i in range(1, 5))
        tens = F.when(power != "", power)
        for name, n in MAGNITUDES.items():
            tens = tens.when(unit == name, F.lit(str(n)))
        # An exponent and an ending that multiplies exclude each other.
        both = (exponent != "") & ((power != "") | (unit != ""))
        printed = F.concat(F.regexp_replace(digits, "_", ""), F.when(exponent != "", exponent).otherwise(F.concat(F.lit("e"), tens.otherwise("0"))))
        return F.when(text.rlike(CELL) & ~both, printed.try_cast("double"))

    # The cleaned text is bound to a name once, so that plans don't repeat it at each use.
    x = F.get(F.transform(F.array(bare), read), 0)
    return F.when(~is_missing(cell) & (F.abs(x) < float("inf")), x)


def is_missing(cell: Column) -> Column:
    return cell.isNull() | F.lower(F.trim(cell)).isin(*MISSING)


def numeric_share(cell: Column) -> Column:
    """Aggregate: the share of cells with a value that are numbers; null if none has a value."""
    return F.avg(F.when(~is_missing(cell), parse_number(cell).isNotNull().cast("double")))


def decimals(raw: Column) -> Column:
    """Digits after the point of the first number printed."""
    return F.length(F.regexp_extract(F.trim(raw), r"^[+-]?\d*\.(\d+)", 1))


def rounding_tolerance(raw: Column) -> Column:
    """Half a unit of the last printed digit, times the power of ten of scientific notation; 0 where nothing is printed."""
    power = F.regexp_extract(F.trim(raw), r"^[+-]?\d*\.?\d*(?:[eE]|(?:\s*(?:×|x|\\times)\s*10\s*\^\s*\{?))([+-]?\d+)", 1)
    scale = F.when(power != "", F.pow(F.lit(10.0), power.try_cast("double"))).otherwise(1.0)
    return F.when(raw.isNull() | (F.trim(raw) == ""), 0.0).otherwise(0.5 * F.pow(F.lit(10.0), -decimals(raw)) * scale)


# Words that tell what a metric is and which way it gets better.
METRIC_WORDS = ("rmse", "mae", "mse", "error", "err", "loss", "accuracy", "acc", "score", "auc", "f1", "precision", "recall", "value", "runtime", "time", "latency")
LOWER_WORDS = ("rmse", "mae", "mse", "error", "err", "loss", "runtime", "time", "latency", "errors", "ppl", "perplexity", "wer", "cer", "fid")
HIGHER_PARTS = ("accuracy", "acc", "auc", "f1", "precision", "recall", "score")
HIGHER_WORDS = ("bleu", "rouge", "pass", "top", "map", "miou", "iou", "em")
LEXICONS = (("low", "medium", "med", "high"), ("none", "some", "all"), ("both known", "p_1 known", "p_2 known", "both unknown"), ("small", "medium", "large"), ("cold", "warm", "hot"))


def metric_direction(name: Column) -> Column:
    """'lower', 'higher' or null: arrows first, then words of errors, then words of scores."""
    low = F.lower(name)
    word = lambda ws: low.rlike("(^|[^a-z])(" + "|".join(ws) + ")($|[^a-z])")
    return F.when(name.contains("↑"), "higher").when(name.contains("↓"), "lower").when(word(LOWER_WORDS), "lower").when(low.rlike("|".join(HIGHER_PARTS)) | word(HIGHER_WORDS), "higher")
