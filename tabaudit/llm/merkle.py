"""Document fingerprints: a Merkle tree of paragraphs, sections and the whole text, in DataFrame functions only.

A paragraph is a line. A section begins with the text, after an empty line, and at a line that starts with '#'. The digest of
a paragraph is that of its text, a section's that of its paragraphs' digests, the root that of the sections' digests, so the
roots are equal if and only if the texts are (up to collisions of SHA-256), and going down from a differing root finds the
sections and paragraphs that were edited. Below the paragraphs stand marks: 32-bit hashes of up to four words that end at
punctuation; likeness is the Dice coefficient of two fingerprints' distinct marks, so it also grades edits of a single paragraph.

Nodes are built from whole digests. The printed form is root ':' sections ':' marks, with a section as its digest, '[', its
paragraphs' digests, ']', each cut to 16 hexadecimal digits, the root whole, and 8 digits a mark.

Defined results: null is the empty text, which has one empty paragraph and no marks; two texts without marks are alike 1 if
their roots are equal, else 0; rows with the same doc_id are ordered by text; a null doc_id comes last, and where all are null the last row counts as its own next; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cut_points, slot
from .store import partitions

#: White space, or up to four words, fewer if one ends with punctuation.
PIECE = r"\s+|(?:[^\s]+\s+){0,3}?[^\s]*[.,;!?|](?=\s|$)|(?:[^\s]+\s+){0,3}[^\s]+"


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def marks(text: Column) -> Column:
    """Distinct 32-bit hashes of the pieces that aren't white space."""
    pieces = F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.hash(p)))


def sections(text: Column) -> Column:
    """array<struct<digest, paragraphs array<string>>>; the tree below the root."""
    lines = F.split(text, "\n")
    # The text is cut at each place where a section begins; the zero-width match keeps every character.
    parts = F.split(text, r"(?<=\n\n)(?=[^\n#])|(?<=\n)(?=#)")
    per = F.transform(F.when(F.size(lines) > 1, parts).otherwise(F.array(text)), lambda s: F.transform(F.split(s, "\n"), _digest))
    return F.transform(per, lambda ps: F.struct(_digest(F.concat_ws(",", ps)).alias("digest"), ps.alias("paragraphs")))


def root(tree: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.transform(tree, lambda s: s["digest"])), 256)


def printed(root_: Column, tree: Column, marks_: Column) -> Column:
    inner = F.transform(tree, lambda s: F.concat(_short(s["digest"]), F.lit("["), F.concat_ws("", F.transform(s["paragraphs"], _short)), F.lit("]")))
    return F.concat(root_, F.lit(":"), F.concat_ws("", inner), F.lit(":"), F.concat_ws("", F.transform(marks_, lambda m: F.lpad(F.hex(m.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))))


def likeness(root_a: Column, marks_a: Column, root_b: Column, marks_b: Column) -> Column:
    total = F.size(marks_a) + F.size(marks_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(marks_a, marks_b)) / F.nullif(total, F.lit(0)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds tree, marks, root and fingerprint to the rows; names that are taken get the prefix merkle_."""
    names = {n: n if n not in docs.columns else f"merkle_{n}" for n in ("tree", "marks", "root", "fingerprint")}
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(names["tree"], sections(t)).withColumn(names["marks"], marks(t))
    df = df.withColumn(names["root"], root(F.col(names["tree"])))
    return df.withColumn(names["fingerprint"], printed(F.col(names["root"]), F.col(names["tree"]), F.col(names["marks"])))


def differing_paragraphs(tree_a: Column, tree_b: Column) -> Column:
    """Digests of paragraphs of a that b lacks, looked for only in sections whose digests b lacks: where the edits are."""
    known = F.transform(tree_b, lambda s: s["digest"])
    changed = F.filter(tree_a, lambda s: ~F.array_contains(known, s["digest"]))
    return F.array_except(F.flatten(F.transform(changed, lambda s: s["paragraphs"])), F.flatten(F.transform(tree_b, lambda s: s["paragraphs"])))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the next row in descending doc_id (after the last: the first), without a global window.

    The rows are dealt into ranges of doc_id, in each of which a window looks one row ahead; the first row of the next range
    visits as a guest. Only cut points and one doc_id a range come to the driver."""
    spark = docs.sparkSession
    cuts = cut_points(docs, "doc_id", 4 * partitions(spark))
    known = docs.select("doc_id").where("doc_id is not null").groupBy(slot(F.col("doc_id"), cuts).alias("_slot"))
    found = known.agg(F.max("doc_id").alias("m"), F.min("doc_id").alias("least")).collect()  # a row a range
    firsts = sorted((r["_slot"], r["m"]) for r in found)
    least = min((r["least"] for r in found), default=0)
    # Rows without a doc_id come last, so they stand with the least.
    rows = docs.withColumn("_slot", slot(F.coalesce("doc_id", F.lit(least)), cuts)).withColumn("_guest", F.lit(0))
    if firsts:
        before = [firsts[-1], *firsts[:-1]]
        by_guest: dict[int, list[int]] = {}
        for (s, _), (_, m) in zip(firsts, before, strict=True):
            by_guest.setdefault(m, []).append(s)
        to = F.create_map(*[F.lit(x) for m, slots in by_guest.items() for x in (m, slots[0])])
        guests = docs.where(F.col("doc_id").isin(list(by_guest))).withColumn("_slot", to[F.col("doc_id")]).withColumn("_guest", F.lit(1))
        rows = rows.unionByName(guests)
    w = Window.partitionBy("_slot").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    out = rows
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where("_guest = 0").drop("_slot", "_guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = base.withColumn("marks", marks(F.col("text")))
    both = with_next(own, ["text", "marks"])
    n = F.length("text")
    k = (n / 3).cast("long").cast("int")
    nxt = F.coalesce(F.col("next_text"), F.col("text"))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(nxt, F.lit(1), k)))
    both = both.withColumn("next_root", root(sections(nxt))).drop("next_text")
    a = both.withColumn("tree", sections(F.col("text"))).withColumn("root", root(F.col("tree")))
    a = a.withColumn("edited_tree", sections(F.col("edited"))).withColumn("edited_root", root(F.col("edited_tree"))).withColumn("edited_marks", marks(F.col("edited")))
    return a.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("root"), F.col("tree"), F.col("marks")).alias("fingerprint"),
        printed(F.col("edited_root"), F.col("edited_tree"), F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("marks"), F.col("edited_root"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("root"), F.col("marks"), F.col("next_root"), F.coalesce("next_marks", "marks")).alias("near_next"),
    )
