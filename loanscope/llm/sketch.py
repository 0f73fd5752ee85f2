"""Document fingerprints: threshold-scaled shingle sketches, in DataFrame functions only.

A sketch keeps every hash of a five-word shingle that lies below a fixed
fraction of the hash range (and always the smallest, so that no text with a
word has an empty sketch).  Sketches of parts merge by union, and because the
fraction is the same for all, the share of one sketch found in another
estimates containment however unequal the texts are.

``with_next`` gives every document the next one in descending id order without
sorting all rows in one task: ids are cut into ranges at ids that occur, and the
first document of each range is copied into the range before it.  Ranges hold
about ``RANGE_BYTES`` of text; their number follows the table's bytes, up to
``FAN * FAN``.  The cuts form a tree of two levels: a literal of at most ``FAN``,
and a broadcast table of at most ``FAN`` rows with as many cuts each (0.5 MB).

Defined cases: null text is the empty text, whose sketch is empty (two empty
sketches have likeness 1, an empty and another 0); a text with fewer words than
a shingle is one shingle; documents that share an id follow each other by text
hash; null ids come last; the only document of a table is its own next; an
empty table gives an empty result.  Ids are numbers, others are refused by
Spark's ``percentile_approx``; all rows of one id lie in one range.  Extra
columns are left out by selecting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import OrderKey
from loanscope.llm.shared import SPACES, ascii_lower
from loanscope.operators.positional import TupleOrder, search, with_position

SHINGLE = 5
# One shingle hash in DENSITY is retained.
DENSITY = 2
# Bytes of text in a range of ids, and cuts in a node of their tree.
RANGE_BYTES = 1 << 20
FAN = 256


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Array of the hashes of all overlapping word shingles, repeats included; empty for a text without words."""
    trimmed = F.btrim(ascii_lower(text), F.lit(SPACES))
    words = F.transform(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - shingle),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(n >= shingle, many).otherwise(F.array(F.xxhash64(h)))

    # A one-element array binds the word hashes to a name, so they are made once.
    bound = F.element_at(F.transform(F.array(words), over), 1)
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(bound)


def sketch(text: Column, *, shingle: int = SHINGLE, density: int = DENSITY) -> Column:
    """Sorted distinct hashes below one part in ``density`` of the hash range, and the smallest of all."""
    below = -(1 << 63) + (1 << 64) // density

    def keep(h: Column) -> Column:
        kept = F.filter(h, lambda x: x < below)
        return F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.sort_array(h), 1, 1))

    kept = F.element_at(F.transform(F.array(shingle_hashes(text, shingle)), keep), 1)
    return F.sort_array(F.array_distinct(kept))


def merge(a: Column, b: Column, *, density: int = DENSITY) -> Column:
    """Sketch of two texts taken together (their shingles across the seam left out)."""
    below = -(1 << 63) + (1 << 64) // density
    both = F.sort_array(F.array_union(a, b))
    kept = F.filter(both, lambda x: x < below)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all shingles of both, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(common / F.size(a))


def as_text(hashes: Column) -> Column:
    """Sixteen hexadecimal digits a hash, one after the other."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _marks(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def range_cuts(docs: DataFrame, *, id_col: str, ranges: int) -> list:
    """Sorted ids that occur and cut the rows into about ``ranges`` even parts; below ``FAN`` in a part of the first level."""
    first = min(ranges, FAN)
    below = -(-ranges // first)
    cuts = docs.agg(F.percentile_approx(id_col, _marks(first), 10 * first).alias("cuts")).first()["cuts"] if first > 1 else None
    cuts = sorted(set(cuts or []))
    if below > 1 and cuts:
        placed = with_position(docs.select(id_col), TupleOrder(docs, [OrderKey(id_col)]), [(c,) for c in cuts], "part")
        found = placed.groupBy("part").agg(F.percentile_approx(id_col, _marks(below), 10 * below).alias("cuts")).collect()
        cuts = sorted(set(cuts).union(*(r["cuts"] or [] for r in found)))
    return cuts


def with_range_code(docs: DataFrame, cuts: list, *, id_col: str, fan: int) -> DataFrame:
    """``docs`` plus ``code``: 2 i for ids above i cuts, 2 i - 1 for those equal to the i-th."""
    order = TupleOrder(docs, [OrderKey(id_col)])
    nodes = [cuts[i:i + fan] for i in range(0, len(cuts), fan)]
    if len(nodes) < 2:
        return with_position(docs, order, [(c,) for c in cuts], "code", split_equal=True)
    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.sparkSession.createDataFrame(list(enumerate(nodes, 1)), f"node int, node_cuts array<{kind}>")
    placed = with_position(docs, order, [(n[0],) for n in nodes], "node").join(F.broadcast(table), "node", "left")
    placed = search(placed, order, ["node_cuts"], fan, "inside", size=F.coalesce(F.size("node_cuts"), F.lit(0)))
    at_cut = F.coalesce(F.try_element_at("node_cuts", F.greatest("inside", F.lit(1))) == F.col(id_col), F.lit(False))
    above = (F.greatest(F.col("node") - 1, F.lit(0)) * fan + F.col("inside")) * 2
    return placed.withColumn("code", above - at_cut.cast("int")).drop("node", "node_cuts", "inside")


def with_next(docs: DataFrame, carry: list[str], *, id_col: str, ranges: int, fan: int = FAN) -> DataFrame:
    """``docs`` (unique column names) plus ``next``, a struct of the ``carry`` columns of the document that follows."""
    found = docs.agg(F.max(id_col).alias("top")).first()
    placed = with_range_code(docs, range_cuts(docs, id_col=id_col, ranges=ranges), id_col=id_col, fan=fan)
    # Rows equal to a cut end their own range and, as guests, start the successor chain of the one above.
    top = F.col(id_col).eqNullSafe(F.lit(found["top"]))
    nowhere = F.lit(None).cast("int")
    places = F.array(
        F.struct(F.floor(F.col("code") / 2).cast("int").alias("range"), F.lit(0).alias("guest")),
        F.struct(F.when(F.col("code") % 2 == 1, F.floor(F.col("code") / 2).cast("int") + 1).otherwise(nowhere).alias("range"), F.lit(1).alias("guest")),
        F.struct(F.when(top, F.lit(0)).otherwise(nowhere).alias("range"), F.lit(2).alias("guest")))
    spread = (placed.withColumn("place", F.explode(F.filter(places, lambda p: p["range"].isNotNull())))
              .withColumns({"range": F.col("place.range"), "guest": F.col("place.guest")}).drop("place", "code"))
    window = Window.partitionBy("range").orderBy(F.col("guest") == 2, F.col(id_col).desc_nulls_last(), F.col("tie"))
    return (spread.withColumn("next", F.lead(F.struct(*carry)).over(window)).filter("guest = 0").drop("range", "guest"))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, density: int = DENSITY, ranges: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sketch, n_chars, edited, edited_sketch, next_sketch) of every document.

    ``edited`` is the text whose last third of code points (rounded down) is
    replaced by the first as many of the next document's text, or all of it.
    ``ranges`` is by default a part for each ``RANGE_BYTES`` of text, ``FAN`` at least.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = base.withColumns({"n_chars": F.char_length("text").cast("long"), "tie": F.xxhash64("text")})
    if ranges is None:
        size = base.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
        ranges = min(max(size // RANGE_BYTES, FAN), FAN * FAN)
    paired = with_next(made, ["text"], id_col="id", ranges=ranges)            # sketches are made where the texts have met
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    paired = paired.withColumns({"edited": edited, "next_text": F.col("next.text")})
    return paired.select("id", "text", sketch(F.col("text"), shingle=shingle, density=density).alias("sketch"), "n_chars", "edited",
                         sketch(F.col("edited"), shingle=shingle, density=density).alias("edited_sketch"),
                         sketch(F.col("next_text"), shingle=shingle, density=density).alias("next_sketch"))
