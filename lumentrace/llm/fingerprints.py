"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All shingle hashes of a text are binned once by their high bits; a bin keeps its smallest hash. An empty bin
takes the value of the first filled bin on its own pseudorandom walk over all bins. The low bits of the bins
are packed into words, and the share of equal bins is corrected for bins that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.arrays import let
from lumentrace.llm.common import text_or_empty, words, written

SHINGLE = 5
BITS_OF_BIN = 8
BINS = 1 << BITS_OF_BIN
LOW_BITS = 4
PER_WORD = 64 // LOW_BITS
#: Steps of a walk that are followed before all filled bins are asked.
STEPS = 20
#: Documents that one task pairs with their successors, and the most such groups.
GROUP_ROWS = 512
SLICES = 4096
MAX_GROUPS = 1 << 20


def shingle_hashes(text: Column) -> Column:
    """64-bit hash of every 5-word shingle; a shorter text is one shingle, a text without words none."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        tail = lambda i: F.slice(hashes, F.lit(i + 1), F.greatest(n - i, F.lit(0)))
        zipped = F.arrays_zip(*[tail(i).alias(f"h{i}") for i in range(SHINGLE)])
        full = F.transform(F.slice(zipped, F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda s: F.xxhash64(s))
        short = F.transform(F.slice(zipped, F.lit(1), F.least(n, F.lit(1))), lambda s: F.xxhash64(s))
        return F.when(n >= SHINGLE, full).otherwise(short)

    return let(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)), of)


def walk(bin_: int, step: int) -> int:
    """The bin at a step of a bin's walk: its stride is odd, so that 256 steps visit every bin."""
    return (_start(bin_) + _stride(bin_) * step) % BINS


def _start(bin_: int) -> int:
    return (bin_ * 30011 + 7919 >> 2) % BINS


def _stride(bin_: int) -> int:
    return (bin_ * 40503 + 12345 >> 3 | 1) % BINS


_STEP_BINS = [[walk(b, s) for b in range(BINS)] for s in range(STEPS)]
_STARTS = [_start(b) for b in range(BINS)]
#: A stride's inverse turns a bin into the step at which the walk gets there.
_INVERSES = [pow(_stride(b), -1, BINS) for b in range(BINS)]
_LAST = (1 << (64 - BITS_OF_BIN)) - 1
#: The largest hash of each bin, which marks a bin as empty when nothing smaller is there.
_SENTINELS = [((b - BINS // 2) << (64 - BITS_OF_BIN)) | _LAST for b in range(BINS)]


def _densified(bins: Column) -> Column:
    """Low bits of all bins, empty ones (null) filled from the first filled bin of their walk.

    Few filled bins are asked for the step at which the walk meets them, and the first of them counts; with more,
    the walk is followed for STEPS steps first.
    """
    found = F.filter(
        F.transform(bins, lambda v, b: F.shiftleft(b, LOW_BITS).bitwiseOR(v.cast("int"))), lambda x: x.isNotNull()
    )

    def of(filled: Column) -> Column:
        def first_met(b: Column) -> Column:
            def let_pair(pair: Column) -> Column:
                steps = F.transform(filled, lambda x: F.shiftleft(
                    ((F.shiftright(x, LOW_BITS) - pair["a"]) * pair["i"]).bitwiseAND(F.lit(BINS - 1)), LOW_BITS
                ).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))))
                return F.array_min(steps).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("long")

            return let(F.struct(F.get(F.lit(_STARTS), b).alias("a"), F.get(F.lit(_INVERSES), b).alias("i")), let_pair)

        near = lambda b: [F.get(bins, F.get(F.lit(t), b)) for t in _STEP_BINS]
        sparse = F.transform(bins, lambda v, b: F.coalesce(v, first_met(b)))
        dense = F.transform(bins, lambda v, b: F.coalesce(v, *near(b), first_met(b)))
        return F.when(F.size(filled) == BINS, bins).when(F.size(filled) <= STEPS, sparse).otherwise(dense)

    return let(found, of)


def packed_fingerprint(text: Column) -> Column:
    """The packed low bits (array of 16 longs), or null for a text without words."""
    bin_of = lambda h: F.shiftright(h, 64 - BITS_OF_BIN)

    def least(ordered: Column) -> Column:
        first = F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))
        return F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit(_LAST)) != _LAST, h.bitwiseAND(F.lit((1 << LOW_BITS) - 1))))

    def pack(low: Column) -> Column:
        def word(k: Column) -> Column:
            part = F.slice(low, k * PER_WORD + 1, F.lit(PER_WORD))
            return F.aggregate(part, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, LOW_BITS).bitwiseOR(v))

        return F.transform(F.lit([*range(BINS // PER_WORD)]), word)

    def of(hashes: Column) -> Column:
        ordered = F.sort_array(F.concat(hashes, F.lit(_SENTINELS)))
        return F.when(F.size(hashes) > 0, let(let(let(ordered, least), _densified), pack))

    return let(shingle_hashes(text), of)


def hex_of(packed: Column) -> Column:
    """A fingerprint as 256 hex digits, one per bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: the share of equal bins, corrected for chance and kept in 0 to 1.

    Two texts without words are alike, one of them is not like any other text.
    """
    ones = 0x1111111111111111

    def different(x: Column) -> Column:
        return F.bit_count(
            x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(ones))
        )

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), different)), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << LOW_BITS)
    share = 1.0 - unequal / F.lit(float(BINS))
    found = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(F.isnull(a) & F.isnull(b), F.lit(1.0)).when(F.isnull(a) | F.isnull(b), F.lit(0.0)).otherwise(found)


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__g``, their group in falling order of doc_id, and the heads (__g, head id, group before).

    Groups are even cuts of SLICES even slices between the smallest and largest id, each slice cut by its own
    count; there are at most MAX_GROUPS of them and the slices. Null ids form the last groups, by hash of the
    text. Three numbers and one count per slice reach the driver.
    """
    ids = rows.select(F.col("doc_id").alias("id"))
    low, high, n = ids.agg(F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0)), F.count(F.lit(1))).first()
    per_group, width = max(GROUP_ROWS, -(-n // MAX_GROUPS)), -(-(high - low + 1) // SLICES)
    below = lambda c: F.lit(high).cast("decimal(20,0)") - F.col(c)
    slice_ = lambda c: F.floor(below(c) / width).cast("int")
    counts = ids.filter("id IS NOT NULL").groupBy(slice_("id").alias("s")).count().collect()
    cuts = [0] * SLICES
    for s, c in counts:
        cuts[s] = -(-c // per_group)
    inside = below("doc_id") - slice_("doc_id") * F.lit(width).cast("decimal(20,0)")
    cut = F.floor(inside.cast("double") * F.get(F.lit(cuts), slice_("doc_id")) / width).cast("long")
    of_nulls = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1024))
    group = F.when(F.isnull("doc_id"), of_nulls).otherwise(slice_("doc_id").cast("long") * (1 << 40) + cut)
    marked = rows.withColumn("__g", group)
    heads = marked.groupBy("__g").agg(F.max("doc_id").alias("__head"))
    before = F.coalesce(F.lag("__g").over(Window.orderBy("__g")), F.max("__g").over(Window.partitionBy()))
    return marked, heads.select("__g", "__head", before.alias("__before"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint of each row, and ``next`` and ``next_packed``: those of the next document.

    Next means falling doc_id, and the first after the last. Rows are placed in small groups of neighbouring
    ids; the head of each group goes to the group before it as well. Each text is shuffled once. Rows of one
    id go by hash of their text; null ids come last.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    marked, heads = _grouped(rows)
    heads = written(heads, "heads")
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    # at most MAX_GROUPS + SLICES + 1,024 rows of three numbers: broadcast
    joined = marked.join(F.broadcast(heads), "__g").withColumn("packed", packed_fingerprint(F.col("text")))
    is_head = F.col("doc_id").eqNullSafe(F.col("__head"))
    placed = joined.withColumn(
        "__at", F.explode_outer(F.when(is_head, F.array(F.struct(F.col("__g").alias("g"), F.lit(False).alias("copy")),
                                                        F.struct(F.col("__before").alias("g"), F.lit(True).alias("copy"))))
                                .otherwise(F.array(F.struct(F.col("__g").alias("g"), F.lit(False).alias("copy")))))
    ).select("doc_id", "text", "packed", F.col("__at.g").alias("__g"), F.col("__at.copy").alias("__copy"))
    run = Window.partitionBy("__g").orderBy("__copy", *order)
    led = placed.withColumns({"next": F.lead("text").over(run), "next_packed": F.lead("packed").over(run)})
    return led.filter(~F.col("__copy")).drop("__g", "__copy")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document. Null text is empty, and a text without words has an empty fingerprint.
    Repeated rows follow one another; a single row is its own next document; an empty table gives an empty
    result; other columns are not read.
    """
    led = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    # the outer generator keeps the optimizer from computing the edited text and its fingerprint again
    rows = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.explode_outer(F.array(edited)))
    rows = rows.withColumn("edited_packed", F.explode_outer(F.array(packed_fingerprint(F.col("edited")))))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hex_of(F.col("packed")).alias("fingerprint"), hex_of(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
