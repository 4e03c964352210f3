"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is an anchor (a very common word) and the chain of the next content words after it, common words
skipped. A fingerprint is the set of a text's signatures, written as sorted 8-digit hash values. Two
fingerprints are compared by Jaccard similarity, and only where their sizes allow the threshold.

A text without a signature (too short, or in a language without anchors here) has one, made of all its
words, so that different texts still differ. Null, empty and wordless texts have the empty fingerprint;
two empty ones are alike (1), an empty and another are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.common import written

#: Very common words of the corpus languages; a signature starts at each of them.
ANCHORS = (
    "a an and are in is of that the to was "
    "das der des die ein eine ist und zu "
    "dans de du est et la le les un une "
    "el en los que una y"
).split()
#: Content words of a signature.
CHAIN = 2
#: Characters that a range of :func:`ranged` holds on average.
RANGE_CHARS = 8_000_000
#: Ranges at most; past it they grow with the input.
MAX_RANGES = 4096


def words(text: Column) -> Column:
    """Lower-case words with one blank before each and one at the end; null and wordless texts give a blank."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted array of the distinct 32-bit hash values of a text's signatures."""
    anchor = "|".join(ANCHORS)
    skipped = rf"(?:(?:{anchor}) )*+"
    linked = rf"{skipped}[^ ]++ " * chain

    def of_words(body: Column) -> Column:
        # looked ahead from the anchor, so that chains may overlap; then the common words inside go
        chains = F.regexp_extract_all(body, F.lit(rf"(?<= )(?=((?:{anchor}) {linked}))"), F.lit(1))
        whole = F.when(F.length(body) > 2, F.array(body)).otherwise(F.array().cast("array<string>"))
        return _once(chains, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))

    def hashed(spot: Column) -> Column:
        return F.xxhash64(F.regexp_replace(spot, rf"(?<= )(?:{anchor}) ", "")).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.array_sort(F.array_distinct(F.transform(_once(words(text), of_words), hashed)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def fingerprint(sigs: Column) -> Column:
    """A set of signatures as one string of 8 hex digits each; equal sets give equal strings."""
    return F.concat_ws("", F.transform(sigs, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where their sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = _once(F.size(F.array_intersect(a, b)), lambda shared: (shared / (F.size(a) + F.size(b) - shared)).cast("double"))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < least * large), F.lit(0.0))
        .otherwise(exact)
    )


def _range_of(value: Column, cuts: list[float]) -> Column:
    """Number of ``cuts`` (ascending) at or below a value: found among every k-th, then among k."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    count = lambda edges: F.size(F.filter(edges, lambda c: c <= value))
    coarse = count(F.array(*[F.lit(float(c)) for c in cuts[::step]]))
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    fine = (coarse - 1) * step + count(F.slice(edges, (coarse - 1) * step + 1, F.lit(step)))
    return F.when(value.isNull() | (coarse < 1), F.lit(0)).otherwise(fine)


def ranged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """Rows ``doc_id, text, range, copy, last`` from which :func:`_next` finds the next row within a range.

    Ids are cut in ranges of similar numbers of rows, as many as the text volume asks for. The first row of each range goes to the range before
    it as well (``copy``), that of the first range to the last one (``last``). Ranges and their first rows are
    found from the ids alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).collect()[0][0]
    ranges = min(MAX_RANGES, max(1, -(-int(total or 0) // range_chars)))
    shares = [i / ranges for i in range(1, ranges)]
    ids = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, 5 * ranges)) if shares else None
    cuts = sorted(set(ids.collect()[0][0] or ())) if shares else []
    placed = rows.withColumn("range", _range_of(F.col("doc_id").cast("double"), cuts))
    order = Window.orderBy("range")  # one row a range
    heads = (
        placed.groupBy("range")
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("head"))
        .withColumns({"before": F.lag("range").over(order), "end": F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        .select(F.col("range").alias("of"), "head.doc_id", F.coalesce("before", "end").alias("into"), F.col("before").isNull().alias("last"))
        .withColumnRenamed("doc_id", "head_id")
    )
    # at most MAX_RANGES rows of four numbers
    found = placed.join(F.broadcast(heads), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    copies = found.groupBy("of", "into", "last", "doc_id").agg(F.min("text").alias("text"))
    copies = copies.select("doc_id", "text", F.col("into").alias("range"), F.lit(True).alias("copy"), "last")
    return placed.withColumns({"copy": F.lit(False), "last": F.lit(False)}).unionByName(copies)


def _next(column: str) -> Column:
    """The next row's value within a range."""
    return F.lead(column).over(Window.partitionBy("range").orderBy("last", F.col("doc_id").asc_nulls_first(), "copy", "text"))


def successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """``doc_id, text, next_text``: the next row by ascending id, the first row's after the last.

    Null ids come first; rows of one id are ordered by their text. A single row follows itself.
    """
    rows = ranged(docs, doc_id, text, range_chars)
    return rows.withColumn("next_text", _next("text")).filter(~F.col("copy")).select("doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """A text whose last quarter is replaced by the start of the next text."""
    chars = F.char_length(text)
    cut = F.floor(chars / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), chars - cut), F.substring(next_text, F.lit(1), cut))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = CHAIN, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Signatures of each row, of its edited text and of the next row.

    ``doc_id, n_chars, edited_sha256, sigs, edited_sigs, next_sigs``. Texts are shuffled once, by range;
    signatures are computed after it, and the next row's found in the order the texts are in already.
    """
    rows = ranged(docs, doc_id, text, range_chars).withColumn("next_text", F.coalesce(_next("text"), F.lit("")))
    key = ["range", "last", "doc_id", "copy", "text"]
    done = rows.select(*key, edited(F.col("text"), F.col("next_text")).alias("edited_text"), signatures(F.col("text"), chain).alias("sigs"))
    done = done.select(*key, "sigs", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited_text"), chain).alias("edited_sigs"))
    done = done.withColumn("next_sigs", _next("sigs")).filter(~F.col("copy"))
    return done.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited_sha256", "sigs", "edited_sigs", "next_sigs")


def near_duplicates(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """``doc_id, class_id, links``: the class of equal fingerprints of a row, and how many other classes are like it.

    Classes are compared where they share one of the rarest signatures that any pair at ``least`` must
    share (a prefix of each set, rare signatures first) and fall in the same or neighbouring partitions of
    set length. A frequent signature is in few prefixes, so no list grows with the corpus.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text), chain).alias("sigs"))
    own = written(own.withColumn("print", F.sha2(fingerprint(F.col("sigs")), 256)), "signatures")
    classes = written(own.groupBy("print", "sigs").agg(F.min("doc_id").alias("class_id")).withColumn("n", F.size("sigs")), "classes")
    spread = classes.select("print", "n", F.explode("sigs").alias("sig"))
    held = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = Window.partitionBy("print").orderBy("df", "sig")
    prefix = (
        spread.join(held, "sig")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
        .select("print", "n", "sig", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int").alias("part"))
    )
    a = prefix.select(F.col("print").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    b = prefix.select(F.col("print").alias("b"), F.col("n").alias("nb"), "sig", "part")
    pairs = (
        a.join(b, ["sig", "part"])
        .filter((F.col("a") != F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    sets = classes.select("print", "sigs")
    checked = (
        pairs.join(sets.select(F.col("print").alias("a"), F.col("sigs").alias("sa")), "a")
        .join(sets.select(F.col("print").alias("b"), F.col("sigs").alias("sb")), "b")
        .filter(likeness(F.col("sa"), F.col("sb"), least) >= least)
        .select("a", "b")
    )
    linked = checked.select(F.col("a").alias("print")).union(checked.select(F.col("b").alias("print"))).groupBy("print").agg(F.count(F.lit(1)).alias("links"))
    counted = classes.select("print", "class_id").join(linked, "print", "left")
    return own.join(counted, "print").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
