"""Line dedup within one edit, by a deletion-neighbourhood join in DataFrame functions.

A line is a duplicate if an earlier line of the corpus, in the order (doc_id, line number), is
equal to it or, from ``min_chars`` code points on, one inserted, deleted or substituted code
point away from it. Duplicates go, the earliest stays.

Equal lines are met first, by a 128-bit hash. Then the deletion neighbourhoods: each line emits
every variant with one code point deleted, and for the other side of an insertion the line
itself, cut at each position, as hashed keys (text before the cut, text after it). Lines that
share such a key are within one edit of each other *all together*, so each is joined with the
earliest line of its keys only, never in pairs, and that edit distance is verified.

Most lines have no neighbour. A line of which no half is anybody else's half cannot be within
one edit of another, nor can two lines that differ in more than one of some blocks; so variants
are emitted only inside blocks whose two surroundings are shared. Both steps are exact.

Defined results: blank lines (ASCII white space) always stay, so empty texts stay as they are;
lines shorter than ``min_chars`` code points are the duplicates of equal lines only; a null text has no lines and stays null;
null ids come last in the order; rows with equal id and text are one document, written as often
as they occur; lines of any length are taken whole; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import with_checkpoint_dir

MIN_CHARS = 20
#: Candidate lines up to this number (16 bytes of hash each) are sent to all executors to fetch
#: their texts; more are fetched by a shuffled join.
BROADCAST_LINES = 1_000_000


def _hash(*parts: Column) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("\x02"), *parts)]


def _blank(line: str) -> str:
    return rf"not rlike({line}, '[^\\x20\\x09-\\x0D]')"


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """A row per line that is not blank: hash, place and text."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).where(f"not ({_blank('line')})")
    h1, h2 = _hash(F.col("line"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    return cut.select(h1.alias("h1"), h2.alias("h2"), place.alias("place"), "line")


def _half_keys(min_chars: int) -> Column:
    """Hashes of the first and last L code points, L at least a quarter and at most half of the
    line; of two lines within one edit, one of these is shared. Short lines have none."""
    keys = []
    for half in ("length(line) div 2", "(length(line) - 1) div 2"):
        size = f"shiftleft(1, int(floor(log2({half} + 0.5))))"  # the largest power of two in a half
        keys += [F.expr(f"xxhash64(0, {size}, left(line, {size}))"), F.expr(f"xxhash64(1, {size}, right(line, {size}))")]
    return F.when(F.length("line") >= min_chars, F.array_distinct(F.array(*keys))).otherwise(F.expr("array() :: array<bigint>"))


def _shared(keyed: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``keyed`` whose keys another row has too; counts are combined before the
    shuffle, and a hot key is a count, not a group."""
    met = keyed.groupBy(*keys).agg(F.count("*").alias("_met")).where("_met > 1").drop("_met")
    return keyed.join(met, list(keys), "left_semi")


def _neighbours(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, place, line; distinct) with an earlier line at one edit."""
    # blocks: a line of n code points as the shorter (m = n) and as the longer one (m = n - 1)
    roles = F.array(*(F.struct(F.lit(longer).alias("longer"), (F.length("line") - longer).alias("m")) for longer in (0, 1)))
    framed = lines.select("h1", "h2", "place", "line", F.explode(roles).alias("r")).select("h1", "h2", "place", "line", "r.*")
    count = F.greatest(F.lit(2), F.ceil(F.sqrt("m")).cast("int"))
    framed = framed.withColumn("blocks", count)
    block = framed.select("h1", "h2", "place", "line", "longer", "m", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    start = F.floor(F.col("j") * F.col("m").cast("long") / F.col("blocks")).cast("int")
    end = F.floor((F.col("j") + 1) * F.col("m").cast("long") / F.col("blocks")).cast("int")
    around = block.withColumn("s", start).withColumn("tail", F.col("m") - end)
    surroundings = _hash(
        F.col("m"), F.col("j"), F.expr("substr(line, 1, s)"), F.lit("\x00"), F.expr("right(line, tail)")
    )
    inner = F.expr("substr(line, s + 1, length(line) - s - tail)")
    around = around.select("h1", "h2", "place", "longer", surroundings[0].alias("k1"), surroundings[1].alias("k2"), inner.alias("inner"))
    near = _shared(around, "k1", "k2")
    # the variants inside a block: (kind, before, after)
    width = F.length("inner")
    deleted = F.expr(
        "transform(sequence(0, greatest(length(inner) - 1, 0)), i -> struct(longer as kind, substr(inner, 1, i) as before, substr(inner, i + 2) as after))"
    )
    itself = F.expr("transform(sequence(0, length(inner)), i -> struct(1 as kind, substr(inner, 1, i) as before, substr(inner, i + 1) as after))")
    nothing = F.expr("array() :: array<struct<kind: int, before: string, after: string>>")
    variants = F.concat(F.when(width > 0, deleted).otherwise(nothing), F.when(F.col("longer") == 0, itself).otherwise(nothing))
    out = near.select("h1", "h2", "place", "k1", "k2", F.explode(variants).alias("v"))
    v1, v2 = _hash(F.col("k1"), F.col("k2"), F.col("v.kind"), F.col("v.before"), F.lit("\x00"), F.col("v.after"))
    out = out.select("h1", "h2", "place", v1.alias("v1"), v2.alias("v2"))
    # all lines of a key are within one edit: its earliest one is the witness of the others
    earliest = out.groupBy("v1", "v2").agg(F.min(F.struct("place", "h1", "h2")).alias("w"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = out.join(earliest, ["v1", "v2"]).where("w.place < place")
    one = met.groupBy("h1", "h2").agg(F.min("w").alias("w")).select("h1", "h2", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2"))
    texts = lines.select("h1", "h2", "line")
    witness = texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("earlier"))
    checked = one.join(texts, ["h1", "h2"]).join(witness, ["w1", "w2"])
    return checked.where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2")


def dedup_lines(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without duplicate lines, with ``n_lines`` and ``n_removed`` (long; columns of
    these names are replaced)."""
    with_checkpoint_dir(docs.sparkSession)
    lines = _lines(docs, text_col)
    distinct = (
        lines.select("h1", "h2", "place", _half_keys(min_chars).alias("halves"))
        .groupBy("h1", "h2", "halves")
        .agg(F.min("place").alias("place"))
        .checkpoint()
    )
    halves = distinct.select("h1", "h2", "place", F.explode("halves").alias("half"))
    likely = _shared(halves, "half").select("h1", "h2", "place").distinct().checkpoint()
    few = likely.count() <= BROADCAST_LINES
    wanted = F.broadcast(likely) if few else likely
    fetched = lines.join(wanted, ["h1", "h2", "place"]).dropDuplicates(["h1", "h2"]).checkpoint()
    near = _neighbours(fetched)
    kept = distinct.select("h1", "h2", "place").join(near, ["h1", "h2"], "left_anti").select("place.*")
    stay = kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("pos")).alias("_stay"))
    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    whole = docs.select(  # the text travels once, as its lines
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.xxhash64(text_col).alias("_hash"),
        F.split(F.col(text_col), "\n").alias("_lines"),
    )
    stay = stay.select(F.col("doc_id").alias("_sid"), F.col("text_hash").alias("_shash"), "_stay")
    joined = whole.join(stay, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_hash") == F.col("_shash")), "left")
    blank = F.expr(f"filter(transform(_lines, (x, i) -> if({_blank('x')}, i, -1)), i -> i >= 0)")
    places = joined.select("_row", "_lines", F.array_sort(F.concat(F.coalesce("_stay", F.expr("array() :: array<int>")), blank)).alias("_places"))
    left = F.transform("_places", lambda i: F.get("_lines", i))
    n, m = F.coalesce(F.size("_lines"), F.lit(0)), F.coalesce(F.size("_places"), F.lit(0))
    out = places.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in names),
        F.array_join(left, "\n").alias(text_col),
        F.when(F.col("_lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(n - m).cast("long").alias("n_removed"),
    )
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
