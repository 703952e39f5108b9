"""Line dedup as an exact set-similarity join: prefixes of the rarest words, length and positional filters, Jaccard; DataFrame functions only.

Each line's words are hashed once, into a table from which all else is read. Of
equal lines the first goes on. A line's prefix, its rarest words, makes rows
that meet by word and class of length, the shorter line with the longer; a pair
is a candidate if its lengths, the places of the word, and a sketch of both
sets (128 bits, 256 for long lines) allow the similarity, and is verified on the full sets.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.shared import discard, give_back, joinable, keep, unused

PERCENT = 75
#: Words are counted in this many classes of their hash, 2 ** CLASS_BITS; the counts come to the driver.
CLASS_BITS = 15
#: Of the lines that share a word of their prefixes, the first PIVOTS are compared with all others before any others are, so that a group of near
#: copies does not make all its pairs; the SAMPLE words of the least hashes, which near copies mostly share, are enough for that.
PIVOTS, SAMPLE = 3, 4
#: Prefixes are joined in so many rounds of words, for short lines and for long ones, so that their rows don't all lie on disk at once.
ROUNDS = 3
#: From this class of lengths on (128 words) pairs are compared by all 256 bits of their sketches: 128 bits are as good as full there, and
#: unrelated lines would pass.
LONG = 16
#: What names a line, in the order in which lines come: its document's id, its number there, and the hash of the document's text.
LINE = ["doc", "no", "of"]
_SIGN = 1 << (CLASS_BITS - 1)


def text_hash(text_col: str) -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(F.col(text_col).cast("string"))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no, of, h1, h2, tokens) of the lines that are not blank: the hash of their text, two of the line, and those of its distinct words."""
    low = docs.select(F.col(id_col).alias("doc"), text_hash(text_col).alias("of"), F.lower(F.col(text_col).cast("string")).alias("low"))
    spaced = F.when(F.col("low").rlike("[\t\x0b\f\r]"), F.translate("low", "\t\x0b\f\r", "    ")).otherwise(F.col("low"))
    # outer, as the filter that comes with the other explode would split each text twice
    lines = low.select("doc", "of", spaced.alias("spaced")).select("doc", "of", F.posexplode_outer(F.split("spaced", "\n")).alias("no", "line")).where((F.ascii("line") > 32) | (F.trim("line") != ""))
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    tokens = F.array_except(words, F.array(F.xxhash64(F.lit(""))))  # distinct, without the empty words between two spaces
    return lines.select(*LINE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), tokens.alias("tokens"))


def class_order(lines: DataFrame) -> tuple[Column, list[int]]:
    """What turns the upper half of a hash into its place by rarity, and such places up to which one, two and three quarters of all words lie.

    The class of a hash is its upper bits; a place is the half with the rank of its class among the counts in their stead.
    """
    n_classes, low_bits = 1 << CLASS_BITS, 32 - CLASS_BITS
    counts = [0] * n_classes  # fixed in size, whatever the data
    found = lines.select(F.explode("tokens").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - CLASS_BITS).alias("c")).agg(F.count("*").alias("n")).toArrow()
    for c, n in zip(found.column("c").to_pylist(), found.column("n").to_pylist()):
        counts[c] = n
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    change, below, quarters, every = [0] * n_classes, 0, [0, 0, 0], sum(counts)
    for rank, c in enumerate(sorted(range(n_classes), key=lambda c: (counts[c], c))):
        change[c] = signed(((rank ^ _SIGN) ^ c) << low_bits)
        quarters = [rank if 4 * below < k * every else q for k, q in enumerate(quarters, 1)]
        below += counts[c]
    del found, counts
    give_back()  # on the driver
    return F.from_json(F.lit(json.dumps(change, separators=(",", ":"))), "array<int>"), [signed((q ^ _SIGN) << low_bits) + k for k, q in enumerate(quarters)]  # never the same


def _size_class(n: Column) -> Column:
    """Lengths in classes that grow by a half and by a third in turn: of 2 ** k on, and of 3 * 2 ** k on."""
    digits = F.length(F.bin(n.cast("long")))
    return 2 * digits + F.when(F.substring(F.bin(n.cast("long")), 2, 1) == "1", 1).otherwise(0)


def _class_start(size: Column) -> Column:
    """The least length of a class."""
    half = F.shiftrightunsigned(size, 1)
    return F.shiftrightunsigned(F.call_function("shiftleft", 2 + size.bitwiseAND(F.lit(1)), half) + 3, 2)


def prefixes(lines: DataFrame, percent: int) -> DataFrame:
    """(id, doc, no, n, size, s1, s2, s3, s4, prefix) of the lines.

    The prefix holds the places of the line's rarest words, the rarest first; s1
    to s4 are sketches of its words by quarters of rarity, in which each word
    turns one bit; size is the class of n. Places are halves of hashes: two words may fall on one, which
    adds candidates and never loses one, as both keep a place of their own.
    """
    order, quarters = class_order(lines)
    # never null, as Spark sorts arrays that may hold nulls as objects
    placed = F.transform("tokens", lambda h: F.coalesce(F.shiftright(h, 32).cast("int").bitwiseXOR(F.get(order, F.shiftrightunsigned(h, 64 - CLASS_BITS).cast("int"))), F.lit(0)))
    n = F.size("tokens")
    length = (n - F.ceil(n * percent / 100) + 1).cast("int")
    ordered = lines.select("id", "doc", "no", n.alias("n"), length.alias("length"), F.sort_array(F.concat(placed, F.array(*(F.lit(q) for q in quarters)))).alias("places"))
    ordered = ordered.withColumns({f"c{k}": F.array_position("places", F.lit(q)).cast("int") for k, q in enumerate(quarters, 1)})
    parts = ["slice(places, 1, c1 - 1)", "slice(places, c1 + 1, c2 - c1 - 1)", "slice(places, c2 + 1, c3 - c2 - 1)", "slice(places, c3 + 1, n + 3 - c3)"]
    sketches = (F.expr(f"aggregate({part}, 0L, (a, x) -> a ^ shiftleft(1L, x))").alias(f"s{k}") for k, part in enumerate(parts, 1))
    prefix = F.expr(f"CASE WHEN c1 > length THEN slice(places, 1, length) WHEN c2 > length + 1 THEN concat({parts[0]}, slice(places, c1 + 1, length + 1 - c1)) ELSE slice(concat({', '.join(parts)}), 1, length) END")
    return ordered.select("id", "doc", "no", "n", _size_class(F.col("n")).alias("size"), *sketches, prefix.alias("prefix"))


def _allowed(total: Column, apart: Column, least: Column, percent: int) -> Column:
    """The sketch, length and positional filters in whole numbers, the most selective first."""
    return (apart * (100 + percent) <= total * (100 - percent)) & (least * (100 + percent) >= total * percent)


def _apart(*sides: tuple[str, str]) -> Column:
    """How many bits of these sketches differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in sides))


def _joined(rows: DataFrame, sketches: list[str], percent: int) -> DataFrame:
    """(one, other, apart): ids of the candidates among rows with one key, and how many bits of their sketches differ for a thousand words.

    Both sides are the same columns of the same rows, and every condition needs both, so that the rows are shuffled once.
    """
    side = lambda x: rows.select("key", *(F.col(c).alias(f"{x}{c}") for c in ("id", "doc", "held", *sketches)))
    parts = {"n": "cast(shiftright({}, 32) as int)", "at": "cast(shiftright({} & 4294967295L, 1) as int)", "done": "({} & 1L) = 1L"}
    joined = side("a_").join(side("b_").hint("merge"), "key").withColumns({f"{x}{name}": F.expr(of.format(f"{x}held")) for x in ("a_", "b_") for name, of in parts.items()})
    total, apart = F.col("a_n") + F.col("b_n"), _apart(*((f"a_{c}", f"b_{c}") for c in sketches))
    surely = lambda x, y: F.col(f"{y}_done") & (F.col(f"{x}_done") | F.coalesce(F.col(f"{x}_doc") < F.col(f"{y}_doc"), F.lit(False)))
    passed = joined.where(F.col("a_id") < F.col("b_id")).where(_allowed(total, apart, F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")), percent))
    passed = passed.where(~(surely("a", "b") | surely("b", "a")))
    return passed.select(F.col("a_id").alias("one"), F.col("b_id").alias("other"), (apart * 1000 / total).cast("int").alias("apart")).distinct()


#: n, a word's place in the line, and whether the line is done, in one number
_HELD = "shiftleft(cast(n as long), 32) | shiftleft(cast(at as long), 1) | cast(done as long)"


def _pivot_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """(later, earlier, apart): the candidates of which the earlier is among the first lines of a word of both prefixes and their class of lengths; for some of their words."""
    # the lower bits of a place are those of the word's hash; with them a word goes by where it stands
    hashed = F.transform("prefix", lambda token, at: F.coalesce(F.shiftleft(token.cast("long"), 32 + CLASS_BITS).bitwiseOR(at.cast("long")), F.lit(0)))
    rows = heads.selectExpr("id", "doc", "no", "n", "s1 ^ s2 AS s1", "s3 ^ s4 AS s3", "size", "prefix").select("*", F.explode(F.slice(F.sort_array(hashed), 1, SAMPLE)).alias("word"))
    rows = rows.withColumn("at", F.expr("cast(word & 2147483647L as int)"))
    rows = rows.select("id", "doc", "no", "n", "at", "s1", "s3", F.xxhash64(F.get("prefix", F.col("at")), "size").alias("key"))
    before = Window.partitionBy("key").orderBy("doc", "no", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = [F.nth_value(F.struct("id", "n", "at", "s1", "s3"), i).over(before) for i in range(1, PIVOTS + 1)]
    met = rows.select("id", "n", "at", "s1", "s3", F.array(*firsts).alias("firsts")).where(F.col("firsts")[0]["id"] != F.col("id"))
    met = met.select("id", "n", "at", "s1", "s3", F.explode("firsts").alias("p")).where(F.col("p.id") != F.col("id"))
    total, apart = F.col("n") + F.col("p.n"), _apart(("s1", "p.s1"), ("s3", "p.s3"))
    passed = met.where(_allowed(total, apart, F.least(F.col("n") - F.col("at"), F.col("p.n") - F.col("p.at")), percent))
    return passed.select(F.col("id").alias("later"), F.col("p.id").alias("earlier"), (apart * 1000 / total).cast("int").alias("apart")).distinct()


def _pairs(heads: DataFrame, long: bool, part: int, parts: int, percent: int) -> DataFrame:
    """(one, other, apart): the candidates that share a prefix word of this part of all words, the longer line being a long one or not, but for those whose later line is ``done``, where the documents tell it, or both are.

    Lines meet by word and class of lengths. Each word of a line makes a row for the line's
    own class, and one for each class above that the place of the word allows a longer line to have.
    """
    above = next(i for i in range(200) if (4 / 3) ** i >= 100 / percent)
    lines = heads.where(F.col("size") >= LONG - above) if long else heads.where(F.col("size") < LONG)
    sketches = ["s1", "s2", "s3", "s4"] if long else ["s1 ^ s2 AS s1", "s3 ^ s4 AS s3"]
    rows = lines.selectExpr("id", "doc", "n", *sketches, "size", "done", "posexplode(prefix) AS (at, token)").where(F.pmod("token", F.lit(parts)) == part)
    longest = F.expr(f"cast((n - at) * {100 + percent} div {percent} as int) - n")
    more = reduce(Column.__add__, ((longest >= _class_start(F.col("size") + i)).cast("int") for i in range(1, above + 1)), F.lit(1))
    rows = rows.withColumn("held", F.expr(_HELD)).withColumn("size", F.explode(F.slice(F.array(*(F.col("size") + i for i in range(above + 1))), F.lit(1), more)))
    rows = rows.where(F.col("size") >= LONG if long else F.col("size") < LONG)
    names = [x.split()[-1] for x in sketches]
    return _joined(rows.select("id", "doc", "held", *names, F.xxhash64("token", "size").alias("key")), names, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(later) ids of the pairs (later, earlier) that match on their full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_set"))
    both = F.size(F.array_intersect("later_set", "earlier_set"))
    matched = both * 100 >= (F.size("later_set") + F.size("earlier_set") - both) * percent
    return pairs.join(side("later"), "later").join(side("earlier"), "earlier").where(matched).select("later").distinct()


def _in_order(pairs: DataFrame, sets: DataFrame, done: DataFrame) -> DataFrame:
    """(later, earlier, apart) of the pairs (one, other, apart) whose later line is not ``done``."""
    side = lambda c: sets.select(F.col("id").alias(c), F.struct("doc", "no", "id").alias(f"{c}_name"))
    named = pairs.join(joinable(side("one")), "one").join(joinable(side("other")), "other")
    first = F.col("one_name") < F.col("other_name")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return named.select(pick("other", "one").alias("later"), pick("one", "other").alias("earlier"), "apart").join(joinable(done.select(F.col("id").alias("later"))), "later", "left_anti")


def _matched(pairs: DataFrame, lines: DataFrame, percent: int, done: DataFrame | None = None) -> DataFrame:
    """(id, doc, no, of) of the later lines of pairs that match on their full sets.

    With ``done`` the pairs come in no order, those whose later line is done are
    dropped, and nothing reads ``lines`` afterwards. Most candidates match, so
    each later line is first compared with the earlier one of the nearest
    sketch, and only where these differ with others.
    """
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return lines.select("id", *LINE).limit(0)
    a, b = pairs.columns[:2]
    wanted = keep(pairs.select(F.col(a).alias("id")).union(pairs.select(F.col(b).alias("id"))).distinct(), "wanted")
    sets = keep(lines.select("id", *LINE, "tokens").join(joinable(wanted), "id", "left_semi"), "sets")
    if done is not None:
        discard(lines)
        pairs = keep(_in_order(pairs, sets, done), "ordered")
    one = keep(_verified(pairs.groupBy("later").agg(F.min_by("earlier", "apart").alias("earlier")), sets, percent), "one")
    more = _verified(pairs.join(joinable(one), "later", "left_anti").select("later", "earlier"), sets, percent)
    return keep(sets.select("id", *LINE).join(one.union(more).withColumnRenamed("later", "id"), "id", "left_semi"), "matched")


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, no, of): the lines, by id, number from 0 and hash of the text, that an earlier line matches with Jaccard >= ``percent`` / 100 on their sets of words.

    Earlier is by id, then by number, then by that hash. Of equal lines the first
    goes on to the similarity join, the others match it.
    """
    plain = {"parquet.enable.dictionary": "false"}  # hashes hardly repeat
    lines = keep(hashed_lines(docs, id_col, text_col).select("*", F.monotonically_increasing_id().alias("id")), "lines", **plain)
    name = F.struct(*LINE, "id")
    kinds = keep(lines.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"), "kinds")
    equal = keep(lines.select("h1", "h2", name.alias("line")).join(joinable(kinds, 500_000), ["h1", "h2"], "left_semi"), "equal")
    heads = keep(equal.groupBy("h1", "h2").agg(F.min("line").alias("head")), "heads")
    repeated = keep(equal.join(joinable(heads, 200_000), ["h1", "h2"]).where("line.id <> head.id").select("line.*", F.expr("line.doc <=> head.doc and line.no = head.no and line.of <=> head.of").alias("same")), "repeated")
    heads = keep(prefixes(lines, percent).join(joinable(repeated.select("id")), "id", "left_anti"), "heads", **plain)

    near = _matched(_pivot_pairs(heads, percent), lines, percent)
    done = near.select("id", F.lit(True).alias("done"))
    marked = heads.join(joinable(done), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    rounds = [keep(_pairs(marked, long, part, ROUNDS, percent), "pairs") for long in (False, True) for part in range(ROUNDS)]
    discard(heads)
    more = _matched(reduce(DataFrame.union, rounds).distinct(), lines, percent, done)
    return repeated.where("not same").select(*LINE).union(near.select(*LINE)).union(more.select(*LINE)).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, removed, text_hash): the numbers of the lines to remove of each document that has such lines, in order, and the hash of its text."""
    found = later_matches(docs, id_col, text_col, percent)
    return found.groupBy(F.col("doc").alias(id_col), F.col("of").alias("text_hash")).agg(F.sort_array(F.collect_list("no")).alias("removed")).select(id_col, "removed", "text_hash")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the same rows and columns, without the lines that an earlier line of any document matches.

    A line's tokens are its distinct words, lower-cased, as runs of characters
    other than white space of ASCII; they are compared by 64 bits of their hash.
    Blank lines stay, a null text stays null, and a text may end up empty; rows
    that repeat both id and text count as one document, rows of one id with
    other texts are documents of their own; a null id comes first and such a row
    keeps its lines; other columns are handed on, whatever their names; no rows
    give no rows.
    """
    of, gone, hashed = (unused(docs.columns, x) for x in ("of", "removed", "text_hash"))
    removed = removed_lines(docs, id_col, text_col, percent).select(F.col(id_col).alias(of), F.col("removed").alias(gone), F.col("text_hash").alias(hashed))
    joined = docs.join(joinable(keep(removed, "removed"), 500_000), (docs[id_col] == F.col(of)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(hashed)), "left")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), docs[text_col]).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
