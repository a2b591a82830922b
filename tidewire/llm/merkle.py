"""Merkle manifest of a dataset: one tree for each group (language), one tree over the groups' roots.

Leaves stand in the order of their ids, which no sort of the leaves finds: the ids of a group are
a bitmap, kept as its words of 64 bits that are not zero, with directories of popcounts over 2^16
words, over 2^36 and over all; a leaf's place is the directory's base, the popcount of the words
before its own and that of the lower bits.  Nodes are then keyed by place div 512 and stand in
slot arrays by place mod 512, so that one exchange reduces three levels of eight-fold runs.

Null ids come first, null groups too.  Rows that are equal are leaves of their own and share
their leaf; different rows of one id follow each other by leaf.  Ids must be whole numbers (a
TypeError says so).  An empty table has no leaf and gives no row.  Further columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from tidewire.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of one run, and levels that one exchange reduces.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
#: Bits of a word's number that the lower and the upper directory leave out.
LOWER, UPPER = 16, 36
#: The word of null ids, below that of any other.
NULL_WORD = -(1 << 60)
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(parts.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field with its length in bytes before it; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(group, word, bit, doc_id, leaf, altered, copies): distinct leaves and how many rows have each.

    `altered` is the leaf of the row with A-Z of its text in lower case where `tampered` holds."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    fields = {name: F.col(name) for name in FIELDS}
    of = lambda x: digest(F.concat(*(framed(x[name]) for name in FIELDS)))
    lowered = fields | {"text": F.translate("text", _UPPER_CASE, _LOWER_CASE)}
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("group"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(NULL_WORD)).alias("word"),
        F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
        doc_id.alias("doc_id"),
        of(fields).alias("leaf"),
        F.when(tampered, of(lowered)).alias("altered"),
    )
    rows = rows.withColumn("altered", F.coalesce("altered", "leaf"))
    return rows.groupBy("group", "word", "bit", "doc_id", "leaf", "altered").agg(F.count("*").alias("copies"))


def before(value: str, keys: list[str], order: str) -> Column:
    """Sum of a column over the rows before this one."""
    near = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(near), F.lit(0))


def directory(ids: DataFrame) -> DataFrame:
    """(group, word, bits, extra, base, n): a group's bitmap in words, rows before each, rows of the group.

    ids: one row for each (group, word, bit) with its number of rows; `extra` lists the bits that
    have several, which a bitmap alone would count once."""
    more = F.when(F.col("rows") > 1, F.struct("bit", (F.col("rows") - 1).alias("more")))
    words = ids.groupBy("group", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
        F.sum("rows").alias("rows"),
        F.collect_list(more).alias("extra"),
    )
    words = words.withColumn("lower", F.shiftright("word", LOWER))
    lower = words.groupBy("group", "lower").agg(F.sum("rows").alias("rows"))
    lower = lower.withColumn("upper", F.shiftright("lower", UPPER - LOWER))
    upper = lower.groupBy("group", "upper").agg(F.sum("rows").alias("rows"))
    upper = upper.withColumns({"base": before("rows", ["group"], "upper"), "n": F.sum("rows").over(W.partitionBy("group"))})
    lower = lower.join(upper.drop("rows"), ["group", "upper"])
    lower = lower.withColumn("base", F.col("base") + before("rows", ["group", "upper"], "lower"))
    words = words.join(lower.select("group", "lower", "base", "n"), ["group", "lower"])
    words = words.withColumn("base", F.col("base") + before("rows", ["group", "lower"], "word"))
    return words.select("group", "word", "bits", "extra", "base", "n")


def ranked(rows: DataFrame) -> DataFrame:
    """(group, n, place, doc_id, leaf, altered): one row for each row of the dataset, at its place in its group."""
    ids = rows.groupBy("group", "word", "bit").agg(F.sum("copies").alias("rows"), F.count("*").alias("kinds"))
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    again = F.aggregate(F.filter("extra", lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda n, e: n + e["more"])
    found = rows.join(ids.drop("rows"), ["group", "word", "bit"]).join(directory(ids), ["group", "word"])
    found = found.withColumn("place", F.col("base") + below + again).drop("bits", "extra", "base")
    # different leaves of one id: counts by a leaf's first letters, then within these, so that no task gets all of an id
    key = ["group", "word", "bit"]
    tied = found.filter("kinds > 1").withColumn("head", F.substring("leaf", 1, 4))
    heads = tied.groupBy(*key, "head").agg(F.sum("copies").alias("copies"))
    heads = heads.withColumn("skip", before("copies", key, "head")).drop("copies")
    near = W.partitionBy(*key, "head").orderBy("leaf", "altered").rowsBetween(W.unboundedPreceding, -1)
    tied = tied.join(heads, [*key, "head"])
    tied = tied.withColumn("place", F.col("place") + F.col("skip") + F.coalesce(F.sum("copies").over(near), F.lit(0)))
    every = found.filter("kinds = 1").unionByName(tied.drop("head", "skip"))
    every = every.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return every.select("group", "n", (F.col("place") + F.col("k")).alias("place"), "doc_id", "leaf", "altered")


def reduced(nodes: Column) -> Column:
    """The level above: the digest of each run of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "")))


def blocks(nodes: DataFrame, own: list[str]) -> DataFrame:
    """One row for each 512 consecutive nodes of a group: its place, slots and levels, and what remains of it.

    nodes: group, n (nodes of the group), place, hash and the columns `own`, which the slots carry."""
    slot = (F.col("place") % BLOCK).cast("int").alias("slot")
    rows = nodes.groupBy("group", "n", F.expr(f"place div {BLOCK}").alias("block"))
    made = rows.agg(F.array_sort(F.collect_list(F.struct(slot, "hash", *own))).alias("slots"))
    made = made.withColumn("level0", F.transform("slots", lambda x: x["hash"]))
    for k in range(LEVELS):
        # as long as several nodes of the group remain, runs of one node are reduced too
        up = F.when(F.col("n") > FAN**k, reduced(F.col(f"level{k}"))).otherwise(F.col(f"level{k}"))
        made = made.withColumn(f"level{k + 1}", up)
    return made.withColumn("top", F.element_at(f"level{LEVELS}", 1))


def steps_of(slot: Column) -> Column:
    """A slot's siblings to the left and right, level by level within its block."""
    steps = []
    for k in range(LEVELS):
        nodes, at = F.col(f"level{k}"), F.floor(slot / FAN**k).cast("int")
        first = at - at % FAN
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + FAN - 1 - at), "")
        steps.append(F.when(F.col("n") > FAN**k, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def climb(nodes: DataFrame, own: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(group, root) of each group, and (group, hash, *own, steps) of each node: its siblings up to the root.

    most: at least the nodes of the largest group; it sets the number of exchanges."""
    rounds, made = 1, []
    while BLOCK**rounds < most:
        rounds += 1
    for k in range(rounds):
        found = cut(blocks(nodes, own if k == 0 else []))
        made.append(found)
        n = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
        nodes = found.select("group", n.alias("n"), F.col("block").alias("place"), F.col("top").alias("hash"))
    roots = nodes.select("group", F.col("hash").alias("root"))
    above = None
    for k in reversed(range(rounds)):
        rows = made[k]
        if above is not None:
            rows = rows.join(above.select("group", F.col("place").alias("block"), F.col("steps").alias("rest")), ["group", "block"])
        else:
            rows = rows.withColumn("rest", F.lit(None).cast("array<struct<left: string, right: string>>"))
        rows = rows.withColumn("x", F.explode("slots"))
        steps = F.concat(steps_of(F.col("x.slot")), F.coalesce("rest", F.array()))
        kept = [F.col(f"x.{c}") for c in own] if k == 0 else [(F.col("block") * BLOCK + F.col("x.slot")).alias("place")]
        above = rows.select("group", "x.hash", *kept, steps.alias("steps"))
    return roots, above


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (the siblings of a leaf up to the root), folded_root, verified.

    `tampered` (of the columns of docs) says of which rows the root is recomputed from altered text."""
    placed = cut(ranked(cut(leaves(docs, F.coalesce(tampered, F.lit(False))))).withColumnRenamed("leaf", "hash"))
    most = placed.agg(F.max("n")).first()[0] or 1
    subroots, paths = climb(placed, ["doc_id", "altered"], most)
    subroots = cut(subroots)
    # one row for each group
    groups = subroots.withColumns({"n": F.count("*").over(W.partitionBy()), "place": F.row_number().over(W.orderBy("group")) - 1})
    groups = groups.select(F.lit("").alias("all"), F.col("n"), "place", F.col("root").alias("hash"), F.col("group").alias("name"))
    top, upper = climb(groups.withColumnRenamed("all", "group"), ["name"], subroots.count())
    upper = upper.join(top, "group").select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", F.col("steps").alias("rest"))
    found = paths.join(upper, "group").withColumn("steps", F.concat("steps", "rest"))
    found = found.withColumn("folded_root", folded(F.col("altered"), F.col("steps")))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "steps", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_text(steps: Column) -> Column:
    """All siblings in a row, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")

