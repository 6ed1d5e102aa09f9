"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Weights propagate through a tree of domain, language and source. A node whose documents, over all epochs, hold
less than its share is filled up; what it lacks goes to its siblings by their weights, and only what a whole
family lacks goes on to the parent's siblings. Each leaf then takes a token prefix of seeded epochs: whole
epochs first, then the documents of one more in the order of a seeded hash.

Scaling. Budgets are solved on one row a leaf. A prefix needs no sort of its leaf: tokens are summed by the
first hex digits of the hash (map-side first), then once more inside the bucket in which the budget ends; the
sums of one leaf are at most 16**DIGITS rows a round, and only the documents of the last round's bucket, one in
16**(DIGITS * ROUNDS), are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that one round of narrowing sums by, and rounds.
DIGITS, ROUNDS = 2, 2
LEVELS = ("domain", "lang", "source")


def n_tokens(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, spaces as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def weight(level: str, weights: dict[str, float] | None) -> Column:
    """Weight of a node by its name; names that are not listed weigh 1."""
    out = F.lit(1.0)
    for name, w in sorted((weights or {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children with ``share`` of their parent's ``given``: by weight ``w``, at most ``room``, and what a full
    child leaves over goes to its siblings by weight. Children that weigh nothing get nothing."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    upward = family.orderBy("level", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = children.where("w > 0").withColumn("level", F.col("room") / F.col("w"))
    sums = some.withColumns({"rooms": F.sum("room").over(upward), "rest": F.sum("w").over(family) - F.sum("w").over(upward)})
    full = sums.withColumn("full", F.col("rooms") + F.col("level") * F.col("rest") <= F.col("given") + F.lit(1e-6))
    left = full.withColumns({"taken": F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(family), "open": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(family)})
    part = (F.col("given") - F.col("taken")) * F.col("w") / F.when(F.col("open") > 0, F.col("open")).otherwise(1.0)
    return left.withColumn("share", F.when(F.col("full"), F.col("room")).otherwise(F.least("room", part))).drop("level", "rooms", "rest", "full", "taken", "open")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``budget``, whole tokens; without those that weigh nothing."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("all"))
    # A node's room is what its leaves can take: those under a weight of zero, on whatever level, take nothing.
    open_ = F.lit(True)
    for level in LEVELS:
        open_ = open_ & (weight(level, weights.get(level)) > 0)
    room = leaves.where(open_).withColumn("room", (F.col("tokens") * max_epochs).cast("double"))
    domains = room.groupBy("domain").agg(F.sum("room").alias("room")).crossJoin(total)  # one row on the right
    given = F.least(F.floor(F.col("all") * share).cast("double"), F.sum("room").over(Window.partitionBy(F.lit(0))))
    domains = shared_out(domains.withColumns({"given": given, "w": weight("domain", weights.get("domain"))}).drop("all"), [], "domain")
    langs = room.groupBy("domain", "lang").agg(F.sum("room").alias("room")).join(domains.select("domain", F.col("share").alias("given")), "domain")
    langs = shared_out(langs.withColumn("w", weight("lang", weights.get("lang"))), ["domain"], "lang")
    last = room.join(langs.select("domain", "lang", F.col("share").alias("given")), ["domain", "lang"])
    last = shared_out(last.withColumn("w", weight("source", weights.get("source"))), ["domain", "lang"], "source")
    return last.select(*LEVELS, "tokens", F.floor(F.col("share") + F.lit(1e-6)).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float = 1.0, max_epochs: int = 4, seed: int = 1, digits: int = DIGITS, levels: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", counted: str | None = None) -> DataFrame:
    """docs, each row as often as it is drawn, with a struct ``__mix``: domain, lang, source, epoch (from 1),
    n_tokens (words) and take_tokens (less than n_tokens only where the leaf's budget ends in the document).

    share: tokens wanted over tokens there. A null lang counts as ``und``, a null source as the empty string; a
    null text holds no token. Leaves without tokens give nothing; documents without tokens are drawn where their
    place in the order is before the end of the budget. The MD5 of its text stands for a null id. Rows with equal
    ids are ordered by their tokens; equal rows are documents of their own. Other columns are carried along; empty
    table: no rows. ``counted`` names a column that holds the number of tokens, so that texts need not be read again.
    """
    leaf = F.struct(domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"))
    tokens = n_tokens(text_col) if counted is None else F.col(counted)
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    narrow = docs.select(own.alias("id"), leaf.alias("leaf"), tokens.alias("n_tokens")).select("id", "leaf.*", "n_tokens")
    narrow = saved(narrow) if counted is None else narrow
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, share, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs).cast("long"), F.expr("budget div greatest(tokens, 1)"))).otherwise(F.lit(0).cast("long"))
    plan = plan.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < max_epochs, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
    plan = saved(plan.drop("tokens", "budget").where("whole > 0 or rest > 0"))

    def order(id_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), id_))

    plan = plan.withColumns({"prefix": F.lit(""), "start": F.lit(0).cast("long")})
    for depth in range(digits, digits * levels + 1, digits):
        open_ = plan.where("rest > 0").select(*LEVELS, "whole", "rest", "prefix", "start")
        inside = narrow.join(open_, list(LEVELS)).withColumn("key", order(F.col("id"))).where(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy(*LEVELS, "rest", "start", F.substring("key", 1, depth).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
        upward = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = sums.withColumn("end", F.col("start") + F.sum("t").over(upward)).where("end >= rest")
        cuts = ends.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("end") - F.col("t")).alias("start"))).alias("cut"))
        plan = saved(plan.drop("prefix", "start").join(cuts, list(LEVELS), "left").select(*LEVELS, "whole", "rest", F.col("cut.bucket").alias("prefix"), F.col("cut.start").alias("start")))
    plan = plan.select(F.struct(*LEVELS).alias("leaf"), "whole", "rest", F.col("prefix").alias("bucket"), "start")
    digits *= levels

    named = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*named).alias("__row"), leaf.alias("leaf"), own.alias("id"), tokens.alias("n_tokens")).join(plan, "leaf").withColumn("key", order(F.col("id")))
    inside = F.coalesce(F.substring("key", 1, digits) < F.col("bucket"), F.lit(False))
    last = F.col("whole") + F.when(inside, 1).otherwise(0)
    epochs = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    surely = rows.withColumn("epoch", F.explode(epochs)).withColumn("take_tokens", F.col("n_tokens"))
    at_end = rows.where(F.substring("key", 1, digits) == F.col("bucket"))
    before = Window.partitionBy("leaf").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_end = at_end.withColumn("place", F.col("start") + F.sum("n_tokens").over(before) - F.col("n_tokens")).where("place < rest")
    at_end = at_end.withColumn("epoch", F.col("whole") + 1).withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("place")))
    cols = ["__row", "leaf", "epoch", "n_tokens", "take_tokens"]
    both = surely.select(cols).unionByName(at_end.select(cols))
    return both.select("__row.*", F.struct("leaf.*", F.col("epoch").cast("int").alias("epoch"), "n_tokens", "take_tokens").alias("__mix"))
