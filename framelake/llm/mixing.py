"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes. DataFrame functions only.

Documents form a tree: domain, language, source. A token budget is passed down level by level. Children of a
node share its budget in proportion to their weights, but none gets more than its subtree can supply
(``max_epochs`` times its tokens); what a child can't use goes to its siblings first. Only if all children of a
node together fall short does the rest go to the node's own siblings, as a subtree's supply limits its share.

A leaf with quota Q and T tokens gets Q // T whole epochs and, of the next epoch, the longest prefix with at
most Q % T tokens. An epoch's order is that of md5(seed:epoch:doc_id). The prefix is found without sorting a
leaf: token sums of the key ranges of ``DIGITS`` digits give the one range that the prefix ends in, whose
ranges of ``DIGITS`` digits more are summed next, until no leaf has more than ``FEW`` rows in its range; only those are
ordered. So a leaf is described by its epochs and the last key taken, and each document is decided on its
own: the text is read once more and never shuffled.

Defined cases: null domain, language or source counts as the name ''; null and empty texts have no tokens and
are taken with a prefix that passes them; rows with equal keys (repeated or null ids) are taken together or
not at all; names without a weight get ``other``; a weight of 0 takes nothing; an empty table gives no rows;
extra columns are returned as they are, but ones named like the columns added here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, stored, text_of

#: Hexadecimal digits by which a key range is divided: 256 ranges of a leaf a round; rows of one that are ordered.
DIGITS, FEW = 2, 512
#: Bands of ratios to a doubling, by which siblings are summed.
BANDS = 64
#: Leaves that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LEAVES = 20_000

DOMAIN_WEIGHTS = {"books": 0.3, "code": 0.2, "forum": 0.1, "web": 0.4}
LANGUAGE_WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
OTHER = 0.05
SHARE, MAX_EPOCHS, SEED = 0.6, 2, 17

LEAF = ("domain", "language", "leaf_source")
#: Columns that stand beside those of the documents for a while.
OWN = ("_framelake_leaf_epochs", "_framelake_leaf_cut")


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, with no array of them."""
    plain = F.translate(text, "\t\n\u000b\f\r", "     ")
    # Spaces that begin a word, the first aside: those whose next character is visible.
    return F.when(F.trim(plain) == "", F.lit(0)).otherwise(F.regexp_count(F.trim(plain), F.lit(" +")) + 1).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source, from its digest; stands in for a catalogue of sources."""
    d = F.substring(F.md5(source), 1, 1)
    return F.when(d < "4", "web").when(d < "8", "books").when(d < "c", "code").otherwise("forum")


def weight(name: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``share``: of the parent's ``budget`` to each node with ``weight`` > 0 and supply ``cap``.

    In ascending order of cap / weight, nodes are full as long as the level that the others would get isn't
    below that ratio; the level at the first that isn't full holds for all after it. Sums of nodes in bands of
    ratios (``BANDS`` to a doubling) give the band of that node, and sums by ratio within it the level, so no task
    holds all children of a node: a parent has a few thousand bands at most.
    """
    nodes = nodes.filter("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    nodes = nodes.withColumn("band", F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * BANDS)).otherwise(F.lit(-(1 << 20))).cast("int"))

    def sums(rows: DataFrame, key: str, *first) -> DataFrame:
        """Of each ``key``: caps before it, weights from it on, and whether its last node isn't full."""
        each = rows.groupBy(*parent, key).agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"), F.max("ratio").alias("top"), F.max("budget").alias("budget"), *first)
        order = W.partitionBy(*parent).orderBy(key)
        upto, done = F.sum("caps").over(order), F.sum("weights").over(order)
        before, rest = ("own_before", "own_rest") if first else ("before", "rest")
        each = each.withColumn(before, upto - F.col("caps") + (F.col("before") if first else 0.0))
        each = each.withColumn(rest, (F.col("rest") + F.col("weights") - done) if first else F.sum("weights").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        return each.filter(F.col(before) + F.col("caps") + F.col("top") * (F.col(rest) - F.col("weights")) > F.col("budget")).groupBy(*parent).agg(F.min(F.struct(key, before, rest, "budget")).alias("f"))

    band = sums(nodes, "band").select(*parent, "f.band", "f.before", "f.rest")
    own = nodes.join(band, [*parent, "band"])
    level = sums(own, "ratio", F.max("before").alias("before"), F.max("rest").alias("rest")).select(*parent, ((F.col("f.budget") - F.col("f.own_before")) / F.col("f.own_rest")).alias("level"))
    return nodes.join(level, parent, "left").withColumn("share", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("ratio", "band", "level")


def quotas(leaves: DataFrame, share: float, max_epochs: int, domains: dict, languages: dict, other: float) -> DataFrame:
    """``leaves`` (domain, language, leaf_source, tokens) with ``quota``, in tokens."""
    cap = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    whole = float(math.floor((leaves.agg(F.sum("tokens")).first()[0] or 0) * share))
    top = cap.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"one": F.lit(1), "budget": F.lit(whole), "weight": weight(F.col("domain"), domains, other)})
    # Each level is written, so that plans don't grow with the levels above.
    top = stored(filled(stored(top, "domains"), ["one"]).select("domain", F.col("share").alias("budget")), "domain-budgets")
    middle = cap.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(top, "domain")
    middle = filled(middle.withColumn("weight", weight(F.col("language"), languages, other)), ["domain"])
    middle = stored(middle.select("domain", "language", F.col("share").alias("budget")), "language-budgets")
    low = filled(stored(cap.join(middle, ["domain", "language"]).withColumn("weight", F.lit(1.0)), "sources"), ["domain", "language"])
    return low.select(*LEAF, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("quota"))


def key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def prefix_ends(rows: DataFrame, plan: DataFrame, near, seed: int) -> DataFrame:
    """For leaves with a rest, ``cut``: the last key of the longest prefix with at most ``rest`` tokens, or the
    start of the range after it. Leaves whose rest takes all have none."""
    keyed = rows.join(near(plan.filter("rest > 0").select(*LEAF, "epochs", "rest")), [*LEAF])
    keyed = keyed.select(*LEAF, "n_tokens", "rest", key(F.col("epochs") + 1, F.col("doc_id"), seed).alias("key"))
    own, digits, before = keyed.withColumn("before", F.lit(0).cast("long")), 0, None
    while True:
        digits += DIGITS
        sums = own.groupBy(*LEAF, F.substring("key", 1, digits).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        running = sums.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEAF).orderBy("bucket")))
        over = running.filter("upto > rest and upto - n <= rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "rows")).alias("e"))
        ends = stored(over.select(*LEAF, "e.*"), "ends")
        most = ends.agg(F.max("rows")).first()[0] or 0
        own = keyed.join(near(ends.select(*LEAF, "bucket", "before")), [*LEAF]).filter(F.col("key").startswith(F.col("bucket")))
        if before is not None:
            forget(before)
        if most <= FEW or digits >= 32:  # 32 digits are whole keys: rows of one key go together
            break
        before = ends
    total = own.groupBy(*LEAF, "bucket", "before", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    taken = total.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEAF).orderBy("key"))).filter("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("k"))
    return ends.join(taken, [*LEAF], "left").select(*LEAF, F.coalesce("k", "bucket").alias("cut"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, domains: dict = DOMAIN_WEIGHTS, languages: dict = LANGUAGE_WEIGHTS, other: float = OTHER) -> DataFrame:
    """The documents taken, with domain, language, leaf_source, n_tokens and ``copies``, the times each is
    taken. ``share`` of all tokens is the budget."""
    lang, source = F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    named = {"domain": F.coalesce(domain if domain is not None else domain_of(source), F.lit("")), "language": lang, "leaf_source": source}
    rows = stored(docs.select(*[c.alias(n) for n, c in named.items()], F.col("doc_id").cast("long").alias("doc_id"), words(text_of()).alias("n_tokens")), "token-counts")
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    # A table of so few leaves needs no shuffles.
    own = leaves.coalesce(1) if leaves.count() <= BROADCAST_LEAVES else leaves
    plan = quotas(own, share, max_epochs, domains, languages, other).filter("quota > 0")
    plan = stored(plan.select(*LEAF, F.expr("quota div tokens").alias("epochs"), (F.col("quota") % F.col("tokens")).alias("rest")), "quotas")
    small = plan.count() <= BROADCAST_LEAVES
    near = F.broadcast if small else (lambda df: df)
    ends = prefix_ends(rows, plan, near, seed)
    plan2 = stored(plan.join(ends, [*LEAF], "left").select(*LEAF, F.col("epochs").alias(OWN[0]), F.col("cut").alias(OWN[1])), "cuts")
    forget(rows, leaves, plan)
    out = docs.withColumns(named).join(near(plan2), [*LEAF])
    more = F.coalesce(key(F.col(OWN[0]) + 1, F.col("doc_id"), seed) <= F.col(OWN[1]), F.lit(False))
    out = out.withColumn("copies", (F.col(OWN[0]) + more.cast("long")).cast("long")).filter("copies > 0").drop(*OWN)
    return out.withColumn("n_tokens", words(text_of()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "n_tokens", "copies")


def oracle(share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    def weights(name: str, held: dict) -> str:
        return "case " + name + "".join(f" when '{k}' then {v}" for k, v in held.items()) + f" else {OTHER} end::double"

    def level(table: str, parent: str, name: str, keep: str) -> str:
        return f"""
    {table}_r as (select *, cap / weight as ratio from {table}),
    {table}_l as (select *, (budget - coalesce(sum(cap) over (partition by {parent} order by ratio, {name} rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (partition by {parent} order by ratio, {name} rows between current row and unbounded following) as level from {table}_r),
    {table}_f as (select *, min(case when ratio > level then {{'ratio': ratio, 'name': {name}, 'level': level}} end) over (partition by {parent}) as f from {table}_l),
    {table}_s as (select {keep}, least(cap, coalesce(weight * f.level, cap)) as share from {table}_f)"""

    return f"""with d as (
      select doc_id, coalesce(lang, '') as language, coalesce(source, '') as source,
        case when substr(md5(coalesce(source, '')), 1, 1) < '4' then 'web' when substr(md5(coalesce(source, '')), 1, 1) < '8' then 'books'
          when substr(md5(coalesce(source, '')), 1, 1) < 'c' then 'code' else 'forum' end as domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
      from documents),
    leaves as (select domain, language, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {max_epochs})::double as cap from d group by all),
    a as (select domain, 1 as one, sum(cap) as cap, {weights("domain", DOMAIN_WEIGHTS)} as weight,
        (select floor(sum(tokens) * {share}::double)::double from leaves) as budget from leaves group by domain),{level("a", "one", "domain", "domain")},
    b as (select l.domain, l.language, sum(l.cap) as cap, {weights("l.language", LANGUAGE_WEIGHTS)} as weight, any_value(s.share) as budget
        from leaves l join a_s s using (domain) group by l.domain, l.language),{level("b", "domain", "language", "domain, language")},
    c as (select l.*, 1.0::double as weight, s.share as budget from leaves l join b_s s using (domain, language)),{level("c", "domain, language", "source", "domain, language, source, tokens")},
    q as (select domain, language, source, tokens, floor(share + 1e-6)::bigint as quota from c_s where floor(share + 1e-6) > 0),
    k as (select d.*, quota // tokens as epochs, quota % tokens as rest,
        md5('{seed}:' || (quota // tokens + 1)::varchar || ':' || coalesce(doc_id::varchar, '')) as key
        from d join q using (domain, language, source)),
    r as (select *, sum(n_tokens) over (partition by domain, language, source order by key) as upto from k)
    select doc_id, domain, language, source, n_tokens, (epochs + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint as copies
    from r where epochs + case when rest > 0 and upto <= rest then 1 else 0 end > 0"""
