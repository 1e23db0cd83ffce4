"""Mixing sources to target weights by hierarchical budgets.

Leaves are paths of a tree (by default domain, language, source). The token
budget is dealt from the root: among siblings in proportion to their weights,
none above its capacity, which is the capacity of the leaves below it. What a
node cannot use goes to its siblings first, since its parent keeps its own
budget as long as its subtree can use it, and only then to relatives of the
parent. A leaf's capacity is its tokens times ``max_epochs``.

A leaf takes whole epochs of its documents, then the prefix of one more epoch
that its budget still holds, in an order that a hash of seed, epoch and doc_id
draws anew for each epoch. To find where the prefix ends, tokens are summed by
leaf and hash bucket; the one bucket in which a leaf's prefix ends is summed by
finer buckets again, and only the one of those in which it ends, a 16-millionth
of the leaf, is put in order. So a leaf with a third of all rows is never in one
task.

All quantities are integers, so results don't depend on the order of rows. A
division rounds down: at most one token a node stays unused. Only DataFrame
functions run; the leaves' table is written first, so Spark broadcasts it only
if its measured size is below its threshold, and else joins by shuffle.

Null text has no tokens and null labels count as the label ``-``. Documents
without tokens cost nothing; they follow the order like others. Rows that share
a doc_id in a leaf are taken or left together. A missing weight is 1, weight 0
excludes. All columns are kept; input columns named like an output give way to
it. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

NONE = "-"
WORDS = r"[^\x20\x09-\x0D]+"
HEX = 3  # hex digits of the hash that name a bucket


@dataclass(frozen=True)
class Parameters:
    #: Level by level, from the root: whole weights by label.
    weights: tuple[dict[str, int], ...] = field(default=({}, {}, {}))
    #: Tokens to take, as percent of all tokens.
    budget_percent: int = 60
    max_epochs: int = 3
    seed: int = 17


def wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of siblings: ``nodes`` has the parent's labels and ``budget``, and label, weight, capacity of the node.

    In order of capacity per weight, a node is filled while the share per
    weight that is left covers it; the rest share what is left by weight.
    """
    siblings = Window.partitionBy(*parent)
    in_order = siblings.orderBy(F.col("capacity") / F.col("weight"), "label")
    ranked = nodes.where("weight > 0").select(
        "*",
        F.coalesce(F.sum("capacity").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(in_order.rowsBetween(0, Window.unboundedFollowing)).alias("heavy"),
    )
    full = wide(F.col("budget") - F.col("before")) * wide(F.col("weight")) >= wide(F.col("capacity")) * wide(F.col("heavy"))
    marked = ranked.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    summed = marked.select("*", used.alias("used"), open_weight.alias("open"))
    share = F.expr("cast(budget - used as decimal(20,0)) * cast(weight as decimal(15,0)) div open")
    return summed.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("before", "heavy", "full", "used", "open")


def weight_of(label: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(label == name, weight).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: list[str], how: Parameters) -> DataFrame:
    """Budget of each leaf; ``leaves`` has the levels and ``tokens``."""
    capacity = leaves.select(*levels, (F.col("tokens") * how.max_epochs).cast("long").alias("capacity"))
    root = leaves.agg(F.expr(f"sum(cast(tokens as decimal(38,0))) * {how.budget_percent} div 100")).first()[0]  # one number
    above = None
    for depth in range(len(levels)):
        own = capacity.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        own = own.withColumns({"label": F.col(levels[depth]), "weight": weight_of(F.col(levels[depth]), how.weights[depth])})
        nodes = own.join(above, levels[:depth]) if depth else own.withColumn("budget", F.lit(int(root or 0)).cast("long"))
        above = deal(nodes, levels[:depth]).select(*levels[: depth + 1], "budget")
    return leaves.join(above, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def ending(drawn: DataFrame, names: list[str], digits: int) -> DataFrame:
    """The bucket of so many digits of ``draw`` in which each leaf's ``rest`` runs out, and what is ``left`` of it there."""
    per_bucket = drawn.groupBy(*names, F.substring("draw", 1, digits).alias("bucket"), "rest").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*names).orderBy("bucket")
    return (
        per_bucket.withColumn("to", F.sum("n").over(running))
        .where(F.col("to") > F.col("rest"))
        .groupBy(*names, "rest")
        .agg(F.min(F.struct("bucket", "to", "n")).alias("e"))
        .select(*names, F.col("e.bucket").alias("bucket"), (F.col("rest") - (F.col("e.to") - F.col("e.n"))).alias("left"))
    )


def mix(docs: DataFrame, levels: dict[str, Column], how: Parameters = Parameters()) -> DataFrame:
    """``docs`` (doc_id, text) with the level columns, ``n_tokens`` and ``epochs``, how often each row is taken."""
    names = list(levels)
    labelled = docs.withColumns({k: F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in levels.items()})
    labelled = labelled.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    narrow = materialise(labelled.select("doc_id", *names, "n_tokens"), "mix-lengths")
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    dealt = materialise(budgets(leaves, names, how).select(*names, "tokens", "budget", F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("whole")), "mix-budgets")

    def draw_of(whole: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(how.seed)), F.col(whole).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    drawn = narrow.join(dealt, names).where("tokens > 0").select(*names, "n_tokens", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"), draw_of("whole").alias("draw"))
    first = materialise(ending(drawn, names, HEX), "mix-buckets")
    inside = drawn.withColumn("bucket", F.substring("draw", 1, HEX)).drop("rest").join(first, [*names, "bucket"]).drop("bucket")
    inside = materialise(inside.withColumnRenamed("left", "rest"), "mix-inside")
    ends = materialise(ending(inside, names, 2 * HEX), "mix-ends")
    inside = inside.withColumn("bucket", F.substring("draw", 1, 2 * HEX)).join(ends, [*names, "bucket"]).groupBy(*names, "bucket", "left", "draw").agg(F.sum("n_tokens").alias("n"))
    last = inside.withColumn("to", F.sum("n").over(Window.partitionBy(*names).orderBy("draw"))).where(F.col("to") <= F.col("left")).groupBy(*names).agg(F.max("draw").alias("last"))
    # Before the end's bucket all are taken; within it, those up to the last one that fits.
    cuts = dealt.join(ends, names, "left").join(last, names, "left").select(*names, "whole", "bucket", "last", (F.col("tokens") > 0).alias("some"))
    cuts = materialise(cuts, "mix-cuts")
    whole, bucket, end, some = (fresh(c, labelled.columns) for c in ("whole", "bucket", "last", "some"))
    cuts = cuts.withColumnsRenamed({"whole": whole, "bucket": bucket, "last": end, "some": some})
    draw = draw_of(whole)
    taken = F.when(F.col(bucket).isNull(), False).when(F.substring(draw, 1, 2 * HEX) < F.col(bucket), True).otherwise(F.coalesce(draw <= F.col(end), F.lit(False)))
    epochs = F.when(F.col(some), F.col(whole) + taken.cast("long")).otherwise(F.lit(0).cast("long"))
    return labelled.join(cuts, names).select(*[labelled[c] for c in labelled.columns if c.lower() != "epochs"], epochs.alias("epochs"))


def domain_of(source: Column) -> Column:
    """Domains of the test tables: four families by the number that ends a source's name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.substring(number, -1, 1).cast("int") % 4).cast("string")))


def default_levels(docs: DataFrame) -> dict[str, Column]:
    return {"domain": domain_of(docs["source"]), "lang": docs["lang"], "source": docs["source"]}


TARGET = Parameters(weights=({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {}))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, default_levels(docs), TARGET).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def _deal_sql(name: str, parents: str, keys: str, above: str, weight: str) -> str:
    """The same water-filling for one level in DuckDB."""
    label = keys.split(", ")[-1]
    over = f"partition by {parents}" if parents else ""
    join = f"join {above} using ({parents})" if parents else f"cross join {above}"
    return f"""
{name}_n as (select {keys}, sum(capacity)::hugeint as capacity, {weight} as weight from leaves group by {keys}),
{name}_r as (select n.*, budget,
    coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0)::hugeint as before,
    sum(weight) over (w rows between current row and unbounded following)::hugeint as heavy
  from {name}_n n {join} window w as ({over} order by capacity::double / weight, {label})),
{name}_f as (select *, (budget - before) * weight >= capacity * heavy as filled from {name}_r),
{name}_s as (select *, sum(case when filled then capacity else 0 end) over ({over})::hugeint as used,
    sum(case when filled then 0 else weight end) over ({over})::hugeint as open_w from {name}_f),
{name} as (select {keys}, case when filled then capacity else (budget - used) * weight // open_w end as budget from {name}_s)"""


SQL = (
    r"""
with docs as (select doc_id, coalesce(lang, '-') as lang, coalesce(source, '-') as source,
    case when regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' then 'other'
      else 'd' || (right(source, 1)::int % 4)::varchar end as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * 3 as capacity from docs group by 1, 2, 3),
root as (select sum(tokens)::hugeint * 60 // 100 as budget from leaves),"""
    + ",".join(
        [
            _deal_sql("l1", "", "domain", "root", "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 when 'd3' then 1 else 1 end"),
            _deal_sql("l2", "domain", "domain, lang", "l1", "case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end"),
            _deal_sql("l3", "domain, lang", "domain, lang, source", "l2", "1"),
        ]
    )
    + """,
dealt as (select domain, lang, source, tokens, budget, case when tokens > 0 then budget // tokens else 0 end as whole from leaves join l3 using (domain, lang, source)),
drawn as (select d.*, whole, tokens, budget - whole * tokens as rest,
    md5('17|' || whole::varchar || '|' || coalesce(doc_id::varchar, '')) as draw from docs d join dealt using (domain, lang, source)),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by draw range between unbounded preceding and current row) as upto from drawn)
select doc_id, domain, lang, source, n_tokens,
  (case when tokens = 0 then 0 else whole + (case when upto <= rest then 1 else 0 end) end)::bigint as epochs from run
"""
)
