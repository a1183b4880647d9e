"""Operator 2: mixing sources to target weights by raking (native).

Documents fall into cells by source, language and topic. The budget is the largest
number of tokens at which every category still holds its target share, within ``LEAST``
and ``MOST`` of all tokens. If even the least budget asks more of a category than it
holds, that category gives all it has and the others share the rest by their targets.
Iterative proportional fitting with capacities then rakes the cells' token counts until
each margin has its share of the budget: no cell gives more than it holds, and what a
short cell lacks is refitted over the other cells of its categories.

A cell's probability is its raked share of the budget over its tokens. It is then
calibrated: documents have a uniform number that depends on the doc_id alone, and a
cell keeps those below a cutoff, one of ``BINS`` limits, chosen by the tokens that
these documents really have. So a cell misses its share of the budget by less than
one bin's tokens, and margins by less, since neighbouring cells are rounded together.

Targets name the categories, so cells are bounded by the parameters: at most the
product of the numbers of named categories plus one each, whatever the data. What
no target names is the category ``*`` and keeps its natural share. That bound is
why the raking runs on one task and its result is broadcast; bins are summed cell by
cell in the tasks that read the documents.

Defined results: null texts have no tokens and null categories are ``*``; a
document without tokens is sampled like its cell; equal doc_ids are sampled
alike, null ones as ''; an empty table gives an empty result; a target category
without documents leaves its share to the others. The caller's columns travel in one
struct, so columns of any name pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import Stage, documents

OTHER = "*"
ROUNDS, SEED = 30, "mix-1"
#: Limits of a cell's cutoff.
BINS = 1024
#: How far a margin may be off its target after ROUNDS, and how often they are tried.
CLOSE, BLOCKS = 1e-4, 5
#: The least and the greatest share of all tokens that are sampled.
LEAST, MOST = 0.1, 0.7
#: How much more than it holds a cell may be asked for; keeps the factors finite.
ASKED = 1e6
MARGINS = ("source_cat", "lang_cat", "topic_cat")
#: The order in which cells are rounded.
ROUNDING = ("topic_cat", "lang_cat", "source_cat")

#: Production parameters: what share of the sampled tokens each category should have.
TARGETS = {
    "source_cat": {f"src{i}": 1.0 for i in range(20)},
    "lang_cat": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15},
    "topic_cat": {"licence": 0.05, "credentials": 0.05, "contact": 0.05, "table": 0.05, "prose": 0.80},
}
#: Topics by the first list of which a lower-cased text contains a term.
TOPICS = {
    "licence": ("licensed under", "license", "copyright", "all rights reserved"),
    "credentials": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "contact": ("@", "http://", "https://"),
    "table": (" | ",),
}


def topic(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda rest, x: F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in x[1]]), x[0]).otherwise(rest), reversed(TOPICS.items()), F.lit("prose"))


def n_tokens(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def categories(source: Column, lang: Column, topics: Column, targets: dict = TARGETS) -> list[Column]:
    """The columns of MARGINS; what no target names is OTHER."""
    return [F.when(c.isin(list(targets[m])), c).otherwise(OTHER).alias(m) for m, c in zip(MARGINS, (source, lang, topics), strict=True)]


def margin_targets(cells: DataFrame, m: str, targets: dict = TARGETS) -> DataFrame:
    """(m, held, wish): the share of all tokens that each category holds, and the one it
    should have. Named categories that are there divide what OTHER leaves."""
    every = Window.partitionBy()
    own = cells.groupBy(m).agg(F.sum("tokens").alias("own")).repartition(1)
    held = F.coalesce(F.col("own") / F.nullif(F.sum("own").over(every), F.lit(0)), F.lit(0.0))
    weight = reduce(lambda rest, x: F.when(F.col(m) == x[0], F.lit(float(x[1]))).otherwise(rest), targets[m].items(), F.lit(0.0))
    out = own.select(m, held.alias("held"), weight.alias("weight"))
    out = out.withColumn("weight", F.when(F.col("held") > 0, F.col("weight")).otherwise(0.0))
    left = 1 - F.sum(F.when(F.col(m) == OTHER, F.col("held")).otherwise(0.0)).over(every)
    wish = F.when(F.col(m) == OTHER, F.col("held")).otherwise(F.coalesce(F.col("weight") / F.nullif(F.sum("weight").over(every), F.lit(0.0)) * left, F.lit(0.0)))
    return out.select(m, "held", wish.alias("wish"))


def budget(margins: dict[str, DataFrame], least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row with budget, a share of all tokens: the greatest at which no category is
    asked for more than it holds, within least and most."""
    each = reduce(DataFrame.unionByName, [m.where("wish > 0").select((F.col("held") / F.col("wish")).alias("most")) for m in margins.values()])
    return each.agg(F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(F.min("most"), F.lit(most)))).alias("budget"))


def capped_targets(margin: DataFrame, m: str) -> DataFrame:
    """(m, ``_t_`` m) of (m, held, wish, budget): the wishes, of which those above what a
    category holds of the budget are cut to that and the rest is shared by the others."""
    cap = F.col("held") / F.col("budget")
    out = margin.repartition(1).select(m, cap.alias("cap"), "wish", (cap / F.nullif("wish", F.lit(0.0))).alias("ratio"))
    by = Window.orderBy(F.asc_nulls_last("ratio"), m)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rate = (1 - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.nullif(F.sum("wish").over(after), F.lit(0.0))
    out = out.withColumn("rate", rate)
    # The first category that its rate leaves below its capacity sets the rate of all after it.
    fits = F.when(F.col("rate") * F.col("wish") <= F.col("cap"), F.col("rate"))
    out = out.withColumn("final", F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    goal = F.when(F.col("wish") <= 0, 0.0).when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("wish")))
    return out.select(m, goal.alias(f"_t_{m}"))


def targeted(cells: DataFrame, stage: Stage, targets: dict = TARGETS, least: float = LEAST, most: float = MOST) -> DataFrame:
    """cells (MARGINS, tokens) with budget, cap (the most that a cell can be of it), asked
    (its natural share) and a target for each margin."""
    margins = {m: stage.save(margin_targets(cells, m, targets), f"margin-{m}") for m in MARGINS}
    spent = stage.save(budget(margins, least, most), "budget")
    every = Window.partitionBy()
    share = F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0))
    out = cells.repartition(1).withColumn("asked", share).crossJoin(F.broadcast(spent)).withColumn("cap", F.col("asked") / F.col("budget"))
    for m, margin in margins.items():
        out = out.join(F.broadcast(capped_targets(margin.crossJoin(F.broadcast(spent)), m)), m)
    return out


def rounds(cells: DataFrame, n: int = ROUNDS) -> DataFrame:
    """cells after n rounds over the margins: what a cell is asked for grows or falls by
    its category's factor, what it gives is at most its cap.

    The cells, bounded by the targets, are one array, so a round is no shuffle and no
    sort but one expression.
    """
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def step(asked: Column, m: str) -> Column:
        given = F.zip_with("cells", asked, lambda c, x: F.struct(c[m].alias("k"), x.alias("x"), F.least(x, c["cap"]).alias("g"), c["cap"].alias("cap"), c[f"_t_{m}"].alias("t")))
        total = lambda rows, k: F.aggregate(F.filter(rows, lambda r: r["k"] == k), F.lit(0.0), lambda acc, r: acc + r["g"])
        totals = lambda rows: F.map_from_entries(F.transform(F.array_distinct(F.transform(rows, lambda r: r["k"])), lambda k: F.struct(k, total(rows, k))))
        moved = lambda r, by: F.when(by[r["k"]] > 0, F.least(r["x"] * r["t"] / by[r["k"]], r["cap"] * ASKED)).otherwise(0.0)
        return once(given, lambda rows: once(totals(rows), lambda by: F.transform(rows, lambda r: moved(r, by))))

    one = cells.agg(F.array_sort(F.collect_list(F.struct(*MARGINS, *[c for c in cells.columns if c not in MARGINS]))).alias("cells"))
    first = F.transform("cells", lambda c: c["asked"])
    last = F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, lambda acc, _: reduce(step, MARGINS, acc))
    out = one.select(F.explode(F.zip_with("cells", last, lambda c, x: F.struct(c.alias("c"), x.alias("asked")))).alias("x"))
    return out.select(*[F.col("x.asked") if c == "asked" else F.col(f"x.c.{c}") for c in cells.columns])


def off_target(cells: DataFrame) -> float:
    """How far the worst margin of raked cells is off its target."""
    off = lambda m: cells.groupBy(m).agg(F.abs(F.sum(F.least("asked", "cap")) - F.max(f"_t_{m}")).alias("off")).select("off")
    found = reduce(DataFrame.unionByName, map(off, MARGINS)).agg(F.max("off").alias("off")).first()
    return found["off"] or 0.0


def raked(cells: DataFrame, stage: Stage, targets: dict = TARGETS, least: float = LEAST, most: float = MOST) -> DataFrame:
    """cells with raked, their share of the budget, and probability. ROUNDS are run until
    every margin is CLOSE to its target, BLOCKS times at most: targets of which no
    combination of the cells holds all are met as nearly as raking gets."""
    out = stage.save(targeted(cells, stage, targets, least, most), "raked-0")
    for block in range(1, BLOCKS + 1):
        out = stage.save(rounds(out), f"raked-{block}")
        if off_target(out) <= CLOSE:
            break
    given = F.least("asked", "cap")
    probability = F.least(F.lit(1.0), F.coalesce(given / F.nullif("cap", F.lit(0.0)), F.lit(0.0)))
    return out.select(*MARGINS, "tokens", given.alias("raked"), probability.alias("probability"))


def calibrated(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """cells with cutoff, of bins (MARGINS, bin, tokens): the leading bins that hold at
    most probability * tokens, as a share of BINS, and in some cells one bin more.

    What the next bin would have to give is a cell's fraction; going through the cells
    by topic, language and source, one bin more is taken where the running sum of the
    fractions passes a half. So what neighbouring cells lack and have too much cancels.
    """
    by = Window.partitionBy(*MARGINS).orderBy("bin")
    goal = F.col("probability") * F.col("tokens")
    told = bins.withColumn("upto", F.sum("tokens").over(by)).drop("tokens").join(F.broadcast(cells), list(MARGINS)).withColumn("fits", F.col("upto") <= goal)
    inside, after = (lambda c: F.when(F.col("fits"), F.col(c))), (lambda c: F.when(~F.col("fits"), F.col(c)))
    ends = told.groupBy(*MARGINS).agg(F.coalesce(F.max(inside("bin")) + 1, F.lit(0)).alias("low"), F.coalesce(F.max(inside("upto")), F.lit(0)).alias("held"), F.min(after("bin")).alias("next"), F.min(after("upto")).alias("over"))
    out = cells.join(ends, list(MARGINS)).withColumn("fraction", F.coalesce((goal - F.col("held")) / (F.col("over") - F.col("held")), F.lit(0.0)))
    sofar = F.sum("fraction").over(Window.orderBy(*ROUNDING).rowsBetween(Window.unboundedPreceding, 0))
    out = out.repartition(1).withColumn("sofar", sofar)
    more = F.floor(F.col("sofar") + 0.5) > F.floor(F.col("sofar") - F.col("fraction") + 0.5)
    cutoff = F.when(F.col("next").isNull(), 1.0).when(more, (F.col("next") + 1) / BINS).otherwise(F.col("low") / BINS)
    return out.select(*MARGINS, "tokens", "raked", "probability", cutoff.alias("cutoff"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the doc_id alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text", doc_id: str = "doc_id", targets: dict = TARGETS, least: float = LEAST, most: float = MOST, carry: bool = True) -> DataFrame:
    """Per row of docs: doc (all its columns as a struct, or doc_id alone), n_tokens,
    MARGINS, raked, probability, cutoff, kept."""
    whole = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*(docs.columns if carry else [doc_id])).alias("doc")
    known = docs.select(row, uniform(F.col(doc_id)).alias("u"), n_tokens(whole).alias("n_tokens"), *categories(F.col(source), F.col(lang), topic(whole), targets))
    stage = Stage(docs.sparkSession, "mixing")
    narrow = known if carry else stage.save(known, "known")
    bins = narrow.groupBy(*MARGINS, F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("n_tokens").alias("tokens"))
    bins = stage.save(bins, "bins")
    cells = bins.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    table = stage.save(calibrated(raked(cells, stage, targets, least, most), bins), "cells")
    out = narrow.join(F.broadcast(table.drop("tokens")), list(MARGINS))
    return out.select("doc", "n_tokens", *MARGINS, "raked", "probability", "cutoff", (F.col("u") < F.col("cutoff")).alias("kept"))


def sampled(docs: DataFrame) -> DataFrame:
    """A sample by the targets; all columns stay (pipeline stage)."""
    return mixed(docs).where("kept").select("doc.*")


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their cell, raked share, probability and fate."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    found = mixed(docs, carry=False)
    return found.select("doc.doc_id", "n_tokens", *MARGINS, F.round("raked", 9).alias("raked"), F.round("probability", 9).alias("probability"), "cutoff", "kept")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    any_of = lambda terms: " or ".join(f"contains(lower(t), {quoted(x)})" for x in terms)
    topics = " ".join(f"when {any_of(terms)} then '{name}'" for name, terms in TOPICS.items())
    cat = lambda c, m: f"case when {c} in ({', '.join(map(quoted, TARGETS[m]))}) then {c} else '{OTHER}' end as {m}"
    weight = lambda m: "case " + " ".join(f"when {m} = {quoted(k)} then {float(v)}" for k, v in TARGETS[m].items()) + " else 0.0 end"
    goals = ",\n".join(
        f"""h_{m} as (select {m}, sum(tokens) / nullif(sum(sum(tokens)) over (), 0) as held, {weight(m)} as weight from n group by {m}),
w_{m} as (select {m}, held, case when {m} = '{OTHER}' then held else coalesce(weight / nullif(sum(weight) over (), 0.0) * (1 - coalesce(sum(held) filter ({m} = '{OTHER}') over (), 0)), 0.0) end as wish
  from (select * replace (case when held > 0 then weight else 0.0 end as weight) from h_{m}))"""
        for m in MARGINS
    )
    capped = ",\n".join(
        f"""c_{m} as (select {m}, held / budget as cap, wish, held / budget / nullif(wish, 0.0) as ratio from w_{m}, bu),
r_{m} as (select *, (1 - coalesce(sum(cap) over (order by ratio nulls last, {m} rows between unbounded preceding and 1 preceding), 0.0)) / nullif(sum(wish) over (order by ratio nulls last, {m} rows between current row and unbounded following), 0.0) as rate from c_{m}),
f_{m} as (select *, first_value(case when rate * wish <= cap then rate end ignore nulls) over (order by ratio nulls last, {m} rows between unbounded preceding and current row) as final from r_{m}),
t_{m} as (select {m}, case when wish <= 0 then 0.0 when final is null then cap else least(cap, final * wish) end as t_{m} from f_{m})"""
        for m in MARGINS
    )
    most = " union all ".join(f"select held / wish as most from w_{m} where wish > 0" for m in MARGINS)
    step = "select * from it"
    for m in MARGINS:
        step = f"select * replace (case when sum(least(asked, cap)) over (partition by {m}) > 0 then least(asked * t_{m} / sum(least(asked, cap)) over (partition by {m}), cap * {ASKED}) else 0.0 end as asked) from ({step})"
    keys = ", ".join(MARGINS)
    return f"""
with recursive d as (select doc_id, source, lang, coalesce(text, '') as t from documents),
k as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{SEED}'), 1, 8))::bigint / 4294967296.0::double as u, len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as n_tokens,
  {cat("source", "source_cat")}, {cat("lang", "lang_cat")}, case {topics} else 'prose' end as topic_cat from d),
n as (select {keys}, sum(n_tokens)::bigint as tokens from k group by all),
{goals},
bu as (select least({MOST}, greatest({LEAST}, coalesce(min(most), {MOST}))) as budget from ({most})),
{capped},
it as (
  select 0 as i, {keys}, tokens, tokens / nullif(sum(tokens) over (), 0) as asked, tokens / nullif(sum(tokens) over (), 0) / budget as cap, {", ".join(f"t_{m}" for m in MARGINS)} from n {" ".join(f"join t_{m} using ({m})" for m in MARGINS)}, bu
  union all select * replace (i + 1 as i) from ({step}) where i < {ROUNDS}),
p as (select {keys}, tokens, least(asked, cap) as raked, least(1.0, coalesce(least(asked, cap) / nullif(cap, 0.0), 0.0)) as probability from it where i = {ROUNDS}),
b as (select {keys}, floor(u * {BINS})::bigint as bin, sum(n_tokens)::bigint as own from k group by all),
o as (select {keys}, bin, sum(own) over (partition by {keys} order by bin) as upto, probability * tokens as goal from b join p using ({keys})),
e as (select {keys}, goal, coalesce(max(bin) filter (upto <= goal) + 1, 0) as low, coalesce(max(upto) filter (upto <= goal), 0) as held, min(bin) filter (upto > goal) as nxt, min(upto) filter (upto > goal) as over from o group by {keys}, goal),
f as (select *, coalesce((goal - held) / (over - held), 0.0)::double as fraction from e),
h as (select *, sum(fraction) over (order by {", ".join(ROUNDING)} rows between unbounded preceding and current row) as sofar from f),
q as (select {keys}, (case when nxt is null then 1.0 when floor(sofar + 0.5) > floor(sofar - fraction + 0.5) then (nxt + 1) / {BINS} else low / {BINS} end)::double as cutoff from h)
select doc_id, n_tokens, {keys}, round(raked, 9) as raked, round(probability, 9) as probability, cutoff, u < cutoff as kept
from k join p using ({keys}) join q using ({keys})
"""


SQL = _sql()
