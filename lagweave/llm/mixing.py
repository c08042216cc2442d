"""Mixing sources to target weights over a domain-language-source tree (op 2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import col, staged

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and name (1 where none is given; 0 takes nothing), the budget as a share of the corpus in hundredths, and the epochs a leaf may be read."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    hundredths: int = 60
    epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number's remainder by 3 web, books or code; without a number, other."""
    number = F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.coalesce(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), number % 3 + 1), F.lit("other"))


def words_of(text: Column) -> Column:
    """Runs of characters that aren't white space, as the tokens of a document; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1).cast("long")
    for name, w in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def fill_level(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` (parents, name, weight, capacity, above: the parent's budget) with their budget.

    A child whose capacity is no more than its share by weight is filled; what it leaves goes to its
    siblings by weight. In the order of capacity to weight, filled children come first, so running
    sums tell them. The rest share by rounded running weights, so that budgets add up to the parent's
    exactly, or to all capacities if those are less.
    """
    order = [(F.col("capacity").cast("double") / F.col("weight")).asc(), F.col(name).asc()]
    by = Window.partitionBy(*parents).orderBy(*order) if parents else Window.orderBy(*order)
    before, on = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = children.filter("weight > 0")
    live = live.withColumn("left", F.col("above") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    live = live.withColumn("rest", F.sum("weight").over(on))
    live = live.withColumn("full", _wide(F.col("capacity")) * _wide(F.col("rest")) <= _wide(F.col("weight")) * _wide(F.col("left")))
    live = live.withColumn("open_left", F.max(F.when(~F.col("full"), F.struct(F.col("rest"), F.col("left")))).over(everything))
    done = F.col("open_left.rest") - F.col("rest")
    share = lambda w: F.expr("CAST(CAST({} AS DECIMAL(19,0)) * CAST(open_left.left AS DECIMAL(19,0)) AS DECIMAL(38,0)) div CAST(open_left.rest AS DECIMAL(19,0))".format(w))
    live = live.withColumn("done", done)
    live = live.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share("(done + weight)") - share("done")).cast("long"))
    return live.drop("left", "rest", "full", "open_left", "done")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens of each leaf, with its budget, whole epochs and rest (tokens of the epoch after them).

    A level's capacities are those of all leaves below, so what a node can't take goes to its
    siblings first, and to its parent's only when they are full.
    """
    known = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    for level in LEVELS:
        known = known.withColumn(f"w_{level}", _weight(level, mix))
    live = known.filter(" AND ".join(f"w_{level} > 0" for level in LEVELS))
    total = known.agg(F.expr(f"sum(tokens) * {mix.hundredths} div 100").alias("above"))
    budgets = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = live.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max(f"w_{level}").alias("weight"))
        nodes = nodes.crossJoin(F.broadcast(total)) if budgets is None else nodes.join(budgets.withColumnRenamed("budget", "above"), path[:-1])
        budgets = fill_level(nodes, path[:-1], level).select(*path, "budget")
    out = known.select(*LEVELS, "tokens").join(budgets, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))
    return out.withColumn("whole", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END")).withColumn("rest", F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END"))


MARKS = ("mix_domain", "mix_tokens", "mix_whole", "mix_part")


def mixed(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tokens: Column | None = None, columns: list[str] | None = None, marks: bool = True) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) of the documents that are taken, with mix_domain, mix_tokens, mix_whole and mix_part if ``marks``.

    A leaf's tokens are read in epochs, each in the order of a seeded hash, up to its budget:
    mix_whole epochs have all of a document, the epoch after them its first mix_part tokens. Tokens
    are words unless given. Null and empty languages and sources are one leaf each level; documents
    without tokens are never taken. Repeated rows are read one after another. Columns of the new
    names are replaced if ``marks``; no other name can clash, as a row goes through as one struct.

    Budgets come from sums by leaf. The last epoch's order is cut into 65,536 ranges of the hash: sums
    by leaf and range tell the one that holds the budget's end, and only its documents are sorted.
    """
    names = [c for c in (columns or docs.columns) if not (marks and c in MARKS)]
    blank = lambda c: F.coalesce(col(c), F.lit(""))
    named = {"domain": domain_of(col(source)), "lang": blank(lang), "source": blank(source), "tokens": words_of(col(text)) if tokens is None else tokens, "name": F.coalesce(col(doc_id).cast("string"), F.lit("")), "digest": F.md5(F.coalesce(col(text), F.lit("")).cast("binary"))}
    narrow = staged(docs.select(*(v.alias(k) for k, v in named.items())), "mix-rows")
    leaf = list(LEVELS)
    leaves = narrow.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budgets = staged(leaf_budgets(leaves, mix).select(*leaf, "whole", "rest"), "mix-leaves")
    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.col("name"), F.col("digest")).cast("binary"))
    place = lambda rows: rows.join(budgets, leaf).withColumn("key", key).withColumn("range", F.substring("key", 1, 4))
    ranges = place(narrow).filter("rest > 0").groupBy(*leaf, "range", "rest").agg(F.sum("tokens").alias("sum"))
    running = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ranges.withColumn("run", running).filter("run >= rest AND run - sum < rest").select(*leaf, F.col("range").alias("end"), (F.col("run") - F.col("sum")).alias("before"))
    ends = staged(ends, "mix-ends")
    row = F.struct(*(col(c) for c in names)) if names else F.struct(F.lit(0))
    marked = place(docs.select(row.alias("row"), *(v.alias(k) for k, v in named.items()))).join(ends, leaf, "left")
    sorted_out = F.col("range") == F.col("end")
    sure = marked.filter(~F.coalesce(sorted_out, F.lit(False))).withColumn("part", F.when(F.col("range") < F.col("end"), F.col("tokens")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy(*leaf).orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    cut = marked.filter(sorted_out).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("tokens"), F.col("rest") - start)))
    both = sure.unionByName(cut).filter("tokens > 0 AND (whole > 0 OR part > 0)")
    made = [F.col(c).alias(m) for c, m in zip(("domain", "tokens", "whole", "part"), MARKS, strict=True)] if marks else []
    return both.select(*(F.col("row").getField(c).alias(c) for c in names), *made)


def mix_table(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, n_tokens, whole_epochs, part_tokens of the documents that are taken."""
    return mixed(docs, mix, columns=["doc_id"]).select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_whole").alias("whole_epochs"), F.col("mix_part").alias("part_tokens"))
