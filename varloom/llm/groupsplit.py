"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.support import small, stored

# Words that may stand in front of a name and are no part of it.
LEADING_WORDS = "gene|genes|symbol|locus"

#: Separators between several names in one field.
SEPARATORS = ",;|/"

#: Groups are assigned in at most twice so many cells: each group that holds
#: more than one in CELLS of all rows is a cell, the rest share CELLS by hash.
CELLS = 2000

#: The most frequent labels that are balanced each on its own; the others share as many values by hash.
LABELS = 64

#: Propagation steps between two tables of labels.
STEPS = 2


def names_in(cell: Column) -> Column:
    """The names in one field, each in capital letters and digits only, blanks left out."""

    def name(part: Column) -> Column:
        bare = F.regexp_replace(part, rf"(?i)^[^\p{{L}}\p{{N}}]*({LEADING_WORDS})(?![\p{{L}}\p{{N}}])", "")
        return F.upper(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", ""))

    return F.filter(F.transform(F.split(cell, f"[{SEPARATORS}]"), name), lambda n: n != "")


def name_table(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, symbol): every approved symbol and other name in canonical form.

    An approved symbol wins over another gene's other name that reads alike.
    """
    canonical = lambda c: F.upper(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", ""))
    approved = symbols.filter("name2 IS NOT NULL").select(canonical("name2").alias("name"), F.col("name2").alias("symbol")).distinct()
    other = aliases.filter("other_name IS NOT NULL AND gene_symbol IS NOT NULL").select(canonical("other_name").alias("name"), F.col("gene_symbol").alias("symbol")).distinct()
    known = other.join(approved.select(F.col("symbol")).distinct(), "symbol", "left_semi").select("name", "symbol")
    return approved.unionByName(known.join(approved.select("name").distinct(), "name", "left_anti"))


def record_sets(records: DataFrame, record_id: str, cell: str) -> DataFrame:
    """(record, cell, names, link): each record with the distinct names in its field and a number of that set of names.

    Records of equal names share a link, so that a hot entity has one link for
    each set it occurs in, however many records there are. `link` is null
    without a name.
    """
    rows = records.select(F.col(f"`{record_id}`").alias("record"), F.col(f"`{cell}`").cast("string").alias("cell"))
    named = rows.select("record", "cell", F.coalesce(F.array_sort(F.array_distinct(names_in(F.col("cell")))), F.array().cast("array<string>")).alias("names"))
    return named.select("record", "cell", "names", F.when(F.size("names") > 0, F.xxhash64("names")).alias("link"))


def entity_graph(sets: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(link, entity, symbol, component): the bipartite graph of links and entities, labelled by its components.

    `sets` is (link, names) of record_sets. An entity is an approved symbol, or
    `?` and the name where no table knows it (symbol null). A name of several
    genes stands for each of them, so it ties them. Labels come from
    minimum-label propagation; an entity that no link joins with another is its
    own component and needs no round.
    """
    distinct = sets.filter("link IS NOT NULL").select("link", "names").distinct()
    edges = distinct.select("link", F.explode("names").alias("name")).join(small(name_table(symbols, aliases)), "name", "left")
    entity = F.coalesce("symbol", F.concat(F.lit("?"), F.col("name")))
    edges = stored(edges.select("link", entity.alias("entity"), "symbol").distinct())
    joins = edges.groupBy("link").agg(F.count("*").alias("n")).filter("n > 1").select("link")
    labels = components(edges.join(joins, "link", "left_semi").select(F.col("link").alias("record"), "entity"))
    return edges.join(small(labels, keep=False), "entity", "left").select("link", "entity", "symbol", F.coalesce("component", "entity").alias("component"))


def rewritten_names(sets: DataFrame, graph: DataFrame, symbols: DataFrame) -> DataFrame:
    """(record, symbol, component) of the graph's edges whose field as written is no approved symbol yet names one.

    Defined results: one row per record and gene, however often it is named;
    null, blank and unknown names give none.
    """
    edges = small(graph.filter("symbol IS NOT NULL").select("link", "symbol", "component"))
    exact = small(symbols.filter("name2 IS NOT NULL").select(F.col("name2").alias("cell")).distinct())
    return sets.filter("link IS NOT NULL").join(exact, "cell", "left_anti").join(edges, "link").select("record", "symbol", "component")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(entity, component) by minimum-label propagation over (record, entity) edges.

    Each step gives every record the smallest label of its entities and every
    entity the smallest label of its records, then lets a label point to its
    own label, so that long chains close in a logarithmic number of rounds.
    Rounds of STEPS steps end when no label changed; each round's labels go to
    the shared folder. Callers pass one record for each distinct set of
    entities, so hot entities have shrunk before the first shuffle.
    """
    edges = stored(edges.distinct())
    labels = stored(edges.select("entity", F.col("entity").alias("component")).distinct())
    if edges.isEmpty():
        return labels
    for _ in range(max_rounds):
        old = now = labels
        for _ in range(STEPS):
            of_record = edges.join(now, "entity").groupBy("record").agg(F.min("component").alias("low"))
            of_entity = edges.join(of_record, "record").groupBy("entity").agg(F.min("low").alias("low"))
            stepped = now.join(of_entity, "entity", "left").select("entity", F.least("component", "low").alias("component"))
            onward = now.select(F.col("entity").alias("component"), F.col("component").alias("next"))
            now = stepped.join(onward, "component", "left").select("entity", F.least("component", "next").alias("component"))
        new = stored(now.join(old.select("entity", F.col("component").alias("old")), "entity"))
        labels = new.select("entity", "component")
        if new.filter("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")


def record_groups(sets: DataFrame, graph: DataFrame) -> DataFrame:
    """(record, group): the component of every record; one without a name is a group of its own."""
    of_link = small(graph.groupBy("link").agg(F.min("component").alias("component")))
    own = F.concat(F.lit("#"), F.col("record").cast("string"))
    return sets.join(of_link, "link", "left").select("record", F.coalesce("component", own).alias("group"))


def balance(cells: list[tuple[int, int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Cells (cell, label, rows) to splits, largest first, each where the label counts stay nearest to their shares.

    The cost of a split is the chi-square distance between its label counts and
    its share of each label. Shares need not add up to 1; ties go to the split
    that comes first by name.
    """
    names = sorted(n for n, s in shares.items() if s and s > 0)
    if not cells or not names:
        return {}
    total = sum(shares[n] for n in names)
    ids, labels = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    counts = np.zeros((len(ids), len(labels)))
    at, of = {c: i for i, c in enumerate(ids)}, {x: i for i, x in enumerate(labels)}
    for cell, label, n in cells:
        counts[at[cell], of[label]] += n
    target = np.outer([shares[n] / total for n in names], counts.sum(axis=0))
    filled, out = np.zeros_like(target), {}
    for i in np.argsort(-counts.sum(axis=1), kind="stable"):
        c = counts[i]
        cost = ((2 * (filled - target) * c + c * c) / target).sum(axis=1)
        best = int(np.argmin(cost))
        filled[best] += c
        out[ids[i]] = names[best]
    return out


def pooled(label: Column, frequent: list[str]) -> Column:
    """The label itself if it is one of the frequent ones, else one of LABELS shared values."""
    shared = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(label), F.lit(LABELS)).cast("string"))
    return F.when(label.isin(frequent), label).otherwise(shared) if frequent else shared


def group_split(groups: DataFrame, labels: DataFrame, shares: DataFrame, cells: int = CELLS) -> DataFrame:
    """(record, group, split_name): every record of `groups` (record, group), all of one group in one split.

    Groups are balanced over `labels` (record, label), null being a value like
    any other: the LABELS most frequent labels each on its own, rarer ones
    pooled by hash. Each group that holds more than one in `cells` of all rows
    is a cell of its own, the others share `cells` cells by hash, so what
    reaches the driver is a bounded number of counts, never groups or links. An
    empty table gives no rows.
    """
    spark = groups.sparkSession
    named = labels.select("record", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    sizes = stored(groups.join(named, "record").groupBy("group", "label").agg(F.count("*").alias("n")))
    frequent = [r.label for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()]
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.groupBy("group").agg(F.sum("n").alias("n")).filter(F.col("n") * cells > total).select("group")
    numbered = spark.createDataFrame([(r.group, cells + i) for i, r in enumerate(large.orderBy("group").collect())], "group string, own int")
    in_cell = F.coalesce("own", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int"))
    of_cell = sizes.join(F.broadcast(numbered), "group", "left").groupBy(in_cell.alias("cell"), pooled(F.col("label"), frequent).alias("label")).agg(F.sum("n").alias("n"))
    split = balance([tuple(r) for r in of_cell.select("cell", "label", "n").orderBy("cell", "label").collect()], {r.split_name: r.target_share for r in shares.select("split_name", "target_share").collect()})
    placed = F.broadcast(spark.createDataFrame(sorted(split.items()), "cell int, split_name string"))
    return groups.join(F.broadcast(numbered), "group", "left").select("record", "group", in_cell.alias("cell")).join(placed, "cell").select("record", "group", "split_name")


def related_split(
    records: DataFrame, record_id: str, cell: str, label: str, symbols: DataFrame, aliases: DataFrame, shares: DataFrame, cells: int = CELLS
) -> DataFrame:
    """(record, group, split_name): every record, all records tied by an entity, directly or through others, in one split.

    A name that no table knows still ties the records that bear it. A record
    without any name is a group of its own.
    """
    sets = record_sets(records, record_id, cell)
    groups = record_groups(sets, entity_graph(sets, symbols, aliases))
    labels = records.select(F.col(f"`{record_id}`").alias("record"), F.col(f"`{label}`").alias("label"))
    return group_split(groups, labels, shares, cells)
