"""The same or nearly the same record in different splits, by a partitioned suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.support import SPACE, small, stored

#: Rows of one text on one side that a task pairs at most with rows of the other side.
PAIR_ROWS = 1000

#: Tokens of a suffix that the array keeps and compares. A longer common prefix is
#: found piece by piece, as the suffixes that begin within it share its rest.
DEPTH = 8

#: The order of the array; the first token alone settles most comparisons.
ORDER = ["key", "suffix", "text_id", "start", "is_train"]

#: Letters of an alternate that stand in a text's id as they are; a longer one stands there by its digest.
PLAIN_LETTERS = 32


def _same_start(a: Column, b: Column) -> Column:
    """How many leading characters two arrays of characters share."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.greatest(F.size(a), F.size(b))).cast("int")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def change_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., chrom, alt and pos of each row's change in its shortest form.

    Bases that ref and alt share are taken off, at the end first and then at
    the front, one always staying in each; pos moves on with the front. Only
    the first alternate counts. Rows without chrom, pos or alternate give none;
    without ref nothing is taken off.
    """
    bare = lambda c: F.upper(F.regexp_replace(F.col(c), f"{SPACE}+", ""))
    first = df.select(
        *[F.col(f"`{k}`").alias(f"k_{k}") for k in keep],
        F.regexp_replace(bare("chrom"), "^CHR", "").alias("chrom"),
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(bare("ref"), F.lit("")).alias("ref"),
        F.substring_index(bare("alt"), ",", 1).alias("alt"),
    ).filter("chrom <> '' AND pos IS NOT NULL AND alt <> ''")
    spare = lambda: F.least(F.length("ref"), F.length("alt")) - 1
    kept = [F.col(f"k_{k}") for k in keep]
    end = F.when(spare() > 0, F.least(spare(), _same_start(F.reverse(_chars(F.col("ref"))), F.reverse(_chars(F.col("alt")))))).otherwise(0)
    ended = first.select(*kept, "chrom", "pos", "ref", "alt", end.alias("n")).select(
        *kept, "chrom", "pos", F.substring("ref", F.lit(1), F.length("ref") - F.col("n")).alias("ref"), F.substring("alt", F.lit(1), F.length("alt") - F.col("n")).alias("alt")
    )
    front = F.when(spare() > 0, F.least(spare(), _same_start(_chars(F.col("ref")), _chars(F.col("alt"))))).otherwise(0)
    done = ended.select(*kept, "chrom", "pos", "alt", front.alias("n"))
    return done.select(*[F.col(f"k_{k}").alias(k) for k in keep], "chrom", F.expr("substring(alt, n + 1)").alias("alt"), (F.col("pos") + F.col("n")).alias("pos"))


def suffix_array(texts: DataFrame, min_tokens: int, depth: int = DEPTH) -> DataFrame:
    """(part, key, suffix, text_id, start, is_train, before): all suffixes of the texts, laid out in order.

    `texts` is (text_id, is_train, tokens), each distinct text once a side. A
    suffix is the hashes of up to `depth` tokens from its start on, `key` the
    first of them, `before` the hash of the token in front of it. Suffixes are laid into ranges of (suffix,
    text_id, start, side): partitions follow each other in order, and a beginning that
    many texts share spreads over as many partitions as it needs. A suffix of
    fewer than min_tokens tokens is left out.
    """
    depth = max(depth, min_tokens)
    hashed = texts.filter(F.size("tokens") >= min_tokens).select("text_id", "is_train", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t"))
    starts = hashed.select("text_id", "is_train", "t", F.explode(F.sequence(F.lit(1), F.size("t") - (min_tokens - 1))).alias("start"))
    suffixes = starts.select(F.slice("t", F.col("start"), F.lit(depth)).alias("suffix"), "text_id", "start", "is_train", F.get("t", F.col("start") - 2).alias("before"))
    return stored(suffixes.select(F.get("suffix", F.lit(0)).alias("key"), "*").repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as the rows of one matrix, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out, lengths


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading entries the rows of two matrices share, `most` at most."""
    width = min(a.shape[1], b.shape[1])
    same = (a[:, :width] == b[:, :width]) & (np.arange(width) < most[:, None])
    return np.cumprod(same, axis=1).sum(axis=1)


def _walk(entering: dict[int, dict[bool, list[int]]], min_tokens: int):
    """Goes through a partition in its order and compares each suffix with the last one of the other side.

    `entering` has, for each partition, the last suffix of each side that
    stands in front of it, so the walk goes on over the partitions' bounds.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bool, list[int]] | None = None
        for batch in batches:
            if not len(batch):
                continue
            if last is None:
                last = dict(entering.get(batch.column("part")[0].as_py(), {}))
            suffix, lengths = _padded(batch.column("suffix"))
            train = batch.column("is_train").to_numpy(zero_copy_only=False).astype(bool)
            places, lcp = np.arange(len(train)), np.zeros(len(train), np.int64)
            for side in (False, True):
                seen = np.maximum.accumulate(np.where(train == side, places, -1))
                asking = np.nonzero((train != side) & (seen >= 0))[0]
                lcp[asking] = _common(suffix[asking], suffix[seen[asking]], np.minimum(lengths[asking], lengths[seen[asking]]))
                early = np.nonzero((train != side) & (seen < 0))[0]
                if side in last and len(early):
                    known = np.tile(np.array(last[side], np.int64), (len(early), 1))
                    lcp[early] = _common(suffix[early], known, np.minimum(lengths[early], known.shape[1]))
                if seen[-1] >= 0:
                    last[side] = suffix[seen[-1], : lengths[seen[-1]]].tolist()
            hit = pa.array(lcp >= min_tokens)
            kept = batch.append_column("lcp", pa.array(lcp.astype(np.int32))).filter(hit)
            yield kept.select(["text_id", "is_train", "start", "lcp", "suffix", "before"])

    return walk


def cross_spans(texts: DataFrame, min_tokens: int, depth: int = DEPTH) -> DataFrame:
    """(text_id, is_train, start, lcp, head, before): every place of a text from which at least min_tokens tokens also stand in a text of the other side.

    In a sorted suffix array the longest prefix that a suffix shares with any of
    the other side is the one shared with the nearest of that side, above or
    below. So the array is walked once downwards and once upwards, each
    partition starting from the last suffix of either side in front of it; those,
    two a partition, are all that passes through the driver. `lcp` counts up to
    `depth` tokens, `head` is the first min_tokens of them.
    """
    array = suffix_array(texts, min_tokens, depth)
    ends = array.groupBy("part", "is_train").agg(F.min(F.struct("suffix", "text_id", "start"))["suffix"].alias("low"), F.max(F.struct("suffix", "text_id", "start"))["suffix"].alias("high")).collect()

    def before(parts: list[int], edge: str) -> dict[int, dict[bool, list[int]]]:
        out, seen = {}, {}
        for part in parts:
            out[part] = dict(seen)
            seen |= {r.is_train: r[edge] for r in ends if r.part == part}
        return out

    parts = sorted({r.part for r in ends})
    schema = f"text_id {texts.schema['text_id'].dataType.simpleString()}, is_train boolean, start int, lcp int, suffix array<long>, before long"
    down = array.sortWithinPartitions(*ORDER).mapInArrow(_walk(before(parts, "high"), min_tokens), schema)
    up = array.sortWithinPartitions(*map(F.desc, ORDER)).mapInArrow(_walk(before(parts[::-1], "low"), min_tokens), schema)
    both = down.unionByName(up).groupBy("text_id", "is_train", "start").agg(F.max("lcp").alias("lcp"), F.first("suffix").alias("suffix"), F.first("before").alias("before"))
    return stored(both.select("text_id", "is_train", "start", "lcp", F.slice("suffix", 1, min_tokens).alias("head"), "before"))


def coverage(spans: DataFrame) -> DataFrame:
    """(text_id, is_train, covered): the tokens of each text that its spans cover, counted once where they overlap."""
    sorted_spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("lcp")).alias("end"))))
    grown = F.aggregate(
        sorted_spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["covered"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("covered")),
    )
    return spans.groupBy("text_id", "is_train").agg(grown["covered"].alias("covered"))


def linked_texts(spans: DataFrame) -> DataFrame:
    """(train_text, eval_text) once for each longest stretch of tokens that two texts of different sides share.

    Texts meet where their suffixes begin with the same head. Of the places
    along one shared stretch only its first counts: there the tokens in front
    differ, or one of the texts begins.
    """
    side = lambda is_train, name: spans.filter(F.col("is_train") == is_train).select("head", F.col("text_id").alias(f"{name}_text"), F.col("before").alias(f"{name}_before"))
    first = F.col("t.train_before").isNull() | F.col("e.eval_before").isNull() | (F.col("t.train_before") != F.col("e.eval_before"))
    return side(True, "train").alias("t").join(side(False, "eval").alias("e"), "head").filter(first).select("train_text", "eval_text")


def text_of_change() -> Column:
    """What names a change: position, chromosome and alternate, parted by tabs, which none of them holds."""
    alt = F.when(F.length("alt") <= PLAIN_LETTERS, F.col("alt")).otherwise(F.concat(F.lit("#"), F.md5("alt")))
    return F.concat_ws("\t", F.col("pos").cast("string"), "chrom", alt)


def tokens_of_change(text: Column) -> Column:
    """The tokens of a change's text: the position before it, its own and the one after, on its chromosome and alternate.

    Two texts share all three tokens when the changes are the same, two tokens
    in a row when they are one position apart, and fewer otherwise.
    """
    pos = F.substring_index(text, "\t", 1).cast("long")
    rest = F.substring(text, F.instr(text, "\t"), F.length(text))
    return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.xxhash64(rest, pos + d))


#: Tokens that texts of changes one position apart share, and texts of the same change.
NEAR, SAME = 2, 3


def split_rows(df: DataFrame, also: list[str]) -> DataFrame:
    """(row_id, is_train, text, also...) of the usable rows, kept in the shared folder."""
    known = change_rows(df.filter(F.col("split_name").isin("train", "valid", "test")), ["row_id", "split_name", "source"])
    return stored(known.select("row_id", (F.col("split_name") == "train").alias("is_train"), text_of_change().alias("text"), *also))


def change_classes(rows: DataFrame) -> DataFrame:
    """(text_id, is_train, text, n): the distinct texts of each side by number, with their rows; counted before the shuffle."""
    return stored(rows.groupBy("text", "is_train").agg(F.count("*").alias("n")).withColumn("text_id", F.monotonically_increasing_id()))


def class_spans(classes: DataFrame) -> DataFrame:
    return cross_spans(classes.select("text_id", "is_train", tokens_of_change(F.col("text")).alias("tokens")), NEAR, SAME)


def linked_classes(classes: DataFrame) -> DataFrame:
    """(train_text, eval_text, n_train, n_eval): the texts of both sides that overlap, the same change or a near one."""
    links = linked_texts(class_spans(classes)).withColumnsRenamed({"train_text": "t", "eval_text": "e"})
    of = lambda is_train, key, side: classes.filter(F.col("is_train") == is_train).select(F.col("text_id").alias(key), F.col("text").alias(f"{side}_text"), F.col("n").alias(f"n_{side}"))
    return links.join(of(True, "t", "train"), "t").join(of(False, "e", "eval"), "e").drop("t", "e")


def overlapping_pairs(rows: DataFrame) -> DataFrame:
    """(train_id, eval_id) of all rows of linked texts.

    The rows of a text are dealt into lots of about PAIR_ROWS on either side,
    and every lot of one side meets every lot of the other under a key of its
    own, so no task holds a hot text whole, whichever side it is hot on.

    Defined results: rows with a null or blank chrom, pos or alt, and rows of
    another split, overlap with nothing; repeated rows give one pair each.
    """
    links = small(linked_classes(change_classes(rows)))
    lots = {s: F.greatest(F.lit(1), F.ceil(F.col(f"n_{s}") / PAIR_ROWS)).cast("int") for s in ("train", "eval")}

    def dealt(side: str, other: str) -> DataFrame:
        own = rows.filter("is_train" if side == "train" else "NOT is_train").select(F.col("row_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
        lot = F.pmod(F.xxhash64(f"{side}_id"), lots[side].cast("long")).cast("int")
        met = own.join(links, f"{side}_text")
        return met.select("train_text", "eval_text", f"{side}_id", lot.alias(f"{side}_lot"), F.explode(F.sequence(F.lit(0), lots[other] - 1)).alias(f"{other}_lot"))

    return dealt("train", "eval").join(dealt("eval", "train"), ["train_text", "eval_text", "train_lot", "eval_lot"]).select("train_id", "eval_id")


def overlap_report(rows: DataFrame) -> DataFrame:
    """Rows of each split and source, and how many overlap with the other side, the same change or a near one.

    A row overlaps by as much as the merged spans cover of its text.
    """
    classes = change_classes(rows)
    covered = coverage(class_spans(classes)).join(classes, ["text_id", "is_train"]).select("text", "is_train", "covered")
    counted = rows.groupBy("split_name", "source", "is_train", "text").agg(F.count("*").alias("n"))
    marked = counted.join(covered, ["text", "is_train"], "left")
    of = lambda tokens: F.sum(F.when(F.col("covered") == tokens, F.col("n")).otherwise(0))
    return marked.groupBy("split_name", "source").agg(F.sum("n").alias("n_rows"), of(SAME).alias("n_same"), of(NEAR).alias("n_near_only"))
