"""Sequences by name: packed genome files, chunks, sizes and regions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.support import small, stored

# The signature of a packed file and the bases of its two-bit codes.
SIGNATURE, CODES = 0x1A412743, np.frombuffer(b"TCAG", dtype=np.uint8)

#: Bases of a chunk row, and chunks that one read takes from a file at a time.
CHUNK, READ = 1 << 16, 64

#: Tasks for each core where every chunk is gone through.
PARTS = 4

# The digit of each letter in the number of a word, 4 for what is no base.
DIGITS = np.full(256, 4, dtype=np.int64)
DIGITS[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)

# Bits of one of the three counts that are summed in one number.
FIELD = 21


def _opened(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def _numbers(file, order: str, at: int, count: int) -> tuple[int, ...]:
    file.seek(at)
    return struct.unpack(f"{order}{count}I", file.read(4 * count))


def _index(path: str) -> list[tuple]:
    """(path, name, order, length, starts, sizes, packed_at) of each sequence of a packed file; no bases are read."""
    with _opened(path) as file:
        order = "<" if _numbers(file, "<", 0, 1)[0] == SIGNATURE else ">"
        signature, version, count, _ = _numbers(file, order, 0, 4)
        if signature != SIGNATURE or version != 0:
            raise ValueError("no packed genome file")
        listed, at = [], 16
        for _ in range(count):
            file.seek(at)
            width = file.read(1)[0]
            listed.append((file.read(width).decode(), at + 1 + width))
            at += 5 + width
        out = []
        for name, where in listed:
            (offset,) = _numbers(file, order, where, 1)
            length, blocks = _numbers(file, order, offset, 2)
            unknown = _numbers(file, order, offset + 8, 2 * blocks)
            (masks,) = _numbers(file, order, offset + 8 + 8 * blocks, 1)
            out.append((path, name, length, list(unknown[:blocks]), list(unknown[blocks:]), offset + 16 + 8 * blocks + 8 * masks))
        return out


def _chunks(path: str, length: int, unknown: list, packed_at: int, first: int, last: int) -> list[str]:
    """The chunks first to last of one sequence; unknown stretches read N, masking is ignored."""
    start, end = first * CHUNK, min(length, (last + 1) * CHUNK)
    with _opened(path) as file:
        file.seek(packed_at + start // 4)
        packed = np.frombuffer(file.read((end - start + 3) // 4), dtype=np.uint8)
    bases = CODES[np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()[: end - start]].copy()
    for block in unknown:
        bases[max(0, block["start"] - start) : max(0, block["start"] + block["size"] - start)] = ord("N")
    text = bases.tobytes().decode()
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(name, chunk_id, seq) of all packed files at the path, CHUNK bases a row.

    The files' indexes are read first. Every sequence is then cut into ranges of
    READ chunks, which are spread over the tasks, and each task reads its own
    ranges from the file: no task holds a file or a sequence.
    """

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [row for p in pdf["path"] for row in _index(p)]
            yield pd.DataFrame(rows, columns=["path", "name", "length", "starts", "sizes", "packed_at"])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                seqs = _chunks(r.path, r.length, r.unknown, r.packed_at, r.first, r.last)
                yield pd.DataFrame({"name": r.name, "chunk_id": range(r.first, r.first + len(seqs)), "seq": seqs})

    files = spark.read.format("binaryFile").load(path).select("path")
    listed = files.mapInPandas(index, "path string, name string, length long, starts array<long>, sizes array<long>, packed_at long")
    ranges = listed.filter("length > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(CHUNK * READ).cast("long")))).withColumn("first", F.floor(F.col("first") / CHUNK))
    last = F.least(F.col("first") + READ - 1, F.floor((F.col("length") - 1) / CHUNK))
    inside = F.filter(F.zip_with("starts", "sizes", lambda a, b: F.struct(a.alias("start"), b.alias("size"))), lambda u: (u["start"] < (F.col("last") + 1) * CHUNK) & (u["start"] + u["size"] > F.col("first") * CHUNK))
    wanted = ranges.withColumn("last", last).select("path", "name", "length", "packed_at", "first", "last", inside.alias("unknown"))
    return wanted.repartition("path", "name", "first").mapInPandas(decode, "name string, chunk_id long, seq string")


def chunked(sequences: DataFrame, name: str, seq: str, size: int = CHUNK) -> DataFrame:
    """(name, chunk_id, seq) of whole sequences cut into chunks; empty ones give none."""
    cut = sequences.filter(F.length(seq) > 0).select(F.col(name).alias("name"), F.col(seq).alias("whole"), F.explode(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / size))).alias("chunk_id"))
    return cut.select("name", "chunk_id", F.substring("whole", (F.col("chunk_id") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("name").agg(F.sum(F.length("seq")).alias("size"))


def regions(chunks: DataFrame, wanted: DataFrame, size: int = CHUNK) -> DataFrame:
    """The wanted rows (region_id, name, start, end) with the bases of [start, end).

    Start is clamped to 0 and end to the end of the sequence's last chunk, so a
    table that holds some chunks of a sequence will do; unknown names and
    regions that are empty then give no row. Each region meets only the chunks
    it touches, in a join by name and chunk number.
    """
    ends = chunks.groupBy("name").agg(F.max(F.col("chunk_id") * size + F.length("seq")).alias("size"))
    clamped = wanted.join(ends, "name").select("region_id", "name", F.greatest(F.lit(0), F.col("start")).alias("start"), F.least("size", "end").alias("end")).filter("start < end")
    spread = clamped.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    joined = spread.join(chunks, ["name", "chunk_id"])
    low = F.greatest(F.lit(0), F.col("start") - F.col("chunk_id") * size)
    high = F.least(F.lit(size), F.col("end") - F.col("chunk_id") * size)
    part = F.substring("seq", (low + 1).cast("int"), (high - low).cast("int"))
    merged = joined.groupBy("region_id", "name", "start", "end").agg(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("part")))).alias("parts"))
    return merged.select("region_id", "name", "start", "end", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))


def windows(chunks: DataFrame, places: DataFrame, radius: int, size: int = CHUNK) -> DataFrame:
    """(chrom, pos, around): the bases from pos - radius to pos + radius, N where there are none, of each 1-based place (chrom, pos) in a chunk.

    The places of a chunk, of which there are no more than its bases, are
    gathered first, so each chunk is gone through once however many rows ask.
    Only the few bases at the edges of its neighbours are put beside it.
    """
    if radius > size:
        raise ValueError("a window must not reach beyond the neighbours of a chunk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk, seq, left, right, at in zip(*(batch.column(c).to_pylist() for c in ("chrom", "chunk_id", "seq", "left", "right")), batch.column("at")):
                letters = np.frombuffer(f"{left or '':N>{radius}}{seq}{'N' * radius if len(seq) < size else f'{right or "":N<{radius}}'}".encode(), np.uint8)
                at = at.values.to_numpy()
                at = at[at < len(seq)]
                if len(at):
                    found = letters[at[:, None] + np.arange(2 * radius + 1)].ravel()
                    texts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * (2 * radius + 1)).astype(np.int32)), pa.py_buffer(found)])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(chunk * size + at + 1, pa.int64()), texts], names=["chrom", "pos", "around"])

    at = F.collect_set((F.col("pos") - 1 - F.col("chunk_id") * size).cast("int")).alias("at")
    asked = places.filter("chrom IS NOT NULL AND pos >= 1").select("chrom", F.col("pos").cast("long").alias("pos"), F.floor((F.col("pos") - 1) / size).cast("long").alias("chunk_id")).groupBy("chrom", "chunk_id").agg(at)
    rows = spread_out(chunks).join(asked, ["chrom", "chunk_id"])
    rows = _edged(rows, chunks, radius) if radius else rows.withColumns({"left": F.lit(""), "right": F.lit("")})
    return rows.select("chrom", "chunk_id", "seq", "left", "right", "at").mapInArrow(cut, "chrom string, pos long, around string")


def spread_out(chunks: DataFrame) -> DataFrame:
    """(chrom, chunk_id, seq) of the chunks, dealt to all cores: their text shrinks so well that adaptive execution would put all of it into a few tasks."""
    named = chunks.select(F.col("name").alias("chrom"), F.col("chunk_id").cast("long").alias("chunk_id"), "seq")
    return named.repartition(PARTS * chunks.sparkSession.sparkContext.defaultParallelism, "chrom", "chunk_id")


def _edged(rows: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """rows (chrom, chunk_id, ...) with left and right, the `radius` bases of the neighbours next to each chunk."""
    edges = small(chunks.select(F.col("name").alias("chrom"), F.col("chunk_id").cast("long").alias("chunk_id"), F.left("seq", F.lit(radius)).alias("first"), F.right("seq", F.lit(radius)).alias("last")))
    before = edges.select("chrom", (F.col("chunk_id") + 1).alias("chunk_id"), F.col("last").alias("left"))
    after = edges.select("chrom", (F.col("chunk_id") - 1).alias("chunk_id"), F.col("first").alias("right"))
    return rows.join(before, ["chrom", "chunk_id"], "left").join(after, ["chrom", "chunk_id"], "left")


def word_width(words: np.ndarray) -> int:
    """The width of the words of a table of 4 ** width entries."""
    return (len(words).bit_length() - 1) // 2


def turned_words(words: np.ndarray) -> np.ndarray:
    """The table of words for the other strand: each word has the entry of its reverse complement."""
    left, turned = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    for _ in range(word_width(words)):
        left, turned = left // 4, turned * 4 + 3 - left % 4
    return words[turned]


def counted(chunks: DataFrame, ranges: DataFrame, words: dict[str, list[np.ndarray]], size: int = CHUNK) -> DataFrame:
    """The distinct ranges (chrom, start, end), 0-based and with the end left out, with how often each of the words lies in them.

    `words` has by name tables of how often a word counts (0 to 15), by the
    word's number, whose digits are its bases in the order ACGT. Beside their
    columns are n, the letters that the genome has there, and n_other, those
    that are no bases. Every chunk that a range touches is gone through once,
    whatever the number of ranges: a range's counts are the difference of the
    running counts at its two ends.
    """
    alike_width = {(name, word_width(t)): sum(x.astype(np.int64) for x in several if len(x) == len(t)) for name, several in words.items() for t in several}
    tables = [(name, w, t) for (name, w), t in alike_width.items()]
    groups = []
    for width in sorted({w for _, w, _ in tables}):
        alike = [(name, t) for name, w, t in tables if w == width]
        for three in (alike[i : i + 3] for i in range(0, len(alike), 3)):
            groups.append((width, [name for name, _ in three], sum(t << (FIELD * k) for k, (_, t) in enumerate(three))))
    names, reach = ["n", "n_other", *words], max([w for _, w, _ in tables], default=1) - 1
    if size + 2 * reach >= 1 << (FIELD - 4) or reach > size:
        raise ValueError("chunks are too large for the counts, or smaller than a word")

    def counts(text: str, length: int, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """What begins before each start, what ends with each end or before, and what begins in the chunk at all; less than 0 where words of the chunk before are in it."""
        digits = DIGITS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        other = np.concatenate([[0], np.cumsum(digits > 3)])
        starts, ends = np.minimum(starts, length), np.minimum(ends, length)
        at = np.concatenate([starts, ends, [length]])
        out = {name: np.zeros(len(at), np.int64) for name in words} | {"n": at, "n_other": other[at + reach] - other[reach]}
        numbers, width = np.minimum(digits, 3), 1
        for w, in_group, table in groups:
            while width < w:
                numbers, width = numbers[:-1] * 4 + np.minimum(digits[width:], 3), width + 1
            hits = table[numbers]
            if other[-1]:
                hits[other[w:] > other[:-w]] = 0
            sums = np.concatenate([[0], np.cumsum(hits)])
            found = sums[np.concatenate([starts, ends - (w - 1), [length]]) + reach]
            for k, name in enumerate(in_group):
                out[name] += (found >> (FIELD * k) & ((1 << FIELD) - 1)) - (int(sums[reach]) >> (FIELD * k) & ((1 << FIELD) - 1))
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk, seq, left, right, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("chrom", "chunk_id", "seq", "left", "right", "starts", "ends"))):
                seq = (seq or "").upper()
                beside = "N" * reach if len(seq) < size else f"{(right or '').upper():N<{reach}}"
                made = counts(f"{(left or '').upper():N>{reach}}{seq}{beside}", len(seq), np.array(starts, np.int64), np.array(ends, np.int64))
                at = pa.array([chunk * size + x for x in (*starts, *ends)] + [None], pa.int64())
                is_end = pa.array([False] * len(starts) + [True] * len(ends) + [None], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([chunk] * len(at), pa.int64()), at, is_end, *[pa.array(made[n]) for n in names]], names=["chrom", "chunk_id", "at", "is_end", *names])

    wanted = ranges.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start < end").distinct()
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long")
    spread = wanted.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    mark = lambda c, here: F.collect_set(F.when(here == F.col("chunk_id"), (F.col(c) - F.col("chunk_id") * size).cast("int"))).alias(f"{c}s")
    asked = spread.groupBy("chrom", "chunk_id").agg(mark("start", first), mark("end", last))
    rows = asked.join(spread_out(chunks), ["chrom", "chunk_id"], "left")
    schema = ", ".join(["chrom string, chunk_id long, at long, is_end boolean", *[f"`{n}` long" for n in names]])
    rows = _edged(rows, chunks, reach) if reach else rows.withColumns({"left": F.lit(""), "right": F.lit("")})
    found = stored(rows.select("chrom", "chunk_id", "seq", "left", "right", "starts", "ends").mapInArrow(cut, schema))
    earlier = Window.partitionBy("chrom").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.filter("at IS NULL").select("chrom", "chunk_id", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in names])
    running = found.filter("at IS NOT NULL").join(totals, ["chrom", "chunk_id"]).select("chrom", "at", "is_end", *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names])
    side = lambda is_end, c: running.filter(F.col("is_end") == is_end).select("chrom", F.col("at").alias(c), *[F.col(n).alias(f"__{c}_{n}") for n in names])
    both = wanted.join(side(False, "start"), ["chrom", "start"]).join(side(True, "end"), ["chrom", "end"])
    return both.select("chrom", "start", "end", *[F.greatest(F.lit(0), F.col(f"__end_{n}") - F.col(f"__start_{n}")).alias(n) for n in names])


def fasta(found: DataFrame, width: int = 60) -> DataFrame:
    """(region_id, record): each region as a FASTA record, its bases in lines of `width`."""
    lines = F.regexp_replace("seq", rf"(.{{{width}}})(?=.)", "$1\n")
    return found.select("region_id", F.concat(F.lit(">"), "name", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("\n"), lines).alias("record"))
