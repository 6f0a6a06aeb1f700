"""Evaluation passages inside a corpus: pigeonhole pieces, then bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.words import code_points, word_bounds, word_hashes
from varloom.support import small, stored

#: Successive words that make a leak, and edits (characters) that a near leak may hold.
MIN_WORDS, BUDGET = 10, 1

#: Words of items whose pieces go along to the tasks at a time; more items are taken in blocks, one pass over the corpus each.
BLOCK_WORDS = 1_000_000

#: Words of an item that are handled as one; longer items are cut into stretches that overlap.
STRETCH = 4096

#: Documents whose words a task holds at a time, and hits of pieces that it compares at a time.
LOT, HITS_AT_ONCE = 500, 500_000

WORD, BRACKET = re.compile(r"[^\W_]+"), re.compile(r"[()\[\]]")

HITS = pa.schema([("doc", pa.int64()), ("stretch", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("runs", pa.list_(pa.int32())), ("found", pa.list_(pa.string()))])


def words_in(text: str | None) -> list[str]:
    """The runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


def without_brackets(text: Column) -> Column:
    """The text with what stands in round or square brackets left out, down to two levels; unnested() takes off what is left."""
    for _ in range(2):
        text = F.regexp_replace(text, r"\([^()\[\]]*+\)|\[[^()\[\]]*+\]", " ")
    return text


def unnested(text: str | None) -> str:
    """The text with everything in matching round or square brackets left out, at any depth; brackets without partner stay.

    A bracket that stays also keeps those round it from matching.
    """
    if not text or ("(" not in text and "[" not in text):
        return text or ""
    spans: list[tuple[int, int]] = []
    still_open: list[int] = []
    for m in BRACKET.finditer(text):
        mark, at = m.group(), m.start()
        if mark in "([":
            still_open.append(at)
        elif still_open and text[still_open[-1]] + mark in ("()", "[]"):
            start = still_open.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at + 1))
        else:
            still_open.clear()
    kept, end = [], 0
    for start, stop in spans:
        kept.append(text[end:start])
        end = stop
    return " ".join([*kept, text[end:]])


def edit_distance(pattern: str, text: str) -> int:
    """The least edits that turn the pattern into some part of the text (Myers' bit vectors)."""
    m = len(pattern)
    if m == 0:
        return 0
    full, last = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def _distance(min_words: int, budget: int):
    """The least distance of the likely runs of item words round a piece from the document's words where they should stand."""

    def least(words: list[str], at: int, lead: int, runs: list[int], found: list[str]) -> int:
        best = 1 << 30
        for shift in runs:
            first = max(0, lead + shift - budget)
            text = " ".join(found[first : lead + shift + min_words + budget])
            best = min(best, edit_distance(f" {' '.join(words[at + shift : at + shift + min_words])} ", f" {text} "))
            if best == 0:
                break
        return best

    @F.pandas_udf("int")
    def distance(words: pd.Series, at: pd.Series, lead: pd.Series, runs: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([least(list(w), int(a), int(b), [int(x) for x in r], list(f)) for w, a, b, r, f in zip(words, at, lead, runs, found)], dtype="int32")

    return distance


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` neighbouring entries; the last size - 1 places start none."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def item_stretches(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """(item, stretch, words): the words of each item, long ones in stretches of which every min_words successive words share one."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                w = words_in(text)
                for at in range(0, max(1, len(w) - min_words + 1), STRETCH) if len(w) >= min_words else ():
                    rows.append((item, at, w[at : at + STRETCH + min_words - 1]))
            yield pd.DataFrame(rows, columns=["item", "at", "words"])

    named = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).mapInPandas(cut, "item long, at int, words array<string>")
    return named.distinct().select("item", F.xxhash64("item", "at", "words").alias("stretch"), "words")


def piece_size(min_words: int, budget: int) -> int:
    return max(1, -((2 * budget - min_words) // (budget + 1)))


def hashed(words: list[str]) -> np.ndarray:
    """A hash of each word."""
    codes, _ = code_points(words)
    return word_hashes(codes, *word_bounds(codes, "word")).view(np.int64)


class _Pieces:
    """The pieces of a block of item stretches, ready to be looked up by the hash of a run of words.

    Words are kept as hashes, stretch after stretch with gaps between, so that
    the words round a piece can be compared for many hits at once.
    """

    def __init__(self, rows: list, size: int, gap: int):
        lists = [hashed(list(r.words)) for r in rows]
        lengths = np.array([len(x) for x in lists], np.int64)
        self.stretch = np.array([r.stretch for r in rows], np.int64)
        self.first = gap + np.cumsum(np.concatenate([[0], lengths + gap]))[:-1].astype(np.int64)
        self.end = self.first + lengths
        self.words = np.full(int(self.end[-1]) + gap if rows else gap, -1, np.int64)
        for at, x in zip(self.first, lists):
            self.words[at : at + len(x)] = x
        of = np.repeat(np.arange(len(rows)), np.maximum(lengths - size + 1, 0))
        place = np.concatenate([at + np.arange(max(0, n - size + 1)) for at, n in zip(self.first, lengths)]) if rows else np.zeros(0, np.int64)
        hashes = run_hashes(self.words.astype(np.uint64), size)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place, self.of = hashes[order], place[order], of[order]


def _likely(pieces: _Pieces, doc: np.ndarray, at: np.ndarray, hit: np.ndarray, size: int, min_words: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(hits, runs): the hits (doc place, piece) that can belong to a run of min_words item words within the budget, and which runs those are.

    `runs` says for each hit and each of the runs that hold the piece, the
    first one beginning min_words - size words before it, whether it is likely.

    Only the first piece of a stretch of equal words is kept, as the run may
    be moved back to it. An edit changes two words at most and shifts the words
    behind it by one, so all but 2 * budget words of some run round the piece
    stand in the document at most `budget` places from their own.
    """
    place, side = pieces.place[hit], min_words - size
    keep = doc[at - 1] != pieces.words[place - 1]
    index, at, place, row = np.nonzero(keep)[0], at[keep], place[keep], pieces.of[hit[keep]]
    same = np.ones((len(at), size + 2 * side), np.int8)
    for j in (*range(-side, 0), *range(size, size + side)):
        word = pieces.words[place + j]
        same[:, j + side] = np.any([doc[at + j + s] == word for s in range(-budget, budget + 1)], axis=0)
    total = np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    good = np.zeros((len(at), side + 1), bool)
    for start in range(side + 1):
        low = place + start - side
        inside = (low >= pieces.first[row]) & (low + min_words <= pieces.end[row])
        good[:, start] = inside & (total[:, start + min_words] - total[:, start] >= min_words - 2 * budget)
    some = good.any(axis=1)
    return index[some], good[some]


def piece_hits(docs: DataFrame, pieces: _Pieces, size: int, min_words: int, budget: int) -> DataFrame:
    """(doc, stretch, at, lead, runs, found) wherever a piece stands in a document amid enough words of its item.

    `docs` is (doc, text). The words of each text are hashed, neighbouring
    hashes are combined over whole batches at once, and runs whose hash is a
    piece's are hits; `at` is the piece's first word in its stretch, `found` the
    document's words round it, the piece behind `lead` of them, and `runs` where
    the likely runs begin, counted from the piece. What is no likely leak never
    leaves the task.
    """
    shared, side = docs.sparkSession.sparkContext.broadcast(pieces), min_words - size + budget

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: _Pieces = shared.value
        for batch in batches:
            ids, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            for first in range(0, len(ids), LOT):
                lot = [unnested(t).lower() for t in texts[first : first + LOT]]
                codes, begins = code_points(lot)
                starts, ends = word_bounds(codes, "word")
                of = np.searchsorted(begins, starts, side="right") - 1  # the text of each word
                place = np.arange(len(starts)) + side * (of + 1)
                doc = np.full(len(starts) + side * (len(lot) + 1), -2, np.int64)
                doc[place] = word_hashes(codes, starts, ends).view(np.int64)
                word = np.full(len(doc), -1, np.int64)
                word[place] = np.arange(len(starts))
                runs = run_hashes(doc.astype(np.uint64), size).view(np.int64)
                low = np.searchsorted(wanted.hashes, runs, side="left")
                seen = np.nonzero(wanted.hashes[np.minimum(low, max(0, len(wanted.hashes) - 1))] == runs)[0] if len(wanted.hashes) else np.zeros(0, np.int64)
                high = np.searchsorted(wanted.hashes, runs[seen], side="right")
                rows = []
                counts = high - low[seen]
                bounds = np.concatenate([[0], np.nonzero(np.diff(np.cumsum(counts) // HITS_AT_ONCE))[0] + 1, [len(seen)]])
                for a, b in zip(bounds[:-1], bounds[1:]):
                    n = counts[a:b]
                    at = np.repeat(seen[a:b], n)
                    hit = np.repeat(low[seen[a:b]], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    for k, good in zip(*_likely(wanted, doc, at, hit, size, min_words, budget)):
                        w, row = int(word[at[k]]), wanted.of[hit[k]]
                        d = int(of[w])
                        near = range(max(w - side, int(np.searchsorted(of, d))), min(w + size + side, int(np.searchsorted(of, d, side="right"))))
                        found = [lot[d][starts[i] - begins[d] : ends[i] - begins[d]] for i in near]
                        runs_of = (np.nonzero(good)[0][::-1] - (min_words - size)).tolist()
                        rows.append((ids[first + d], int(wanted.stretch[row]), int(wanted.place[hit[k]] - wanted.first[row]), w - near.start, runs_of, found))
                columns = list(zip(*rows)) if rows else [[] for _ in HITS]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, HITS.types)], schema=HITS)

    return docs.mapInArrow(find, "doc long, stretch long, at int, lead int, runs array<int>, found array<string>")


def leaked_passages(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS, budget: int = BUDGET
) -> DataFrame:
    """(doc, item, distance): every document and item that share a passage of min_words words with at most `budget` edits.

    Pigeonhole: an edit changes two words of an item at most (a space lost), so
    budget edits leave all but 2 * budget words of a run equal, in at most
    budget + 1 stretches, and the longest holds a piece of piece_size() words.
    Pieces start at every word of an item. Their exact hits in the corpus are
    compared with the words round them, and Myers' bit-parallel distance decides
    what is left: a pair stays if some run of min_words item words stands in the
    document with at most `budget` edits. `distance` is the least one; 0 says
    that min_words successive words are equal.

    The pieces go along to the tasks as arrays of a bounded size. Items of more
    than BLOCK_WORDS words in all are taken in blocks, with one pass over the
    corpus each, so nothing depends on how many there are.

    Defined results: words are compared without regard to case, punctuation,
    line breaks and anything in brackets in the document, at any depth; one row
    per pair; items of fewer than min_words words, null and empty texts match
    nothing; texts are taken whole, of any length. A hot passage meets no
    shuffle before its hits are verified.
    """
    size = piece_size(min_words, budget)
    stretches = stored(item_stretches(items, item_id, item_text, min_words))
    docs = corpus.select(F.col(f"`{doc_id}`").alias("doc"), without_brackets(F.col(f"`{text}`")).alias("text"))
    words = stretches.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    found = None
    for block in range(blocks):
        rows = stretches.filter(F.pmod("stretch", F.lit(blocks)) == block).orderBy("stretch").collect()
        hits = piece_hits(docs, _Pieces(rows, size, min_words + budget), size, min_words, budget)
        found = hits if found is None else found.unionByName(hits)
    near = _distance(min_words, budget)("words", "at", "lead", "runs", "found")
    checked = found.join(small(stretches, keep=False), "stretch").select("doc", "item", near.alias("distance")).filter(F.col("distance") <= budget)
    return checked.groupBy("doc", "item").agg(F.min("distance").alias("distance"))
