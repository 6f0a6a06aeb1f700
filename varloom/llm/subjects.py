"""Subjects of documents: one-versus-rest linear classifiers on hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.leakage import unnested, without_brackets
from varloom.llm.words import characters, code_points, word_bounds, word_hashes
from varloom.support import small, stored

#: Number of hashed features; the weights of one subject are an array of that size.
FEATURES = 1 << 17

#: Bounds on the documents from which weakly labelled sentences are taken for fitting, in all and of one language, on
#: the sentences of one document among them, and on the labelled samples of one subject. Every document is scored.
FIT_DOCUMENTS, FIT_LANGUAGE, FIT_SENTENCES, FIT_SAMPLES = 10_000, 2000, 60, 2000

#: Strength of the quadratic penalty and number of steps of a fit.
PENALTY, STEPS = 5e-5, 120

#: Least threshold. Below it a sentence of common words alone could pass where subjects are few.
LOWEST = -0.25


@dataclass(frozen=True)
class Rules:
    """What decides on documents and on weak labels.

    min_sentences: sentences that must deal with a subject for the document to
    have it. conduct: the subject of documents that only conduct the sitting,
    or None; conduct_share: the share of such sentences from which a document
    does nothing else. rounds: fits on weakly labelled sentences after the one
    on the samples; surer: what a sentence's score must have above the threshold
    while only the samples have been learned from. A section (a value of a
    metadata column or a beginning of a path) labels its documents if at least
    section_sentences of its sentences were recognised and at least
    section_purity of them as one subject; a document is its own section with
    own_sentences and own_purity.
    """

    min_sentences: int = 3
    conduct: str | None = "procedure"
    conduct_share: float = 0.5
    rounds: int = 2
    surer: float = 1.0
    section_sentences: int = 20
    section_purity: float = 0.9
    own_sentences: int = 2
    own_purity: float = 0.75


# Fixed value: a short interjection set between dashes, as minutes print it.
INTERJECTION = r"[–—] [^–—.!?]{1,40}[.!?\"”]* [–—](?=\s)"

# The characters that end a sentence if white space follows.
SENTENCE_ENDS = np.array([ord(c) for c in ".!?"], np.uint32)


def plain(text: Column) -> Column:
    """The text without interruptions in brackets or between dashes, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_brackets(F.coalesce(text, F.lit(""))), INTERJECTION, " "), r"\s+", " "))


def hashed_sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of_doc, of_sentence, index): the hashed words and word pairs of each sentence of plain texts.

    `of_doc` bounds the sentences of each text, `of_sentence` the features of
    each sentence. Digits do not count; a sentence without a letter is none.
    """
    codes, begins = code_points([unnested(t).lower() for t in texts])
    starts, ends = word_bounds(codes, "letter")
    stops = np.nonzero(np.isin(codes[:-1], SENTENCE_ENDS) & characters("space")[codes[1:]])[0]
    sentence = np.searchsorted(np.union1d(stops + 1, begins), starts, side="right")
    first = np.nonzero(np.diff(np.concatenate([[-1], sentence])))[0]
    of_word = np.concatenate([first, [len(starts)]]).astype(np.int64)
    of_doc = np.concatenate([np.searchsorted(starts[first], begins), [len(first)]]).astype(np.int64)
    single = word_hashes(codes, starts, ends)
    # a pair takes the place after its first word; a sentence's last word starts none
    both = np.empty(2 * len(single), np.uint64)
    both[0::2] = single
    both[1:-1:2] = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    keep = np.ones(len(both), bool)
    keep[2 * of_word[1:] - 1] = False
    index = ((both[keep] ^ (both[keep] >> np.uint64(29))) % np.uint64(FEATURES)).astype(np.int32)
    return of_doc, 2 * of_word - np.arange(len(of_word)), index


def featured(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(doc, feats): an array of hashed n-grams for each sentence of each whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_doc, of_sentence, index = hashed_sentences(batch.column("plain").to_pylist())
            inner = pa.ListArray.from_arrays(pa.array(of_sentence, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), inner)], names=["doc", "feats"])

    rows = df.select(F.col(f"`{row_id}`").alias("doc"), plain(F.col(f"`{text}`")).alias("plain"))
    return rows.mapInArrow(hashed, "doc long, feats array<array<int>>")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches of `values` between the bounds."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def logistic(
    bounds: np.ndarray, index: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, steps: int = STEPS, penalty: float = PENALTY
) -> tuple[np.ndarray, float]:
    """Weights and offset of a penalised logistic regression on rows of present features (adaptive gradient steps).

    `share` is how much each row counts, 1 on average.
    """
    counts = 1.0 if share is None else share
    present, local = np.unique(index, return_inverse=True)
    w, g2 = np.zeros(len(present)), np.full(len(present), 1e-8)
    b, gb2, n = -2.0, 1e-8, max(1, len(y))
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(_sums(w[local], bounds) + b, -30, 30))) - y
        off = off * counts
        g = np.bincount(local, weights=off[rows], minlength=len(present)) / n + penalty * w
        gb = off.sum() / n
        g2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * gb / np.sqrt(gb2)
    weights = np.zeros(FEATURES)
    weights[present] = w
    return weights, b


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which on calling a row positive gives the best F1, between LOWEST and 0."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    return float(np.clip(score[order][int(np.argmax(f1))], LOWEST, 0.0)) if len(y) else 0.0


def fit(rows: DataFrame, subjects: list[str]) -> dict[str, tuple[np.ndarray, float, float]]:
    """(weights, offset, threshold) of each subject from rows (doc, at, feats, label, held).

    One row is one sentence. The rows are bounded by FIT_SAMPLES, FIT_DOCUMENTS
    and FIT_SENTENCES whatever the corpus; they go along to the tasks once, as
    arrays, and each subject's classifier against the rest is fitted in a task
    of its own. Labels count alike however many rows they have, so that a
    frequent subject does not draw common words to itself. A fifth of the rows
    is held out; on it each threshold is calibrated. What comes back is one
    array of FEATURES weights per subject.
    """
    spark = rows.sparkSession
    table = rows.select("doc", "at", "feats", "label", "held").toArrow().sort_by([("doc", "ascending"), ("at", "ascending"), ("label", "ascending")]).combine_chunks()
    feats = table.column("feats").combine_chunks()
    feats = feats if isinstance(feats, pa.ListArray) else feats.chunk(0)
    labels = np.array(table.column("label").to_pylist())
    held = table.column("held").to_numpy(zero_copy_only=False).astype(bool)
    bounds = (feats.offsets.to_numpy() - feats.offsets[0].as_py()).astype(np.int64)
    shared = spark.sparkContext.broadcast((bounds, feats.flatten().to_numpy().astype(np.int32), labels, held))

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds, index, labels, held = shared.value
        lengths, counts = np.diff(bounds), dict(zip(*np.unique(labels, return_counts=True)))
        share = len(labels) / (len(counts) * np.array([counts[x] for x in labels])) if len(labels) else np.zeros(0)
        kept = np.repeat(~held, lengths)
        for pdf in parts:
            for subject in pdf["subject"]:
                y = (labels == subject).astype(float)
                w, b = logistic(np.concatenate([[0], np.cumsum(lengths[~held])]), index[kept], y[~held], share[~held])
                threshold = best_threshold((_sums(w[index], bounds) + b)[held], y[held])
                yield pd.DataFrame({"subject": [subject], "weights": [w.astype(np.float32).tobytes()], "offset": [b], "threshold": [threshold]})

    asked = spark.createDataFrame([(s,) for s in subjects], "subject string").repartition(len(subjects))
    got = asked.mapInPandas(one, "subject string, weights binary, offset double, threshold double").collect()
    return {r.subject: (np.frombuffer(r.weights, dtype=np.float32), r.offset, r.threshold) for r in got}


def count_sentences(corpus: DataFrame, row_id: str, text: str, model: dict[str, tuple[np.ndarray, float, float]], subjects: list[str], extra: float = 0.0) -> DataFrame:
    """(doc, n_sentences, counts): how many sentences deal with each subject, in the order of `subjects`.

    A sentence deals with every subject whose own score passes the threshold
    calibrated for that subject (plus `extra`): with none, one or several. The weights, whose size is fixed by
    FEATURES and the number of subjects, go to the tasks as a broadcast; the
    whole corpus is scored in one pass over its text without a shuffle.
    """
    weights = np.stack([model[s][0] for s in subjects], axis=1)
    offsets, thresholds = np.array([model[s][1] for s in subjects]), np.array([model[s][2] for s in subjects]) + extra
    shared = corpus.sparkSession.sparkContext.broadcast((weights, offsets, thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, offset, threshold = shared.value
        for batch in batches:
            of_doc, of_sentence, index = hashed_sentences(batch.column("plain").to_pylist())
            marks = np.zeros((of_doc[-1], w.shape[1]), np.int64)
            lot = 5_000
            for at in range(0, len(marks), lot):
                bounds = of_sentence[at : at + lot + 1]
                z = _sums(w[index[bounds[0] : bounds[-1]]], bounds - bounds[0]) + offset
                marks[at : at + len(z)] = z > threshold
            counts = _sums(marks, of_doc).ravel()
            bounds = pa.array(np.arange(len(of_doc)) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.diff(of_doc), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))], names=["doc", "n_sentences", "counts"]
            )

    rows = corpus.select(F.col(f"`{row_id}`").alias("doc"), plain(F.col(f"`{text}`")).alias("plain"))
    return rows.mapInArrow(score, "doc long, n_sentences long, counts array<long>")


def prevailing(counts: Column, subjects: list[str], total: Column, sentences: int, purity: float) -> Column:
    """The subject with at least so many sentences and that share of the total, else null."""
    label = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(subjects))):
        n = F.get(counts, F.lit(i))
        label = F.when((n >= sentences) & (n >= purity * total), s).otherwise(label)
    return label


def section_labels(counted: DataFrame, keys: DataFrame, subjects: list[str], rules: Rules) -> DataFrame:
    """(doc, section_label): what a document's sections say it deals with, where just one subject comes out.

    `counted` is (doc, n_sentences, counts), `keys` (doc, section). A section is
    believed if its recognised sentences are many and nearly all of one subject;
    what its purity is worth is measured here, not assumed. Sections are counted
    before the shuffle, so a hot one is one row a task.
    """
    topical = [s for s in subjects if s != rules.conduct]
    sums = [F.sum(F.get("counts", F.lit(subjects.index(s)))).alias(f"n{i}") for i, s in enumerate(topical)]
    of_section = keys.join(counted, "doc").groupBy("section").agg(*sums)
    counts = F.array(*[F.col(f"n{i}") for i in range(len(topical))])
    total = sum((F.col(f"n{i}") for i in range(len(topical))), F.lit(0))
    believed = of_section.select("section", prevailing(counts, topical, total, rules.section_sentences, rules.section_purity).alias("label")).filter("label IS NOT NULL")
    said = keys.join(believed, "section").groupBy("doc").agg(F.collect_set("label").alias("labels"))
    return said.filter(F.size("labels") == 1).select("doc", F.get("labels", F.lit(0)).alias("section_label"))


def own_label(subjects: list[str], rules: Rules) -> Column:
    """The one subject that plainly prevails in a document as counted, else null; for conduct, if nothing else is dealt with."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    topical = [s for s in subjects if s != rules.conduct]
    counts = F.array(*[F.get("counts", F.lit(subjects.index(s))) for s in topical])
    label = prevailing(counts, topical, total, rules.own_sentences, rules.own_purity)
    if rules.conduct not in subjects:
        return label
    n = F.get("counts", F.lit(subjects.index(rules.conduct)))
    return F.when((n >= 1) & (n == total) & (n >= rules.conduct_share * F.col("n_sentences")), rules.conduct).otherwise(label)


def path_beginnings(path: Column) -> Column:
    """All beginnings of an address path, `a`, `a/b`, `a/b/c`, without its last part, a query or a fragment."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*", ""), r"^[a-z][a-z0-9+.-]*://|^/+|/+$", "")
    steps = F.split(bare, "/+")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps) - 1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def _begun(column: str) -> Column:
    some = F.filter(path_beginnings(F.col(f"`{column}`")), lambda x: x != "")
    return F.coalesce(F.transform(some, lambda x: F.concat(F.lit(f"{column}="), x)), F.array().cast("array<string>"))


def section_keys(sections: list[str], paths: list[str]) -> Column:
    """The sections of a row: each metadata column's value and each beginning of its address paths, with the column's name."""
    values = [F.array(F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")))) for c in sections]
    begun = [_begun(c) for c in paths]
    return F.array_distinct(F.array_compact(F.concat(*values, *begun))) if values or begun else F.array().cast("array<string>")


def fit_sample(corpus: DataFrame, doc_id: str, text: str, lang: str, keys: Column, fit_documents: int) -> DataFrame:
    """(doc, text, sections): about `fit_documents` documents by a hash of the id, alike many of each language as far as they go.

    No more than FIT_LANGUAGE are of one language, so that a frequent one does
    not outweigh the others. Documents without a language count as one language
    more. The language counts are one number per language.
    """
    language = F.coalesce(F.lower(F.trim(F.col(f"`{lang}`"))), F.lit(""))
    counts = corpus.groupBy(language.alias("language")).agg(F.count("*").alias("n"))
    left, each, sizes = fit_documents, 0.0, sorted(r.n for r in counts.select("n").collect())
    for i, n in enumerate(sizes):
        each = min(FIT_LANGUAGE, max(each, left / (len(sizes) - i)))
        if n > each:
            break
        left -= n
    wanted = counts.select("language", F.ceil(F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * 1_000_000).alias("parts"))
    marked = corpus.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"), keys.alias("sections"), language.alias("language"))
    return marked.join(small(wanted), "language").filter(F.pmod(F.xxhash64(F.lit("fit"), "doc"), F.lit(1_000_000)) < F.col("parts")).select("doc", "text", "sections")


def labelled_samples(samples: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc, at, feats, label): the sentences of at most FIT_SAMPLES samples of each subject, by a hash of the id where there are more."""
    known = samples.filter(F.col("subject").isin(subjects))
    sizes = known.groupBy("subject").agg(F.count("*").alias("n"))
    bounded = known.join(F.broadcast(sizes), "subject").filter(F.pmod(F.xxhash64("sample_id"), F.lit(1_000_000)) * F.col("n") < FIT_SAMPLES * F.lit(1_000_000).cast("long"))
    shown = featured(bounded, "sample_id", "text").join(bounded.select(F.col("sample_id").alias("doc"), F.col("subject").alias("label")), "doc")
    return shown.select("doc", "label", F.posexplode("feats").alias("at", "feats")).filter(F.size("feats") > 0)


def train(
    corpus: DataFrame, doc_id: str, text: str, lang: str, samples: DataFrame, subjects: list[str], sections: list[str], paths: list[str], rules: Rules, fit_documents: int
) -> dict[str, tuple[np.ndarray, float, float]] | None:
    """The classifiers, first from the samples, then from weakly labelled documents too; None without a sample."""
    seed = stored(labelled_samples(samples, subjects))
    if seed.isEmpty():
        return None
    held = F.pmod(F.xxhash64("doc"), F.lit(5)) == 0
    model = fit(seed.withColumn("held", held), subjects)
    picked = stored(fit_sample(corpus, doc_id, text, lang, section_keys(sections, paths), fit_documents))
    feats = F.slice(F.array_sort(F.transform("feats", lambda x, i: F.struct(F.xxhash64("doc", i).alias("h"), i.alias("at"), x.alias("feats")))), 1, FIT_SENTENCES)
    sentences = stored(featured(picked, "doc", "text").select("doc", F.explode(feats).alias("s")).select("doc", "s.at", "s.feats").filter(F.size("feats") > 0))
    for n in range(rules.rounds):
        counted = stored(count_sentences(picked, "doc", "text", model, subjects, extra=rules.surer if n == 0 else 0.0))
        weak = counted.select("doc", own_label(subjects, rules).alias("label"))
        if sections or paths:
            said = section_labels(counted, picked.select("doc", F.explode("sections").alias("section")), subjects, rules)
            weak = weak.join(said, "doc", "left").select("doc", F.coalesce("label", "section_label").alias("label"))
        more = sentences.join(weak.filter("label IS NOT NULL"), "doc").select("doc", "at", "feats", "label")
        model = fit(seed.select("doc", "at", "feats", "label").unionByName(more).withColumn("held", held), subjects)
    return model


def document_subjects(
    corpus: DataFrame,
    doc_id: str,
    text: str,
    lang: str,
    samples: DataFrame,
    areas: DataFrame,
    sections: list[str] | None = None,
    paths: list[str] | None = None,
    rules: Rules | None = None,
    fit_documents: int = FIT_DOCUMENTS,
) -> DataFrame:
    """(doc, subject): every subject that at least rules.min_sentences sentences of a document deal with.

    The first classifiers learn from the labelled samples. They measure which
    `sections` (columns of metadata) and which beginnings of `paths` (columns of
    address paths) are nearly pure; a bounded sample of documents is labelled
    weakly by those and by the subject that plainly prevails in the document
    itself, which brings in wording that the samples lack. Further fits on those
    sentences follow, each with a threshold per subject calibrated on held-out
    rows. Then every sentence of every document is scored.

    Defined results: a document half of whose sentences conduct the sitting and
    that has no subject has the conduct subject alone, and no other has it; null
    and empty texts have none; texts are read whole; repeated rows of one id
    give repeated rows; an empty corpus gives none, and without samples none.
    """
    rules = rules or Rules()
    subjects = sorted(r[0] for r in areas.select("subject").distinct().collect())
    model = train(corpus, doc_id, text, lang, samples, subjects, sections or [], paths or [], rules, fit_documents)
    if model is None:
        return corpus.sparkSession.createDataFrame([], corpus.select(F.col(f"`{doc_id}`").alias("doc")).schema.add("subject", "string"))
    counted = count_sentences(corpus, doc_id, text, model, subjects)
    n_of = {s: F.get("counts", F.lit(i)) for i, s in enumerate(subjects)}
    topical = F.array_compact(F.array(*[F.when(n >= rules.min_sentences, F.lit(s)) for s, n in n_of.items() if s != rules.conduct]))
    conducts = n_of.get(rules.conduct, F.lit(0))
    only = (F.size("found") == 0) & (F.col("conducts") >= 1) & (F.col("conducts") >= rules.conduct_share * F.col("n_sentences"))
    found = counted.select("doc", "n_sentences", conducts.alias("conducts"), topical.alias("found"))
    return found.select("doc", F.explode(F.when(only, F.array(F.lit(rules.conduct))).otherwise(F.col("found"))).alias("subject"))
