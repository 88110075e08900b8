"""Scores for abusive, hateful and sexual language by the nearest labelled examples.

Documents are read as messages and cut into passages (:mod:`.mailtext`). The
examples are passages of a bounded sample of labelled documents. A label holds
for a document, so the passages it is about are found first: those of positive
documents whose neighbours come from positive documents as well, and that are not
spread over many documents without a label. A passage of any document gets a vote
of its nearest examples, weighted by cosine; a document has the vote of its
highest passage, which is the evidence. A labelled document never takes part in
its own vote, nor do copies of it.

Votes are turned into scores by a calibration (:mod:`.calibration`) on the votes
of the labelled documents, each without its own label.

Word weights use document frequencies over all documents. Every passage of every
document is searched, exactly, on a block-max inverted index of the examples
(:mod:`.neighbours`). The index is bounded by the sample and broadcast, so the
documents themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.calibration import Calibration, copies, fold_of, reliability
from strataweave.llm.mailtext import passages
from strataweave.llm.mixing import source_key
from strataweave.llm.neighbours import BlockMaxIndex, Vectors, ranges, tf_idf
from strataweave.sources.storage import materialize

VERDICTS = ("abusive", "hateful", "sexual")
#: Bounds of the labelled sample, positive and clean documents.
MAX_POSITIVE = 6_000
MAX_CLEAN = 10_000
NEIGHBOURS = 12
FLOOR = 0.35
#: Weight of the prior in a vote, in examples with cosine 1.
PRIOR_WEIGHT = 0.1
#: Weight of a passage of a positive document that has no other example near: with a listed term, and without.
LONELY_WEIGHT = (0.8, 0.25)
#: Weight of a document without a label as a clean one, for the passages of positive documents that it contains.
BACKGROUND_WEIGHT = 0.1
#: Weight of a listed term as an example, and the least severity it takes.
TERM_WEIGHT = 0.6
TERM_SEVERITY = 2
#: Parts of the sample that are voted on by the others.
FOLDS = 5
#: Neighbours that are kept of each passage for models of parts of the sample.
NEAR = 24
#: Bins of the votes of all documents, from which the share of positive ones is found.
VOTE_BINS = 1000
_MARKS = 8_000_000
_SEARCHED = 20_000
THRESHOLD = 0.5


class Words:
    """Numbers of the known words; other words are taken as misspelt or disguised known ones where one is near."""

    def __init__(self, known: list[str]) -> None:
        self.known = known
        self.number = {w: i for i, w in enumerate(known)}
        self.swapped: dict[str, int] = {}
        self.gapped: dict[str, int] = {}
        self.shorter: dict[str, int] = {}
        for i, w in enumerate(known):
            if "*" in w or len(w) < 4:
                continue
            for j in range(1, len(w)):
                self.gapped.setdefault(f"{w[:j]}*{w[j + 1 :]}", i)
            if len(w) >= 5:
                self.swapped.setdefault(_letters(w), i)
            if len(w) >= 6:
                for j in range(1, len(w)):
                    self.shorter.setdefault(w[:j] + w[j + 1 :], i)
        self.longest = max(map(len, known), default=0)
        self.cache: dict[str, tuple[int, ...]] = {}

    def numbers(self, word: str) -> tuple[int, ...]:
        """Known words for a word that is not known itself; empty if none is near."""
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = self._near(word)
        return self.cache[word]

    def _near(self, w: str) -> tuple[int, ...]:
        number = self.number
        if "*" in w:
            joined, parts = w.replace("*", ""), w.split("*")
            if joined in number:
                return (number[joined],)
            if w in self.gapped:
                return (self.gapped[w],)
            if all(p in number and len(p) > 1 for p in parts):
                return tuple(number[p] for p in parts)
            if w.count("*") > 1 and len(joined) >= 3:
                shape = re.compile(w.replace("*", "."))
                return next(((i,) for i, k in enumerate(self.known) if shape.fullmatch(k)), ())
            w = joined
        if len(w) >= 5:
            for part in (w[1:], w[:-1]):  # a letter that belongs to a neighbouring word
                if part in number:
                    return (number[part],)
            if (found := self.swapped.get(_letters(w))) is not None:
                return (found,)
        if len(w) >= 5 and w in self.shorter:
            return (self.shorter[w],)
        if len(w) >= 7 and (parts := self._split(w)):
            return parts
        if len(w) >= 6:
            for j in range(1, len(w)):
                cut = w[:j] + w[j + 1 :]
                if (found := number.get(cut, self.shorter.get(cut))) is not None:
                    return (found,)
        return ()

    def _split(self, w: str) -> tuple[int, ...]:
        """Known words that make up a word when written together, as few as possible."""
        best: list[tuple[int, ...] | None] = [()] + [None] * len(w)
        for end in range(1, len(w) + 1):
            for start in range(max(0, end - self.longest), end):
                part = w[start:end]
                if best[start] is not None and part in self.number and (len(part) > 2 or part == "a"):
                    if best[end] is None or len(best[start]) + 1 < len(best[end]):
                        best[end] = (*best[start], self.number[part])
        return best[-1] or ()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Starts and word numbers of passages of words joined by blanks; unknown words get the number after the last."""
        lists = pc.split_pattern(texts, " ")
        start = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        start = start - start[0]
        ids = pc.fill_null(pc.index_in(words, value_set=pa.array(self.known, words.type)), -1).to_numpy().astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return start, ids
        found = [self.numbers(w) or (len(self.known),) for w in words.take(pa.array(odd)).to_pylist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(f) for f in found]
        out = np.repeat(ids, n)
        at = np.cumsum(n) - n
        out[np.concatenate([at[i] + np.arange(len(f)) for i, f in zip(odd, found, strict=True)])] = np.concatenate(found)
        return np.r_[at, len(out)][start], out


def _letters(w: str) -> str:
    return w[0] + "".join(sorted(w[1:-1])) + w[-1]


@dataclass
class Labelled:
    """Passages of one labelled document, its positive verdict or an empty string, and how many documents it stands for."""

    verdict: str
    passages: Sequence[str] | pa.Array
    weight: float = 1.0
    doc_id: int | None = None

    def texts(self) -> pa.Array:
        return self.passages if isinstance(self.passages, pa.Array) else pa.array(self.passages, pa.string())


def learn_words(sample: Iterable[Labelled]) -> Words:
    """Words of the sample; words of one document only where no other known word is near."""
    n = Counter()
    for d in sample:
        n.update({w for p in d.texts().to_pylist() for w in p.split(" ")})
    common = Words(sorted(w for w, k in n.items() if k > 1 and "*" not in w))
    rare = [w for w, k in n.items() if w not in common.number and "*" not in w and not common.numbers(w)]
    return Words(sorted([*common.known, *rare]))


@dataclass
class Model:
    words: Words
    idf: np.ndarray
    suspects: BlockMaxIndex  # positive examples only: without one of them near, a vote is 0
    index: BlockMaxIndex
    positive: np.ndarray  # weight of each example, by verdict
    clean: np.ndarray

    def vectors(self, texts: pa.Array) -> Vectors:
        return tf_idf(*self.words.encode(texts), self.idf)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vote and verdict number of each passage; equal ones are searched once."""
        coded = texts.dictionary_encode()
        score, kind = self.search(self.vectors(coded.dictionary))
        at = coded.indices.to_numpy()
        return score[at], kind[at]

    def search(self, q: Vectors) -> tuple[np.ndarray, np.ndarray]:
        n = len(q.start) - 1
        score, kind = np.zeros(n), np.zeros(n, np.int64)
        near = np.unique(self.suspects.search(q, 1, FLOOR).query)
        if len(near):
            votes, _ = vote(self.index, q.pick(near), self.positive, self.clean)
            score[near], kind[near] = votes.sum(1), votes.argmax(1)
        return score, kind


def vote(index: BlockMaxIndex, q: Vectors, positive: np.ndarray, clean: np.ndarray, prior: float = 0.0, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """Share of the positive verdicts among the nearest examples, weighted by the square of the cosine, and the weight."""
    m = index.search(q, NEIGHBOURS, floor)
    return _shares(m.query, m.example, m.cosine**2, len(q.start) - 1, positive, clean, prior)


class Seen(NamedTuple):
    """Passages and the number of documents, of all, that contain them."""

    passage: pa.Array
    n: np.ndarray


@dataclass
class Examples:
    """The sample with its distinct passages numbered."""

    words: Words
    idf: np.ndarray
    texts: pa.Array  # the distinct passages
    vectors: Vectors
    of_doc: list[np.ndarray]  # passages of each document
    verdict: np.ndarray  # of each document, -1 if clean
    weight: np.ndarray
    terms: list[tuple[int, int]]  # passage and verdict of each listed term
    listed: np.ndarray  # whether a passage contains one
    n_seen: np.ndarray  # documents with a passage of a positive document, else 0

    @classmethod
    def of(cls, sample: list[Labelled], words: Words, document_frequency: np.ndarray, n_docs: int, terms: Iterable[Labelled] = (), seen: Seen | None = None) -> Examples:
        terms = list(terms)
        usual = np.median(document_frequency[document_frequency > 0]) if (document_frequency > 0).any() else 1
        idf = np.log(1 + n_docs / np.maximum(1, np.r_[document_frequency, usual]))
        parts = [x.texts() for x in (*sample, *terms)]
        coded = pa.concat_arrays([p.cast(pa.string()) for p in parts] or [pa.array([], pa.string())]).dictionary_encode()
        texts = coded.dictionary
        ids = [np.unique(i).astype(np.int64) for i in np.split(coded.indices.to_numpy(), np.cumsum([len(p) for p in parts])[:-1])][: len(parts)]
        n_seen = np.zeros(len(texts))
        if seen is not None and len(seen.passage):
            at = pc.index_in(texts, value_set=seen.passage)
            found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            n_seen[found] = seen.n[at.take(pa.array(found)).to_numpy()]
        return cls(
            words, idf, texts, tf_idf(*words.encode(texts), idf), ids[: len(sample)],
            np.array([VERDICTS.index(d.verdict) if d.verdict else -1 for d in sample], np.int64), np.array([d.weight for d in sample]),
            [(int(i), VERDICTS.index(t.verdict)) for t, one in zip(terms, ids[len(sample) :], strict=True) for i in one],
            _contain(texts, [p for t in terms for p in t.passages]), n_seen,
        )


def fit(sample: list[Labelled], words: Words, document_frequency: np.ndarray, n_docs: int, terms: Iterable[Labelled] = (), seen: Seen | None = None) -> Model | None:
    """Examples and their votes; None without a positive document or term.

    ``terms`` are examples of their own with a lower weight, and lend weight to
    passages that contain them and stand alone. ``seen`` counts the documents, with
    and without a label, that contain a passage of a positive document.
    """
    return learn(Examples.of(sample, words, document_frequency, n_docs, terms, seen))


class Near(NamedTuple):
    """The up to ``NEAR`` nearest passages of the sample to each passage of a positive document, nearest first."""

    passage: np.ndarray
    start: np.ndarray
    example: np.ndarray
    cosine: np.ndarray


def near_passages(spark: SparkSession, x: Examples) -> Near:
    """Searched once, in parts, for all models that are fitted to parts of the sample."""
    wanted = np.unique(np.concatenate([np.zeros(0, np.int64), *(at for at, v in zip(x.of_doc, x.verdict, strict=True) if v >= 0)]))
    parts = max(1, min(64, len(wanted) // 2_000))
    shared = _shared(spark, (x, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                x, wanted = shared()
                mine = wanted[k::parts]
                m = BlockMaxIndex(x.vectors, len(x.words.known)).search(x.vectors.pick(mine), NEAR, FLOOR)
                yield pa.RecordBatch.from_arrays([pa.array(mine[m.query]), pa.array(m.example), pa.array(m.cosine)], ["passage", "example", "cosine"])

    t = spark.range(0, parts, 1, parts).mapInArrow(run, "passage long, example long, cosine double").toArrow()  # NEAR rows a passage of the sample at most
    passage, example, cosine = (t[c].to_numpy() for c in ("passage", "example", "cosine"))
    by = np.lexsort((example, -cosine, passage))
    return Near(wanted, np.r_[np.searchsorted(passage[by], wanted), len(by)], example[by], cosine[by])


def _vote_on(x: Examples, some: np.ndarray, there: np.ndarray, positive: np.ndarray, clean: np.ndarray, prior: float, floor: float, near: Near | None) -> tuple[np.ndarray, np.ndarray]:
    """:func:`vote` on passages ``some`` by the examples ``there``, from what is known to be near as far as that goes."""
    used = np.flatnonzero(there)
    search = lambda rows: vote(BlockMaxIndex(x.vectors.pick(used), len(x.words.known)), x.vectors.pick(rows), positive[used], clean[used], prior, floor)
    if near is None:
        return search(some)
    row = np.searchsorted(near.passage, some)
    n = near.start[row + 1] - near.start[row]
    at = ranges(near.start[row], n)
    query = np.repeat(np.arange(len(some)), n)
    ok = there[near.example[at]] & (near.cosine[at] >= floor)
    query, example, w = query[ok], near.example[at][ok], near.cosine[at][ok] ** 2
    share, mass = _shares(query, example, w, len(some), positive, clean, prior)
    # More neighbours than were kept, and too few of them are there.
    cut = (n == NEAR) & (np.bincount(query, minlength=len(some)) < NEIGHBOURS)
    if cut.any():
        share[cut], mass[cut] = search(some[cut])
    return share, mass


def _shares(query: np.ndarray, example: np.ndarray, w: np.ndarray, n: int, positive: np.ndarray, clean: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the first ``NEIGHBOURS`` of each query."""
    first = np.arange(len(query)) - np.searchsorted(query, query) < NEIGHBOURS
    query, example, w = query[first], example[first], w[first]
    yes = np.stack([np.bincount(query, w * positive[example, c], n) for c in range(positive.shape[1])], 1)
    mass = yes.sum(1) + np.bincount(query, w * clean[example], n)
    return (yes + PRIOR_WEIGHT * prior / positive.shape[1]) / (mass + PRIOR_WEIGHT)[:, None], mass


def learn(x: Examples, left_out: np.ndarray | None = None, near: Near | None = None) -> Model | None:
    """The model of the documents of the sample but those that are left out."""
    docs = [k for k in range(len(x.of_doc)) if left_out is None or not left_out[k]]
    bad_docs = [k for k in docs if x.verdict[k] >= 0]
    if not bad_docs and not x.terms:
        return None
    n, vectors = len(x.texts), x.vectors
    clean, bad = np.zeros(n), np.zeros((n, len(VERDICTS)))
    for k in docs:
        if x.verdict[k] >= 0:
            bad[x.of_doc[k], x.verdict[k]] += x.weight[k]
        else:
            clean[x.of_doc[k]] += x.weight[k]
    # Documents without a label speak, with little weight each, against what is all over the place.
    spread = np.where(bad.sum(1) > 0, np.maximum(0, x.n_seen - clean - bad.sum(1)), 0)
    against = clean + BACKGROUND_WEIGHT * spread
    of = lambda rows: BlockMaxIndex(vectors.pick(rows), len(x.words.known))

    # Which passages of the positive documents are meant: in each, those with the highest share of positive documents around.
    # A passage known from clean documents as often as from others is not one of them.
    there = (bad.sum(1) > 0) | (clean > 0)
    some = np.flatnonzero((bad.sum(1) > 0) & (against <= bad.sum(1)))
    share = np.zeros(n)
    base = sum(x.weight[k] for k in bad_docs) / max(1, sum(x.weight[k] for k in docs))
    share[some] = _vote_on(x, some, there, bad, against, base, 0.5, near)[0].sum(1)
    meant = np.zeros_like(bad)
    for k in bad_docs:
        at = x.of_doc[k]
        if len(at) and (top := share[at].max()) >= max(0.5, base):
            meant[at[share[at] >= top - 0.1], x.verdict[k]] += x.weight[k]
    # Once more with what was found: of the other passages of positive documents nothing is known.
    some = np.flatnonzero(meant.sum(1) > 0)
    again, mass = _vote_on(x, some, there, meant, against, 0.0, FLOOR, near)
    # What the others say: without one document's own word.
    own = max((x.weight[k] for k in bad_docs), default=1.0)  # the same for all positive documents
    others = mass - own
    alone = (again.sum(1) * (mass + PRIOR_WEIGHT) - own) / np.maximum(others + PRIOR_WEIGHT, 1e-9)
    lonely = others < 0.5  # nothing else is near
    meant[some[(alone < 0.25) & ~lonely]] = 0
    meant[some[lonely]] *= np.where(x.listed[some[lonely]], *LONELY_WEIGHT)[:, None]
    for i, c in x.terms:
        meant[i, c] = max(meant[i, c], TERM_WEIGHT)
    kept = np.flatnonzero(meant.sum(1) > 0)
    used = np.flatnonzero((meant.sum(1) > 0) | (clean > 0))
    return Model(x.words, x.idf, of(kept), of(used), meant[used], against[used])


class Votes(NamedTuple):
    """Votes of the documents of the sample, from models that have seen neither their labels nor those of their copies."""

    vote: np.ndarray
    kind: np.ndarray
    evidence: list[str | None]


def cross_votes(spark: SparkSession, x: Examples, near: Near) -> Votes:
    """``FOLDS`` models, each fitted in a task of its own without the documents of a fold, which it then votes on."""
    fold = fold_of(copies(x.of_doc), FOLDS)
    shared = _shared(spark, (x, fold, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                x, fold, near = shared()
                model = learn(x, fold == k, near)
                docs = np.flatnonzero(fold == k)
                if model is None or not len(docs):
                    continue
                passage = np.unique(np.concatenate([x.of_doc[d] for d in docs]))
                score, kind = np.zeros(len(x.texts)), np.zeros(len(x.texts), np.int64)
                for part in np.split(passage, range(_SEARCHED, len(passage), _SEARCHED)):
                    if len(part):
                        score[part], kind[part] = model.search(x.vectors.pick(part))
                best = np.array([x.of_doc[d][score[x.of_doc[d]].argmax()] if len(x.of_doc[d]) else -1 for d in docs])
                hit = (best >= 0) & (score[best] > 0)
                docs, best = docs[hit], best[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int32()), pa.array(score[best]), pa.array(kind[best], pa.int32()), x.texts.take(pa.array(best))], ["doc", "vote", "kind", "evidence"]
                )

    n = len(x.of_doc)
    out = Votes(np.zeros(n), np.zeros(n, np.int64), [None] * n)
    for r in spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "doc int, vote double, kind int, evidence string").collect():  # a row a document of the sample
        out.vote[r["doc"]], out.kind[r["doc"]], out.evidence[r["doc"]] = r["vote"], r["kind"], r["evidence"]
    return out


def _contain(texts: pa.Array, folded: list[str]) -> np.ndarray:
    """Whether a passage contains one of the terms as whole words."""
    if not folded:
        return np.zeros(len(texts), bool)
    pattern = r"\b(?:" + "|".join(map(re.escape, sorted(set(folded)))) + r")\b"
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool)


def read_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, source, passages`` of every document, written once: folded words joined by blanks, each passage once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[" ".join(p) for p in passages(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(found, pa.list_(pa.string()))], ["doc_id", "source", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("source"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(read, "doc_id long, source string, passages array<string>"), "passages")


def labelled_sample(read: DataFrame, labels: DataFrame) -> list[Labelled]:
    """Labelled documents, chosen by a hash up to the bounds. Other verdicts, and a tie of verdicts, are no label.

    Each stands for as many documents of its class as were labelled for one chosen, so the balance of the classes is that of all labels.
    """
    verdict = F.lower(F.trim("verdict"))
    per_doc = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), verdict.alias("v"))
        .where(F.col("v").isin("ok", *VERDICTS))
        .groupBy("doc_id")
        .agg(F.sum(F.when(F.col("v") == "ok", 1).otherwise(0)).alias("n_ok"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("v") != "ok", F.col("v"))).alias("verdict"))
        .where("n_ok * 2 <> n and doc_id is not null")
        .withColumn("verdict", F.when(F.col("n_ok") * 2 > F.col("n"), "").otherwise(F.col("verdict")))
    )
    some = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(per_doc.where("verdict <> ''"), MAX_POSITIVE).unionByName(some(per_doc.where("verdict = ''"), MAX_CLEAN))
    rows = read.select("doc_id", "passages").join(F.broadcast(chosen.select("doc_id", "verdict")), "doc_id").orderBy("doc_id", F.to_json("passages"))
    n = per_doc.agg(F.count_if(F.col("verdict") != "").alias("bad"), F.count_if(F.col("verdict") == "").alias("clean")).first()
    bad, clean = max(1.0, n["bad"] / MAX_POSITIVE), max(1.0, n["clean"] / MAX_CLEAN)
    # A repeated document counts once; the sample is bounded, so is what the driver gets.
    t = rows.select("doc_id", "verdict", "passages").toArrow().combine_chunks()
    ids, verdicts, lists = t["doc_id"].to_pylist(), t["verdict"].to_pylist(), t["passages"]
    once = {d: i for i, d in enumerate(ids)}
    return [Labelled(verdicts[i], lists[i].values, bad if verdicts[i] else clean, d) for d, i in once.items()]


def _shared(spark, value):
    """A broadcast whose classes travel with it; call it on an executor to get the value, unpacked once a worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(sent, "unpacked"):  # a worker has one object for each broadcast
            sent.unpacked = cloudpickle.loads(sent.value)
        return sent.unpacked

    return get


def term_examples(terms: DataFrame) -> list[Labelled]:
    """Listed terms of some severity as examples; rows with a null or an unknown category are left out."""
    rows = terms.select("term", F.lower(F.trim("category")).alias("category")).where((F.col("severity") >= TERM_SEVERITY) & F.col("category").isin(*VERDICTS) & F.col("term").isNotNull())
    return [Labelled(r["category"], [" ".join(p) for p in passages(r["term"])]) for r in rows.distinct().orderBy("category", "term").collect()]


def word_documents(read: DataFrame, words: Words, sample: Iterable[Labelled] = ()) -> tuple[np.ndarray, Seen]:
    """Number of documents with each known word, and with each passage of a positive document of the sample, over all documents."""
    positive = [d.texts() for d in sample if d.verdict]
    wanted = pa.concat_arrays(positive).unique() if positive else pa.array([], pa.string())
    shared = _shared(read.sparkSession, (words, wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared()
        n = len(known.known)
        number = {p: i for i, p in enumerate(wanted.to_pylist())}
        total, found = np.zeros(n, np.int64), np.zeros(len(number), np.int64)
        for b in batches:
            step = max(1, _MARKS // max(1, n))
            for i in range(0, b.num_rows, step):
                texts, doc = _flat(b.slice(i, step))
                if len(texts):
                    start, ids = known.encode(texts)
                    seen = np.zeros((int(doc[-1]) + 1, n + 1), bool)
                    seen[np.repeat(doc, np.diff(start)), ids] = True
                    total += seen[:, :n].sum(0)
                    if number:
                        hit = [k for p in texts.to_pylist() if (k := number.get(p)) is not None]
                        np.add.at(found, np.array(hit, np.int64), 1)
        both = np.r_[total, found]
        used = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(both[used])], ["item", "n"])

    out = np.zeros(len(words.known) + len(wanted), np.int64)
    for r in read.select("passages").mapInArrow(count, "item int, n long").groupBy("item").agg(F.sum("n").alias("n")).collect():
        out[r["item"]] = r["n"]
    return out[: len(words.known)], Seen(wanted, out[len(words.known) :])


def _flat(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All passages of a batch, and the place of the document of each."""
    lists = b["passages"]
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(n)), n)


class Learned(NamedTuple):
    read: DataFrame
    sample: list[Labelled]
    examples: Examples
    near: Near
    votes: Votes
    calibration: Calibration


def _learned(docs: DataFrame, labels: DataFrame, terms: DataFrame | None) -> Learned:
    read = read_passages(docs)
    sample = labelled_sample(read, labels)
    listed = term_examples(terms) if terms is not None else []
    words = learn_words([*sample, *listed])
    frequency, seen = word_documents(read, words, sample)
    x = Examples.of(sample, words, frequency, read.count(), listed, seen)
    near = near_passages(read.sparkSession, x)
    votes = cross_votes(read.sparkSession, x, near)
    return Learned(read, sample, x, near, votes, Calibration.fitted(votes.vote, x.verdict >= 0, x.weight))


def _mark(texts: pa.Array) -> bytes:
    """Tells the texts of a document from those of another row with its number."""
    return hashlib.blake2b("\n".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def scores(docs: DataFrame, labels: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, score, score_low, score_high, verdict, evidence`` for every document.

    ``docs``: ``doc_id, source, text``; ``labels``: ``doc_id, verdict``; ``terms``: a
    short list, ``term, category, severity``, which is collected. ``score``, between 0
    and 1, is the expected share of positive ones among all documents with such a vote:
    their share among labelled ones, less what these are over-represented there.
    ``score_low`` and ``score_high`` are the ends of its interval of 95 %, which is
    wide where labels are few. ``verdict`` and ``evidence`` (the folded passage) are
    null where no positive example is near; the score is 0 there. A document of the
    labelled sample is voted on by a model that has not seen its label, nor those of
    its copies. Null and empty texts have score 0. Repeated rows are scored each. Of
    equal passages the first is the evidence. Other columns are not read. Without a
    positive label or term all scores are 0. An empty table gives no rows.
    """
    found = _learned(docs, labels, terms)
    model, read = learn(found.examples, None, found.near), found.read
    own = {
        d.doc_id: (_mark(d.texts()), min(float(v), 1.0), int(k), e) for d, v, k, e in zip(found.sample, *found.votes, strict=True)
    }
    shared = _shared(read.sparkSession, (model, own))
    del model, own

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared()
        for b in batches:
            best, kind, proof = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.full(b.num_rows, -1)
            texts, doc = _flat(b)
            labelled = [(i, own[d]) for i, d in enumerate(b["doc_id"].to_pylist()) if d in own and _mark(b["passages"][i].values) == own[d][0]]
            open_ = np.ones(b.num_rows, bool)
            open_[[i for i, _ in labelled]] = False
            if len(texts) and model is not None:
                rows = np.flatnonzero(open_[doc])
                s, k = model.score(texts.take(pa.array(rows)))
                by = np.lexsort((-np.arange(len(s)), s))  # the highest, and of those the first, is written last
                best[doc[rows[by]]], kind[doc[rows[by]]], proof[doc[rows[by]]] = np.minimum(s[by], 1.0), k[by], rows[by]
            evidence = texts.take(pa.array(proof, mask=best <= 0)).to_pylist() if labelled else None
            for i, (_, v, k, e) in labelled:
                best[i], kind[i], evidence[i] = v, k, e
            none = best <= 0
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    b["source"],
                    pa.array(best),
                    pa.array(VERDICTS, pa.string()).take(pa.array(kind, mask=none)),
                    texts.take(pa.array(proof, mask=none)) if evidence is None else pa.array(evidence, pa.string()),
                ],
                ["doc_id", "source", "vote", "verdict", "evidence"],
            )

    voted = materialize(read.mapInArrow(score, "doc_id long, source string, vote double, verdict string, evidence string"), "votes")
    counts = voted.groupBy(F.ceil(F.col("vote") * VOTE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # VOTE_BINS rows at most
    bins, n = (np.array([r[c] for r in counts], float) for c in ("bin", "n"))
    labelled = found.votes.vote, found.examples.verdict >= 0, found.examples.weight
    calibration = found.calibration.for_all(*labelled, np.where(bins > 0, (bins - 0.5) / VOTE_BINS, 0.0), n)
    at = np.arange(VOTE_BINS + 1)
    level = [np.where(at > 0, x, 0.0) for x in calibration.interval((at - 0.5) / VOTE_BINS)]
    names = ["score", "score_low", "score_high"]
    table = docs.sparkSession.createDataFrame(pa.table([pa.array(at), *map(pa.array, level)], ["bin", *names]))  # a row a bin
    scored = voted.withColumn("bin", F.ceil(F.col("vote") * VOTE_BINS)).join(F.broadcast(table), "bin")
    return scored.select("doc_id", "source", *names, "verdict", "evidence")


def calibration_table(docs: DataFrame, labels: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """How far scores can be taken as shares: ``low, high, n_labelled, mean_score, positive_share``, a row per tenth that occurs.

    Over the labelled sample, voted on without the own labels; the calibration of one
    half is tested on the other. Documents with no example near have score 0.
    """
    found = _learned(docs, labels, terms)
    rows = reliability(found.votes.vote, found.examples.verdict >= 0, found.examples.weight)
    return docs.sparkSession.createDataFrame(rows, "low double, high double, n_labelled long, mean_score double, positive_share double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_docs, n_flagged, n_sure, flagged_share, mean_score``; a null source has a row of its own.

    ``n_sure`` counts documents whose whole interval lies at or above the threshold:
    far fewer than ``n_flagged`` where labels are too few to rely on the rate.
    """
    hit, sure = (F.when(F.col(c) >= threshold, 1).otherwise(0) for c in ("score", "score_low"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_flagged"), F.sum(sure).alias("n_sure"), F.avg(hit).alias("flagged_share"), F.avg("score").alias("mean_score")
    )
