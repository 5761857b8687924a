"""Toxic spans and scores by a linear-chain conditional random field.

Documents carry one label each, so tokens are labelled first: *stems* (beginnings of words, or whole
words) are picked greedily that explain toxic documents with few clean ones, each time among
the toxic documents that few picked stems explain; a token is toxic if its document is and it
has a picked stem. A two-state chain over the words of each sentence is trained on these
tokens. Forward-backward marginals of every token of a whole text give its offending spans, and,
aggregated, the document's score by a logistic fit to the documents' labels.

Words are runs of ASCII letters and of bytes from 0x80 on, in lower case; sentences end at
``. ! ?`` and line ends. Training takes a bounded sample of labelled rows to one task; tagging
runs where the texts are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.crf import Chains, marginals, train
from sheaf.llm.textbytes import Chunk, lut, mix, text_chunks
from sheaf.llm.textstats import held_out, labelled_sample

_TOKEN = lut("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)
_STOP = lut(".!?\n")
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80

STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
"""Code points of the beginnings of words that may become stems; whole words may too. A stem's length stands in the
last four bits of its hash."""

_LENGTH = np.uint64(15)
_ANY = ~_LENGTH


@dataclass(frozen=True)
class Tagging:
    """``sample``: labelled rows at most; ``picked``: toxic stems at most; ``support``: unexplained toxic texts that a
    stem needs; ``precision``: share of toxic ones among its texts; ``words``: words with weights of their own;
    ``plain``: one in so many sentences without a stem trains the chain, and all with one do; ``cover``: stems that explain a document."""
    sample: int = 5000
    picked: int = 200
    support: int = 4
    precision: float = 0.65
    words: int = 5000
    plain: int = 4
    cover: int = 2
    cut: float = 0.5


@dataclass(frozen=True)
class Tagger:
    """``stems`` per length (0: whole words) and ``words``: ascending hashes; ``weights``: per stem in the order of
    lengths, then per word, then one for all other tokens; ``logistic``: weights of a document's features."""
    stems: dict[int, np.ndarray] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.full(1, -10.0))
    transition: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    logistic: np.ndarray | None = None

    def symbols(self, t: "Tokens") -> np.ndarray:
        """Index of the weight of each token: its longest stem's, else its word's, else the last one."""
        n = sum(len(s) for s in self.stems.values())
        out = n + places(self.words, t.word)
        base = 0
        for length, stems in sorted(self.stems.items(), key=lambda x: x[0] or 99):
            row, h = t.stems(length)
            at = places(stems, h)
            hit = at < len(stems)
            out[row[hit]] = base + at[hit]
            base += len(stems)
        return out

    def marginals(self, t: "Tokens") -> np.ndarray:
        return marginals(np.exp(self.weights)[self.symbols(t)], self.transition, t.chains())

    def scores(self, p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(docs)
        return 1 / (1 + np.exp(-np.clip(aggregates(p, doc, docs) @ self.logistic, -50, 50)))


def places(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash among ascending ones, or their number for others."""
    if not len(words):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, len(words))


class Tokens:
    """The words of a chunk: starts, ends, per document, whether each begins a sentence, and hashes."""

    def __init__(self, c: Chunk):
        self.s, self.e, self.per_doc = c.spans(_TOKEN[c.data])
        stops = np.concatenate([[0], np.cumsum(_STOP[c.data])])[self.s]
        self.doc = np.repeat(np.arange(len(c)), self.per_doc)
        self.first = np.ones(len(self.s), bool)
        self.first[1:] = (stops[1:] != stops[:-1]) | (self.doc[1:] != self.doc[:-1])
        whole = ~_CONTINUATION[c.data]
        self.char_at = np.append(np.flatnonzero(whole), len(c.data))
        self.points = np.concatenate([[0], np.cumsum(whole)])
        self.hash = c.folded().hasher()
        self.word = self.hash(self.s, self.e)

    def stems(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have so many code points, and the hashes of their beginnings; 0: all tokens, as whole words."""
        if not length:
            return np.arange(len(self.s)), mix(self.word + np.uint64(1)) & _ANY
        after = self.char_at[np.minimum(self.points[self.s] + length, len(self.char_at) - 1)]
        row = np.flatnonzero((after <= self.e) & (self.points[self.e] - self.points[self.s] >= length))
        return row, self.hash(self.s[row], after[row]) & _ANY | np.uint64(length)

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, stem hash) of all stems of all lengths, each pair once."""
        found = [self.stems(n) for n in (0, *STEM_LENGTHS)]
        doc, h = np.concatenate([self.doc[r] for r, _ in found]), np.concatenate([h for _, h in found])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return doc[new], h[new]

    def chains(self) -> Chains:
        return chains_of(self.first)


def chains_of(first: np.ndarray) -> Chains:
    start = np.flatnonzero(first)
    return Chains(start, np.diff(np.append(start, len(first))))


def aggregates(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Features of documents from marginals: 1, the largest, and log1p of the expected toxic tokens and of the likely ones."""
    top = np.zeros(docs)
    np.maximum.at(top, doc, p)
    likely = p > 0.2
    return np.stack([np.ones(docs), top, np.log1p(np.bincount(doc[likely], p[likely], docs)),
                     np.minimum(np.bincount(doc[p > 0.5], minlength=docs), 3.0)], 1)


def pick_stems(owner: np.ndarray, at: np.ndarray, stems: np.ndarray, in_clean: np.ndarray, params: Tagging) -> list[int]:
    """Hashes of stems that explain toxic documents, greedily by support among those not yet explained, longest first among equals.

    ``owner`` and ``at``: toxic document and index of each of its stems; ``in_clean``: clean documents with each stem.
    """
    size = (stems & _LENGTH).astype(int)
    size[size == 0] = max(STEM_LENGTHS) + 1
    needs, out = np.full(int(owner.max()) + 1 if len(owner) else 0, params.cover), []
    while len(stems) and len(out) < params.picked:
        new = np.bincount(at[needs[owner] > 0], minlength=len(stems))
        new[[k for k, _ in out]] = 0
        worth = np.where((new >= params.support) & (new >= params.precision * (new + in_clean)),
                         new * (new / np.maximum(new + in_clean, 1)) ** 2, 0)
        ties = np.flatnonzero(worth == worth.max())
        k = int(ties[np.lexsort((stems[ties], -size[ties]))[0]])
        if not worth[k]:
            break
        out.append((k, int(stems[k])))
        needs[owner[at == k]] -= 1
    return [h for _, h in out]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def learn(docs: DataFrame, labels: DataFrame, params: Tagging = Tagging()) -> Tagger:
    """A tagger from at most ``params.sample`` labelled rows outside the held-out fifth; without toxic ones it tags none.

    A task trains it: only the tagger comes to the driver, neither the texts nor the memory that training takes.
    """
    sample = labelled_sample(labels, "toxic", params.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select(
        "text", "label")
    # copies of a text would count as so many witnesses
    found = rows.groupBy("text").agg(F.max("label").alias("label"))

    def train_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            tagger = train_tagger(t.column("text"), t.column("label").to_numpy() == 1, params)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger)], pa.binary())], ["tagger"])

    made = found.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text").mapInArrow(train_one, "tagger binary").collect()
    return pickle.loads(made[0]["tagger"]) if made else Tagger()


def train_tagger(texts: pa.ChunkedArray, toxic: np.ndarray, params: Tagging = Tagging()) -> Tagger:
    """A tagger from different texts and their labels."""
    owner, flat, every = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for row, c in text_chunks(texts):
        t = Tokens(c)
        doc, h = t.units()
        of_toxic = toxic[row + doc]
        owner.append(row + doc[of_toxic])
        flat.append(h[of_toxic])
        every.append(t.word)
    owner, flat, every = np.concatenate(owner), np.concatenate(flat), np.concatenate(every)
    stems, at, hits = np.unique(flat, return_inverse=True, return_counts=True)
    often = hits >= params.support
    owner, at, stems = owner[often[at]], (np.cumsum(often) - 1)[at[often[at]]], stems[often]
    in_clean = np.zeros(len(stems) + 1, np.int64)
    for row, c in text_chunks(texts):
        doc, h = Tokens(c).units()
        in_clean += np.bincount(places(stems, h[~toxic[row + doc]]), minlength=len(stems) + 1)
    picked = np.array(pick_stems(owner, at, stems, in_clean[:-1], params), np.uint64)
    if not len(picked):
        return Tagger()
    stems = {int(n): np.sort(picked[picked & _LENGTH == n]) for n in np.unique(picked & _LENGTH)}
    every, count = np.unique(every, return_counts=True)
    words = np.sort(every[np.lexsort((every, -count))[: params.words]])
    start = Tagger(stems, words)
    parts = []
    for row, c in text_chunks(texts):
        t = Tokens(c)
        symbol, chains = start.symbols(t).astype(np.int32), t.chains()
        chain = np.cumsum(t.first) - 1
        told = np.zeros(len(chains.start), bool)
        told[chain[symbol < len(picked)]] = True
        use = told | (np.arange(len(told)) % params.plain == 0)
        use = use[chain] if len(chain) else np.zeros(0, bool)
        parts.append((symbol[use], (toxic[row + t.doc[use]] & (symbol[use] < len(picked))).astype(np.int8), t.first[use]))
    symbol, label, first = (np.concatenate(x) for x in zip(*parts))
    weights, transition = train(symbol, label, chains_of(first), len(picked) + len(words) + 1)
    tagger = Tagger(stems, words, weights, np.exp(transition))
    rows = [aggregates(tagger.marginals(t), t.doc, len(c)) for _, c in text_chunks(texts) for t in [Tokens(c)]]
    return replace(tagger, logistic=_logistic(np.concatenate(rows), toxic.astype(float)))


def tag(docs: DataFrame, tagger: Tagger, cut: float = 0.5, keep: bool = False) -> DataFrame:
    """doc_id, score, spans: array of (start, length) in code points of the words tagged toxic, neighbours joined.

    With ``keep`` the columns of ``docs`` stay as they are and score and spans replace any of these names.
    """
    rest = [c for c in docs.columns if c not in ("score", "spans")] if keep else ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for _, c in text_chunks(b.column(b.num_columns - 1)):
                t = Tokens(c)
                p = tagger.marginals(t)
                scores.append(tagger.scores(p, t.doc, len(c)))
                found: list[list[dict]] = [[] for _ in range(len(c))]
                last = -2
                for k in np.flatnonzero(p >= cut).tolist():
                    d = int(t.doc[k])
                    start, end = (int(t.points[x] - t.points[c.starts[d]]) for x in (t.s[k], t.e[k]))
                    if k == last + 1 and not t.first[k]:
                        found[d][-1]["length"] = end - found[d][-1]["start"]
                    else:
                        found[d].append({"start": start, "length": end - start})
                    last = k
                spans.extend(found)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                 pa.array(spans, kind)], [*b.schema.names[:-1], "score", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    picked = docs.select(*rest, F.col("text").alias("_tagged"))
    types = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{types}, score double, spans array<struct<start:long,length:long>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: Tagging = Tagging()) -> tuple[DataFrame, Tagger]:
    """doc_id, held_out, score, predicted (1 if score >= params.cut), spans: one row per input row; and the tagger.

    Only the text is scored. ``labels`` has doc_id and toxic (0 or 1). A null or empty text is scored like one
    without toxic words and has no spans; repeated rows give repeated rows; ties cannot matter; an empty table gives
    no rows. Without toxic labels every score is 0.
    """
    tagger = learn(docs, labels, params)
    out = tag(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tagger, params.cut)
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= params.cut).cast("int").alias("predicted"), "spans"), tagger
