"""Language ID by a linear-chain conditional random field over the words of a text.

A word's features are its prefixes and suffixes, its character trigrams and, for words frequent in the training
texts, the word itself (the lexicon). The field has learned transitions between languages, so a text may switch
language; forward-backward gives each word's distribution, and a text's language is the one with the largest
mean over its words, that mean being the score.

Training takes the first CHARS_PER_DOC characters of at most DOCS_PER_LABEL documents of each language (those of the
least hash of doc_id, out of the documents that are not held out), cuts them into runs of words, at most RUNS in all,
and splices runs of different languages into sequences, which is where the transitions come from. All languages are
learned. Prediction reads whole texts.

Null texts and texts without letters are `und` with score 0, as are all texts if nothing could be learned.
Words without a letter have no say. Equal texts get equal results; ties go to the first language by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches

#: The bounds of the training sample: documents of each language, characters of a document, runs of words of all
#: languages together (fewer beyond 16 languages, so that training takes no more memory).
DOCS_PER_LABEL, CHARS_PER_DOC, RUNS = 120, 20_000, 12_000
#: Parts of a language that are ranked by themselves first.
SALTS = 64
#: Words of a spliced run, and of a training sequence.
RUN, SEQUENCE = 24, 96
#: A feature or a lexicon word must occur in so many distinct words or so often.
LEAST_WORDS, LEAST_COUNT = 3, 5
#: Words of a block in inference; blocks are exact, not windows.
BLOCK = 32
#: What commonly stands around a word; other characters that are not letters are dropped too, only slower.
EDGES = ".,;:!?\"'()[]{}|#$%&*-_<>/0123456789"
#: Characters of texts handled together, and scores of words remembered in a task.
TOGETHER, REMEMBERED = 500_000, 1_000_000
#: Numbers of the blocks' matrices at a time; texts that need more go word by word, with the same result.
MOST_CARRIED = 8_000_000


def bare(token: str) -> str:
    """A token's letters in lower case."""
    if token.isalpha():
        return token.lower()
    inner = token.strip(EDGES)
    return inner.lower() if inner.isalpha() else "".join(filter(str.isalpha, token)).lower()


def features(word: str) -> list[str]:
    """Character trigrams of a word with its edges marked, its affixes, and the word; each with its kind's mark."""
    wrapped = f"<{word}>"
    found = [wrapped[i : i + 3] for i in range(len(wrapped) - 2)]
    return [*found, "<" + word[:1], "<<" + word[:3], word[-1:] + ">", word[-3:] + ">>", "=" + word]


@dataclass
class Model:
    """Languages, feature weights (feature to a row of one weight per language) and transition weights."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; unknown features weigh nothing."""
        padded = np.concatenate([self.weights, np.zeros((1, len(self.labels)))])
        get, none, flat, starts = self.index.get, len(self.weights), [], []
        for word in words:
            starts.append(len(flat))
            flat += [get(f, none) for f in features(word)]
        return np.add.reduceat(padded[flat], starts, axis=0) if words else np.empty((0, len(self.labels)))


# ---- training


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_label: int = DOCS_PER_LABEL) -> list[tuple[str, str]]:
    """(text, language) of the training sample; only ids and languages are ranked, texts are read for the chosen."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    each = usable.select("doc_id", "lang", F.pmod(spread, F.lit(SALTS)).alias("salt")).distinct()
    # First within parts of a language, so that no task ranks what all partitions hold of one.
    for parts in (("lang", "salt"), ("lang",)):
        each = each.withColumn("at", F.row_number().over(W.partitionBy(*parts).orderBy(spread, "doc_id"))).where(F.col("at") <= per_label)
    ranked = each
    order = {(r.doc_id, r.lang): (r.at, r.lang) for r in ranked.collect()}
    if not order:
        return []
    texts = usable.where(F.col("doc_id").isin([d for d, _ in order])).groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, CHARS_PER_DOC)).alias("text"))
    rows = [r for r in texts.collect() if (r.doc_id, r.lang) in order]
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: order[r.doc_id, r.lang])]


def fit(docs: DataFrame, per_label: int = DOCS_PER_LABEL, steps: int = 40) -> Model | None:
    """A model of the labelled documents that are not held out, or None if there are none."""
    return fit_rows(sample(docs, per_label), steps)


def fit_rows(rows: list[tuple[str, str]], steps: int = 40) -> Model | None:
    """Maximum likelihood by Adam over the spliced sequences."""
    runs: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        words = [w for w in map(bare, text.split()) if w]
        runs.setdefault(lang, []).extend(words[i : i + RUN] for i in range(0, len(words), RUN))
    runs = {k: v for k, v in runs.items() if v}
    if not runs:
        return None
    labels = sorted(runs)
    most = max(1, min(max(len(runs[k]) for k in labels), RUNS * min(1, 16 / len(labels)) // len(labels)))
    order = np.random.default_rng(7).permutation([(k, i) for k in range(len(labels)) for i in range(int(most))])
    tokens, gold = [], []
    for k, i in order.tolist():
        run = runs[labels[k]][i % len(runs[labels[k]])]
        tokens += run
        gold += [k] * len(run)
    n = max(1, len(tokens) // SEQUENCE)
    short = n * SEQUENCE - len(tokens)
    tokens, gold = (tokens * (1 + max(0, short)))[: n * SEQUENCE], (gold * (1 + max(0, short)))[: n * SEQUENCE]
    counts = Counter(tokens)
    words = sorted(counts)
    number = {w: i for i, w in enumerate(words)}
    in_words = Counter(f for w in words for f in features(w))
    kept = sorted(f for f, c in in_words.items() if (counts[f[1:]] >= LEAST_COUNT if f[0] == "=" else c >= LEAST_WORDS))
    index = {f: i for i, f in enumerate(kept)}
    pairs = [(number[w], index[f]) for w in words for f in features(w) if f in index]
    of_word, of_feature = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    x = np.array([number[t] for t in tokens]).reshape(n, SEQUENCE)
    y = np.array(gold).reshape(n, SEQUENCE)
    size, most_words = len(labels), len(words)
    eye = np.eye(size)
    weights, moves = np.zeros((len(kept), size)), np.zeros((size, size))
    observed = np.bincount(y[:, :-1].ravel() * size + y[:, 1:].ravel(), minlength=size * size).reshape(size, size)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, moves)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(of_word, weights[of_feature, k], most_words) for k in range(size)], 1)
        marginals, expected = _expectations(scores[x], moves)
        residual = (marginals - eye[y]).reshape(-1, size)
        by_word = np.stack([np.bincount(x.ravel(), residual[:, k], most_words) for k in range(size)], 1)
        by_feature = np.stack([np.bincount(of_feature, by_word[of_word, k], len(kept)) for k in range(size)], 1)
        for w, gradient, (m, v) in zip((weights, moves), ((by_feature + weights) / n, (expected - observed + moves) / n), state, strict=True):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, weights, moves)


def _expectations(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and expected transitions of sequences of equal length."""
    n, length, size = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(moves - moves.max())
    forward = np.empty_like(emit)
    at = emit[:, 0]
    forward[:, 0] = at = at / at.sum(1, keepdims=True)
    for t in range(1, length):
        at = (at @ move) * emit[:, t]
        forward[:, t] = at = at / at.sum(1, keepdims=True)
    marginals, back, expected = np.empty_like(emit), np.ones((n, size)), np.zeros((size, size))
    for t in range(length - 1, -1, -1):
        both = forward[:, t] * back
        marginals[:, t] = both / both.sum(1, keepdims=True)
        if t:
            ahead = emit[:, t] * back
            back = ahead @ move.T
            norm = (forward[:, t - 1] * back).sum(1, keepdims=True)
            expected += move * (forward[:, t - 1].T @ (ahead / norm))
            back /= back.sum(1, keepdims=True)
    return marginals, expected


# ---- inference


def posteriors(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Each word's distribution, for texts laid end to end; emit has positive scores, lengths are words a text.

    The words of a text are cut into blocks. The product of a block's transfer matrices carries the forward
    and backward messages across it, so that all blocks of all texts then run side by side, with the result of
    one pass over each whole text.
    """
    size = emit.shape[1]
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    text_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.repeat(first * BLOCK - text_at, lengths) + np.arange(len(emit))
    e = np.ones((total * BLOCK, size))
    e[place] = emit
    real = np.zeros(total * BLOCK, bool)
    real[place] = True
    e = np.ascontiguousarray(e.reshape(total, BLOCK, size).swapaxes(0, 1))
    real = np.ascontiguousarray(real.reshape(total, BLOCK).T)
    # A block's matrix takes the message at the word before it to the message at its last word.
    carry = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(BLOCK):
        on = real[t]
        if not on.any():
            break
        step = (carry[on].reshape(-1, size) @ move).reshape(-1, size, size) * e[t, on][:, None, :]
        carry[on] = step / step.max((1, 2), keepdims=True)
    start, finish = np.ones((total, size)), np.ones((total, size))
    texts = np.flatnonzero(blocks > 1)
    k = 1
    while len(texts):
        b = first[texts] + k
        before = start[b - 1]
        message = np.einsum("bi,bij->bj", before, carry[b - 1]) if k > 1 else _through(e, real, b - 1, move)
        start[b] = message / message.sum(1, keepdims=True)
        k += 1
        texts = texts[blocks[texts] > k]
    texts = np.flatnonzero(blocks > 1)
    back = 1
    while len(texts):
        b = first[texts] + blocks[texts] - 1 - back
        message = np.einsum("bij,bj->bi", carry[b + 1], finish[b + 1])
        finish[b] = message / message.sum(1, keepdims=True)
        back += 1
        texts = texts[blocks[texts] > back]
    opening = np.zeros(total, bool)
    opening[first[lengths > 0]] = True
    forward, at = np.empty_like(e), start
    for t in range(BLOCK):
        step = at @ move
        if t == 0:
            step[opening] = 1.0
        step *= e[t]
        step /= step.sum(1, keepdims=True)
        at = np.where(real[t][:, None], step, at)
        forward[t] = at
    at = finish
    for t in range(BLOCK - 1, -1, -1):
        both = forward[t] * at
        forward[t] = both / both.sum(1, keepdims=True)
        step = (e[t] * at) @ move.T
        step /= step.sum(1, keepdims=True)
        at = np.where(real[t][:, None], step, at)
    return forward.swapaxes(0, 1).reshape(-1, size)[place]


def _through(e: np.ndarray, real: np.ndarray, blocks: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The message at the last word of texts' first blocks."""
    at = e[0, blocks]
    for t in range(1, BLOCK):
        at = np.where(real[t, blocks][:, None], (at @ move) * e[t, blocks], at)
        at = at / at.sum(1, keepdims=True)
    return at


def one_by_one(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """As posteriors, for one text, in memory of the size of its scores."""
    out, at = np.empty_like(emit), np.ones(emit.shape[1])
    for t in range(len(emit)):
        at = (at @ move if t else at) * emit[t]
        out[t] = at = at / at.sum()
    at = np.ones(emit.shape[1])
    for t in range(len(emit) - 1, -1, -1):
        out[t] *= at
        out[t] /= out[t].sum()
        at = move @ (emit[t] * at)
        at /= at.sum()
    return out


class Tagger:
    """Applies a model; made anew in each task, so that nothing stays in a worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.size = model, len(model.labels)
        self.move = np.exp(model.transitions - model.transitions.max())
        self.number: dict[str, int] = {}
        self.emit = np.empty((0, self.size))
        self.lettered = np.empty(0, bool)

    def _learn(self, tokens: set[str]) -> None:
        order = list(tokens)
        words = list(map(bare, order))
        self.number.update(zip(order, range(len(self.number), len(self.number) + len(order)), strict=True))
        lettered = np.array(list(map(bool, words)), bool)
        scores = self.model.emissions(words) * lettered[:, None]
        self.emit = np.concatenate([self.emit, np.exp(scores - scores.max(1, keepdims=True)) + 1e-12]) if len(order) else self.emit
        self.lettered = np.concatenate([self.lettered, lettered])

    def _posteriors(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.empty((0, self.size))
        if (len(ids) // BLOCK + len(lengths)) * self.size**2 <= MOST_CARRIED:
            return posteriors(self.emit[ids], lengths, self.move)
        ends = np.cumsum(lengths)
        return np.concatenate([one_by_one(self.emit[ids[e - n : e]], self.move) for e, n in zip(ends, lengths, strict=True) if n])

    def tag(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Each text's words, which of them have letters, and their distributions."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
                size += len(texts[stop])
                stop += 1
            cut = [x.split() for x in texts[at:stop]]
            if len(self.number) * self.size > REMEMBERED:
                self.number, self.emit, self.lettered = {}, np.empty((0, self.size)), np.empty(0, bool)
            self._learn(set().union(*cut).difference(self.number))
            ids = np.array([i for words in cut for i in map(self.number.__getitem__, words)], np.int64)
            lengths = np.array([len(words) for words in cut])
            each = self._posteriors(ids, lengths)
            lettered, done = self.lettered[ids], 0
            for words in cut:
                yield words, lettered[done : done + len(words)], each[done : done + len(words)]
                done += len(words)
            at = stop

    def languages(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """Each text's language and score."""
        for _, lettered, each in self.tag(texts):
            if lettered.any():
                mean = np.round(each[lettered].mean(0), 9)
                best = int(mean.argmax())
                yield self.model.labels[best], float(min(1.0, max(0.0, mean[best])))
            else:
                yield "und", 0.0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred and score added (columns of these names are replaced; all others may have any name)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @F.pandas_udf("lang_pred string, score double")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for batch in batches:
            yield pd.DataFrame(list(tagger.languages([x or "" for x in batch])), columns=["lang_pred", "score"])

    # Marked so that a filter on its fields does not make Spark evaluate it once for each field.
    tag = "tag"
    while tag in docs.columns:
        tag += "_"
    out = docs.withColumn(tag, tagged.asNondeterministic()("text"))
    found = {"lang_pred": F.col(tag).getField("lang_pred"), "score": F.col(tag).getField("score")}
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in found), *(x.alias(c) for c, x in found.items()))


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the language of each of its words, array<struct<word, lang, p>>."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<word:string,lang:string,p:double>>")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)
        for batch in batches:
            rows = []
            for words, lettered, each in tagger.tag([x or "" for x in batch]):
                best = each.argmax(1)
                rows.append([{"word": w, "lang": tagger.model.labels[b] if on else "und", "p": float(p[b]) if on else 0.0} for w, on, p, b in zip(words, lettered, each, best, strict=True)])
            yield pd.Series(rows, dtype=object)

    return docs.select("doc_id", labelled("text").alias("words"))


def results(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
