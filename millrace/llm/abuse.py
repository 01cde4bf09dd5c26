"""Problem 10: abusive, hateful or sexual content.

A text is scored passage by passage (its sentences and lines), as one passage decides. A passage is a bag of words,
character n-grams of words and word pairs; their embeddings are averaged into a linear softmax over the classes, and
embeddings and softmax are trained jointly, in numpy, from zero embeddings, so what training never saw adds nothing. A
misspelt word shares most of its n-grams with the right one. Case, accents, look-alike characters, letters written apart
and digits for letters make no difference to a feature.

Labels are of documents and raters err. So training starts from all passages of a document under its raters' votes, and
then, in ROUNDS rounds, keeps of each marked document the passages that the last model finds (none at all, if the raters
erred), and leaves out passages of unmarked documents that the last model is sure of; the last model is one of the other
half of the documents. Training reads a bounded sample, chosen by a hash of the id: SAMPLE labelled documents and
UNLABELLED others, which count as unmarked at a low weight, with SAMPLE_CHARS characters at most. Texts are split into
words on the executors, where the fits run too, those of both halves side by side. All documents are scored.

A passage is stored as its words and word pairs, and each of these once with its features. So a step of training sums
the features of the distinct words of its passages, not those of every word.

After training, embeddings and softmax collapse to one number per feature and class, so scoring adds up known numbers.

Null and empty texts have score 0 and label none. Null labels don't count; a document without any label isn't trained
on. Without labels of at least two classes nothing can be trained: every score is null then. Repeated rows are scored
alike; a long text costs its length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import looks
from millrace.operators.joins import lookup_join
from millrace.session import cut

CLASSES = ("none", "abuse", "hate", "sexual")
#: Labelled documents that training reads at most, and their characters.
SAMPLE, SAMPLE_CHARS = 12_000, 100_000_000
#: Documents without labels that training reads at most, as examples of what ordinary passages look like, and the weight of their passages.
UNLABELLED, UNVOTED_WEIGHT = 2_000, 0.3
#: Passages of these that a model finds with at least this probability are left out of the next one, as nobody said that they are unmarked.
DOUBTED = 0.3
DIMENSIONS = 16
ROUNDS = 3
EPOCHS = 6
#: A document is marked if one of its passages is of another class than none with at least this probability.
THRESHOLD = 0.2
#: Passages of a marked document count as marked from this share of its worst score on.
GUILTY_SHARE = 0.85
#: Weight of a marked passage in training, against 1 for an unmarked one.
GUILTY_WEIGHT = 2.0
#: Words in a window of a long passage.
WINDOW = 12
_SEED = 11

_PASSAGE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+|(?:</?[a-zA-Z][^<>]{0,200}>)+")
_APART = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-])[^\W\d_](?:\1[^\W\d_](?![^\W_]))+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"(?<![^\s\"'(“«])(?=[^\s]*[^\W\d_])(?=[^\s]*[\d@$!])[^\W_][\w@$!]*[^\W_]|[@$][\w@$!]*[^\W\d_][\w@$!]*")
_MAYBE_APART = re.compile(r"\b\w[ .*_-]\w[ .*_-]")
_MAYBE_MIXED = re.compile(r"[^\W\d_][\d@$!]|[\d@$!][^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:[*'’][^\W\d_]*)*|\d[\d.,]*")


def passages(text: str | None) -> list[str]:
    return [p for p in (q.strip() for q in _PASSAGE.split(text)) if p] if text else []


def words(passage: str) -> list[str]:
    """Words of a passage in lower case with accents; numbers are '#'."""
    t = looks.key(passage)
    if _MAYBE_APART.search(t):
        t = _APART.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), t)
    if _MAYBE_MIXED.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_LEET) if sum(c.isalpha() for c in m[0]) * 2 >= len(m[0]) else m[0], t)
    return ["#" if w[0].isdigit() else w for w in _WORD.findall(t)]


def windows(n: int) -> list[tuple[int, int]]:
    """What is scored of a passage of n words: all of it, and of a long one also overlapping windows, as an insult may be appended without a full stop."""
    if n <= WINDOW + WINDOW // 3:
        return [(0, n)]
    return [(0, n), *((k, min(n, k + WINDOW)) for k in range(0, n - WINDOW // 2, WINDOW // 2))]


def word_features(word: str) -> list[str]:
    """The word without accents, its n-grams of 3 to 5 letters, and the accented word if it has accents."""
    if word == "#":
        return ["#"]
    bare = looks.unaccented(word).replace("’", "'")
    edged = f"<{bare}>"
    out = [edged, *(edged[k : k + n] for n in (3, 4, 5) for k in range(len(edged) - n + 1) if n < len(edged))]
    if bare != word:
        out.append("~" + word)
    return out


class Model:
    """Numbers per feature and class; a passage's logits are their mean over its features, plus the classes' own."""

    def __init__(self, vocabulary: dict[str, int], table: np.ndarray, bias: np.ndarray) -> None:
        self.__setstate__((vocabulary, table.astype(np.float32), bias.astype(np.float32)))

    def __getstate__(self) -> tuple:
        return self.vocabulary, self.table, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.vocabulary, self.table, self.bias = state
        self._known: dict[str, int] = {}
        self._bare: list[str] = []
        self._sums: list[np.ndarray] = []
        self._counts: list[int] = []

    def _word(self, w: str) -> int:
        """The number under which a word's sum is kept."""
        k = self._known.get(w)
        if k is None:
            f = word_features(w)
            ids = [i for x in f if (i := self.vocabulary.get(x)) is not None]
            k = self._known[w] = len(self._bare)
            self._bare.append(looks.unaccented(w))
            self._sums.append(self.table[ids].sum(0) if ids else np.zeros(self.table.shape[1], np.float32))
            self._counts.append(len(f))
        return k

    def probabilities(self, batch: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(windows x classes) and the passage of each window, from running sums over all words of the batch."""
        if len(self._known) > 200_000:
            self.__setstate__(self.__getstate__())
        ids: list[int] = []
        pairs: list[int] = []
        low, high, owner = [], [], []
        for k, p in enumerate(batch):
            own = [self._word(w) for w in words(p)]
            at = len(ids)
            for a, b in windows(len(own)):
                low.append(at + a)
                high.append(at + b)
                owner.append(k)
            bare = [self._bare[i] for i in own]
            get = self.vocabulary.get
            pairs += [get(f"{a} {b}", -1) for a, b in zip(bare, bare[1:])]
            pairs += [-1] * (len(own) > 0)
            ids += own
        lo, hi = np.asarray(low, np.int64), np.asarray(high, np.int64)
        n_classes = self.table.shape[1]
        if ids:
            i, j = np.asarray(ids), np.asarray(pairs)
            # double precision, as windows are differences of running sums
            word = np.cumsum(np.asarray(self._sums, np.float64)[i], axis=0)
            pair = np.cumsum(np.where(j[:, None] >= 0, self.table[j], 0).astype(np.float64), axis=0)
            count = np.cumsum(np.asarray(self._counts)[i])
            zero = np.zeros((1, n_classes))
            word, pair, count = np.r_[zero, word], np.r_[zero, pair], np.r_[0, count]
            inner = np.maximum(hi - 1, lo)  # a window's last word has no pair in it
            sums = word[hi] - word[lo] + pair[inner] - pair[lo]
            n = count[hi] - count[lo] + np.maximum(hi - lo - 1, 0)
        else:
            sums, n = np.zeros((len(lo), n_classes)), np.zeros(len(lo))
        z = sums / np.maximum(n, 1)[:, None] + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), np.asarray(owner, np.int64)


class Passages:
    """Passages as units: words and word pairs, each with its features; the numbers of all in four arrays."""

    def __init__(self, units: np.ndarray, length: np.ndarray, features: np.ndarray, unit_length: np.ndarray) -> None:
        self.units, self.length, self.features, self.unit_length = units, length, features, unit_length
        self.start, self.unit_start = np.r_[0, np.cumsum(length)], np.r_[0, np.cumsum(unit_length)]

    def __len__(self) -> int:
        return len(self.length)

    def __reduce__(self) -> tuple:
        return Passages, (self.units, self.length, self.features, self.unit_length)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of some passages, one behind the other, and how many each has."""
        return _slices(self.units, self.start, rows), self.length[rows]

    def means(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The mean of a table's rows over the features of each passage."""
        sums = np.add.reduceat(table[self.features], self.unit_start[:-1], axis=0)
        out = np.empty((len(rows), table.shape[1]), np.float32)
        for at in range(0, len(rows), 8192):
            units, n = self.of(rows[at : at + 8192])
            first = np.r_[0, np.cumsum(n)[:-1]]
            out[at : at + 8192] = np.add.reduceat(sums[units], first, axis=0) / np.add.reduceat(self.unit_length[units], first)[:, None]
        return out


def _slices(flat: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = start[rows + 1] - start[rows]
    return flat[np.repeat(start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


def numbered(passages_of_words: Sequence[Sequence[str]]) -> tuple[Passages, dict[str, int], int]:
    """(passages, number of each feature that recurs, how many numbers there are): what is too rare to have a number of its own shares the last one, so that it counts in the mean, as it does when a passage is scored."""
    unit_of: dict[object, int] = {}
    bare: list[str] = []  # of words only; None for pairs
    names: list[list[str]] = []
    flat, length = array("i"), np.empty(len(passages_of_words), np.int64)
    for k, ws in enumerate(passages_of_words):
        own = []
        for w in ws:
            u = unit_of.get(w)
            if u is None:
                u = unit_of[w] = len(names)
                bare.append(looks.unaccented(w))
                names.append(word_features(w))
            own.append(u)
        for a, b in zip(own[:], own[1:]):
            pair = (bare[a], bare[b])
            u = unit_of.get(pair)
            if u is None:
                u = unit_of[pair] = len(names)
                bare.append("")
                names.append([f"{pair[0]} {pair[1]}"])
            own.append(u)
        if not own:
            own.append(unit_of.setdefault((), len(names)))
            if own[0] == len(names):
                bare.append("")
                names.append([""])
        flat.extend(own)
        length[k] = len(own)
    units = np.asarray(flat, np.int32)
    owner = np.repeat(np.arange(len(length)), length)
    # in how many passages a unit stands; a feature recurs if its units stand in two
    once = np.unique(owner * len(names) + units)
    spread = np.bincount((once % len(names)).astype(np.int64), minlength=len(names))
    times: dict[str, int] = {}
    for f, n in zip(names, spread.tolist()):
        for x in set(f):
            times[x] = times.get(x, 0) + n
    vocabulary = {x: k for k, x in enumerate(x for x, n in times.items() if n >= 2)}
    rare = len(vocabulary)
    features = np.fromiter((vocabulary.get(x, rare) for f in names for x in f), np.int32)
    return Passages(units, length, features, np.fromiter(map(len, names), np.int64)), vocabulary, rare + 1


def fit(data: Passages, rows: np.ndarray, targets: np.ndarray, weights: np.ndarray, size: int, epochs: int = EPOCHS, dimensions: int = DIMENSIONS, rate: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(table of feature x class numbers, bias) from the passages ``rows``: embeddings and softmax by mini-batches of averaged gradients."""
    rng = np.random.default_rng(_SEED)
    e, w, bias = np.zeros((size, dimensions), np.float32), rng.standard_normal((dimensions, targets.shape[1])).astype(np.float32), np.zeros(targets.shape[1], np.float32)
    order = rng.permutation(rows)
    batches = [_Batch(data, order[at : at + 256]) for at in range(0, len(order), 256)]
    # one learning rate a feature (adaptive gradients)
    square, square_w, square_b = np.full(size, 1e-12, np.float32), np.full_like(w, 1e-6), np.full_like(bias, 1e-6)
    steps = epochs * len(batches)
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            lr = rate * (1 - step / steps)
            step += 1
            mean = b.means(e[b.distinct])
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - targets[b.rows]) * weights[b.rows, None]
            d = b.spread(g @ w.T)
            gw, gb = mean.T @ g, g.sum(0)
            square_w += gw * gw
            square_b += gb * gb
            square[b.distinct] += (d * d).mean(1)
            w -= 0.1 * lr * gw / np.sqrt(square_w)
            bias -= 0.1 * lr * gb / np.sqrt(square_b)
            e[b.distinct] -= lr * d / np.sqrt(square[b.distinct])[:, None]
    return e @ w, bias


class _Batch:
    """Some passages with their distinct units and these units' distinct features, ready to be summed in both directions."""

    def __init__(self, data: Passages, rows: np.ndarray) -> None:
        self.rows = rows
        units, n = data.of(rows)
        own, self.unit = np.unique(units, return_inverse=True)
        self.first = np.r_[0, np.cumsum(n)[:-1]]
        flat, m = _slices(data.features, data.unit_start, own), data.unit_length[own]
        self.distinct, self.feature = np.unique(flat, return_inverse=True)
        self.unit_first = np.r_[0, np.cumsum(m)[:-1]]
        self.length = np.add.reduceat(m[self.unit], self.first)[:, None].astype(np.float32)
        # the way back: passages by unit, units by feature
        by_unit = np.argsort(self.unit, kind="stable")
        self.passage_by_unit = np.repeat(np.arange(len(rows)), n)[by_unit]
        self.unit_starts = np.searchsorted(self.unit[by_unit], np.arange(len(own)))
        by_feature = np.argsort(self.feature, kind="stable")
        self.unit_by_feature = np.repeat(np.arange(len(own)), m)[by_feature]
        self.feature_starts = np.searchsorted(self.feature[by_feature], np.arange(len(self.distinct)))

    def means(self, table: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(table[self.feature], self.unit_first, axis=0)
        return np.add.reduceat(sums[self.unit], self.first, axis=0) / self.length

    def spread(self, gradient: np.ndarray) -> np.ndarray:
        by_unit = np.add.reduceat((gradient / self.length)[self.passage_by_unit], self.unit_starts, axis=0)
        return np.add.reduceat(by_unit[self.unit_by_feature], self.feature_starts, axis=0)


#: A fit to be done: rows to learn from, rows to judge by the result (none: the table itself is wanted), targets and weights of all rows.
Job = tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]


def work(data: Passages, size: int, job: Job, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) of a fit, or (probabilities of the judged rows, bias)."""
    learn, judge, targets, weights = job
    table, bias = fit(data, learn, targets, weights, size, epochs)
    table[-1] = 0
    if judge is None:
        return table, bias
    z = data.means(judge, table) + bias
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), bias


def one_by_one(data: Passages, size: int, epochs: int) -> Callable[[list[Job]], list[tuple[np.ndarray, np.ndarray]]]:
    return lambda jobs: [work(data, size, job, epochs) for job in jobs]


def on_executors(spark: SparkSession) -> Callable[[Passages, int, int], Callable[[list[Job]], list[tuple[np.ndarray, np.ndarray]]]]:
    """Fits as tasks: those of one list run side by side, on the passages that are sent once."""

    def runner(data: Passages, size: int, epochs: int) -> Callable[[list[Job]], list[tuple[np.ndarray, np.ndarray]]]:
        sent = spark.sparkContext.broadcast(data)

        def run(jobs: list[Job]) -> list[tuple[np.ndarray, np.ndarray]]:
            ordered = spark.sparkContext.broadcast(jobs)

            def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for n in b["n"]:
                        first, bias = work(sent.value, size, ordered.value[n], epochs)
                        yield pd.DataFrame({"n": [n], "columns": [first.shape[1]], "first": [first.astype("<f4").tobytes()], "bias": [bias.astype("<f4").tobytes()]})

            each = spark.range(0, len(jobs), 1, len(jobs)).withColumnRenamed("id", "n")
            rows = sorted(each.mapInPandas(task, "n long, columns int, first binary, bias binary").collect(), key=lambda r: r.n)
            return [(np.frombuffer(r.first, "<f4").reshape(-1, r.columns), np.frombuffer(r.bias, "<f4")) for r in rows]

        return run

    return runner


def train(documents: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], others: Sequence[Sequence[Sequence[str]]] = (), epochs: int = EPOCHS, rounds: int = ROUNDS, runner: Callable = one_by_one) -> Model | None:
    """The model of documents, given as the words of their passages and the votes that their raters gave each class; None if fewer than two classes have votes. ``others``: documents without votes, taken for unmarked."""
    docs, votes = [], []
    for found, given in documents:
        v = np.asarray(given, np.float32)
        if len(found) and v.sum():
            docs.append(found)
            votes.append(v / v.sum())
    if len(docs) < 2 or (np.asarray(votes).max(0) > 0).sum() < 2:
        return None
    voted = len(docs)
    docs += [found for found in others if len(found)]
    votes += [np.eye(len(CLASSES), dtype=np.float32)[0]] * (len(docs) - voted)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    data, vocabulary, size = numbered([p for d in docs for p in d])
    run = runner(data, size, epochs)
    vote = np.asarray(votes, np.float32)
    marked = vote[:, 0] < 0.5
    unmarked = np.where(owner >= voted, UNVOTED_WEIGHT, 1.0).astype(np.float32)
    targets, weights = vote[owner].copy(), unmarked
    half = (owner % 2).astype(bool)
    for _ in range(rounds):
        # each half is judged by the other one's model, which can't know its raters' errors by heart
        sides = [(np.flatnonzero(side), np.flatnonzero(~side)) for side in (half, ~half)]
        p = np.empty((len(data), len(CLASSES)), np.float32)
        for (_learn, judge), (found, _) in zip(sides, run([(learn, judge, targets, weights) for learn, judge in sides])):
            p[judge] = found
        other = 1 - p[:, 0]
        best = np.zeros(len(docs), np.float32)
        np.maximum.at(best, owner, other)
        # ordinary lines of a section that is often marked score somewhat high at first, but not beside the one that was meant
        guilty = marked[owner] & (other >= np.maximum(0.5, GUILTY_SHARE * best[owner]))
        kinds = vote[owner][:, 1:] / np.maximum(vote[owner][:, 1:].sum(1, keepdims=True), 1e-6)
        mine = p[:, 1:] / np.maximum(p[:, 1:].sum(1, keepdims=True), 1e-6)
        blend = 0.5 * kinds + 0.5 * mine
        targets = np.zeros_like(targets)
        targets[:, 0] = 1
        targets[guilty, 0] = 0
        targets[guilty, 1:] = blend[guilty] / blend[guilty].sum(1, keepdims=True)
        weights = np.where(guilty, np.float32(GUILTY_WEIGHT), unmarked)
        weights[~marked[owner] & (other > np.where(owner >= voted, DOUBTED, 0.9))] = 0
    table, bias = run([(np.arange(len(data)), None, targets, weights)])[0]
    return Model(vocabulary, table[:-1], bias)


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = SAMPLE_CHARS, unlabelled: int = UNLABELLED) -> tuple[list[tuple[list[list[str]], list[int]]], list[list[list[str]]]]:
    """(words of the passages, votes) of at most ``sample`` labelled documents, and the words of at most ``unlabelled`` others, with at most ``characters`` in all, chosen by a hash of their id; their texts are read on the executors."""
    counts = [F.count_if(F.col("label") == c).alias(c) for c in CLASSES]
    votes = labels.where(F.col("label").isin(*CLASSES) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*counts)
    sizes = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    sized = cut(lookup_join(sizes, votes, ["doc_id"]).withColumn("voted", F.col(CLASSES[0]).isNotNull()))
    chosen, room = [], characters
    for voted, most in ((True, sample), (False, unlabelled)):
        for r in sized.where(F.col("voted") == voted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            if r.n <= room:
                chosen.append((r.doc_id, r.n, [r[c] for c in CLASSES] if voted else None))
                room -= r.n
    if not chosen:
        return [], []
    chosen.sort(key=lambda c: c[0])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "words": ["\n".join(" ".join(words(p)) for p in passages(t)) for t in b["text"]]})

    ids = documents.sparkSession.createDataFrame([c[:2] for c in chosen], "doc_id long, n int")
    texts = lookup_join(documents.select("doc_id", "text", F.length("text").alias("n")), ids, ["doc_id", "n"], "inner").dropDuplicates(["doc_id"])
    same: dict[str, str] = {}  # one string for all places of a word
    found = {}
    for r in texts.select("doc_id", "text").mapInPandas(read, "doc_id long, words string").collect():
        if r.words:
            found[r.doc_id] = [[same.setdefault(w, w) for w in p.split(" ")] if p else [] for p in r.words.split("\n")]
    return [(found[i], v) for i, _, v in chosen if v and i in found], [found[i] for i, _, v in chosen if not v and i in found]


def model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of documents, see training_rows."""
    return train(*training_rows(documents, labels, sample), runner=on_executors(documents.sparkSession))


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, source, score, label): the probability of the worst passage of each document, and its class; none below ``threshold``."""
    sent = documents.sparkSession.sparkContext.broadcast(model(documents, labels, sample))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            worst, kind = np.zeros(len(b)), np.zeros(len(b), int)
            if m is None:
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": None, "label": None})
                continue
            batch: list[str] = []
            owner: list[int] = []
            for k, text in enumerate(b["text"]):
                found = passages(text)
                batch += found
                owner += [k] * len(found)
                if len(batch) >= 4000 or k == len(b) - 1 and batch:
                    p, passage = m.probabilities(batch)
                    document, bad = np.asarray(owner)[passage], 1 - p[:, 0]
                    by = np.lexsort((-bad, document))
                    first = by[np.r_[True, document[by][1:] != document[by][:-1]]]
                    at, more = document[first], bad[first] > worst[document[first]]
                    worst[at[more]], kind[at[more]] = bad[first][more], 1 + p[first][more, 1:].argmax(1)
                    batch, owner = [], []
            label = np.where(worst >= threshold, np.array(CLASSES, object)[kind], CLASSES[0])
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": worst, "label": label})

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id long, source string, score double, label string")


def marked(documents: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """(doc_id): documents with at least one abusive, hateful or sexual passage."""
    return scores(documents, labels, **options).where(f"label != '{CLASSES[0]}'").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """(source, documents, abuse, hate, sexual, rate): counts and the share of marked documents of each source."""
    s = scores(documents, labels, **options)
    counts = [F.count_if(F.col("label") == c).alias(c) for c in CLASSES[1:]]
    return s.groupBy("source").agg(F.count("*").alias("documents"), *counts, F.round(F.avg((F.col("label") != CLASSES[0]).cast("double")), 6).alias("rate"))
