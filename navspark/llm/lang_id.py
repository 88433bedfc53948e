"""The language of a text: unigram models over a fixed public vocabulary, summed over all segmentations.

A text is lower-cased; its words are runs of letters, led by the vocabulary's mark of a word's beginning and
cut into units of UNIT letters at most. A unit's probability in a language is the sum over all ways to
write it as pieces of the vocabulary of the product of the pieces' probabilities (forward algorithm); a
letter that isn't a piece by itself is spelt in the vocabulary's byte pieces. A text's is the product over its
units, times the language's share of the training documents; the language of greatest probability is the
prediction and its share of the sum over languages the score.

Piece probabilities are learnt by ROUNDS of expectation and maximisation: Spark counts the words of the
training documents by language, tasks sum the expected pieces of their words (forward and backward),
and only those sums, at most pieces x languages, reach the driver. Training documents have a text and a lang,
and crc32(doc_id as text) mod 4 isn't 2; of a language with more than SAMPLE of them, about SAMPLE of least
seeded hash are read. Prediction sees the text alone.

A null text, or one without a letter, is "und" with score 0, and so is every text where no language
could be learnt. A null doc_id is neither held out nor learnt from. Repeated rows count as often as they occur.
More than LANGUAGES distinct values of lang are an error, as the model is broadcast. An empty table gives
an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import claim, documents_view, table, text_slices, written

VOCABULARY, MARK = "piece_bpe_32k.model", "▁"
#: Letters of a unit, training documents of a language, rounds of learning, pseudo-count of each piece, values of lang.
UNIT, SAMPLE, ROUNDS, PSEUDO, SEED, LANGUAGES = 24, 20_000, 4, 0.01, 11, 1_000
#: Least probability of a step; with UNIT + 1 steps a unit's stays above the least double.
LEAST = 1e-12
#: Words that a worker remembers; cells of the forward table at once.
REMEMBERED, CELLS = 400_000, 1 << 19
#: Runs of letters, and of a few signs that count as numbers; those are taken out of the words found.
WORD = re.compile(r"[^\W\d_]+")
#: A long text is read in parts, which end behind a word where they can.
PART = re.compile(r"(?s).{1,1000000}(?:\W|$)|.{1,1000000}")
UNKNOWN = "und"


class Pieces:
    """The vocabulary as a tree of letters: sorted edges (node, letter), each edge's node, each node's piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.bytes = model.get_piece_size(), np.zeros(256, np.int64)
        edges: dict[tuple[int, str], int] = {}
        piece = [-1]
        for i in range(self.size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(name[3:-1], 16)] = i
            elif name.lower() == name and name.removeprefix(MARK).isalpha() or name == MARK:
                node = 0
                for c in name:
                    if (node, c) not in edges:
                        edges[node, c] = len(piece)
                        piece.append(-1)
                    node = edges[node, c]
                piece[node] = i
        keys = np.array([(n << 21) + ord(c) for n, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.piece = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(piece, np.int64)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Steps:
    """All steps (unit, end, length, piece) of all segmentations of units, by end and length."""

    def __init__(self, units: list[str], of: Pieces):
        self.length = np.array([len(u) for u in units], np.int64)
        wide = int(self.length.max(initial=1))
        letters = np.zeros((len(units), wide + 1), np.int64)
        at = np.arange(wide + 1) < self.length[:, None]
        letters[at] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        unit, start = np.nonzero(at)
        first_unit, first_start = unit, start
        node, depth, found, lone = np.zeros(len(unit), np.int64), 0, [], None
        while len(unit):
            key = (node << 21) + letters[unit, start + depth]
            place = np.minimum(of.keys.searchsorted(key), len(of.keys) - 1)
            alive = of.keys[place] == key
            depth += 1
            node = of.next[place]
            hit = alive & (of.piece[node] >= 0)
            if lone is None:
                lone = ~hit  # these letters are spelt in bytes
            found.append((unit[hit], start[hit] + depth, np.full(hit.sum(), depth), of.piece[node[hit]]))
            alive &= start + depth < self.length[unit]
            unit, start, node = unit[alive], start[alive], node[alive]
        spelt = np.flatnonzero(lone) if lone is not None else np.zeros(0, np.int64)
        found.append((first_unit[spelt], first_start[spelt] + 1, np.ones(len(spelt), np.int64), np.full(len(spelt), -1)))
        self.unit, self.end, self.size, self.piece = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        order = np.lexsort((self.size, self.end))
        self.unit, self.end, self.size, self.piece = (x[order] for x in (self.unit, self.end, self.size, self.piece))
        self.spelt = np.flatnonzero(self.piece < 0)
        signs = [chr(c).encode("utf-8", "surrogatepass") for c in letters[self.unit[self.spelt], self.end[self.spelt] - 1].tolist()]
        # The padding piece behind the vocabulary has probability 1.
        self.spelling = np.array([[*of.bytes[list(s)], *[of.size] * (4 - len(s))] for s in signs], np.int64).reshape(-1, 4)
        cuts = np.flatnonzero(np.diff(self.end * (wide + 2) + self.size, prepend=-1))
        self.groups = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.end)], strict=True))
        self.wide = wide

    def weights(self, model: np.ndarray) -> np.ndarray:
        """(step, language) for model (piece, language)."""
        out = model[self.piece]
        if len(self.spelt):
            out[self.spelt] = np.vstack([model, np.ones((1, model.shape[1]))])[self.spelling].prod(1)
        return np.maximum(out, LEAST)

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """(unit, end, language): the sum over segmentations of the unit's first letters."""
        out = np.zeros((len(self.length), self.wide + 1, weights.shape[1]))
        out[:, 0] = 1
        for a, b in self.groups:
            unit, end = self.unit[a:b], self.end[a]
            out[unit, end] += out[unit, end - self.size[a]] * weights[a:b]
        return out

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """The expected number of times that each step is taken, a step's language being its only column."""
        ahead = self.forward(weights)
        units = np.arange(len(self.length))
        back = np.zeros_like(ahead)
        back[units, self.length] = 1
        for a, b in reversed(self.groups):
            unit, end = self.unit[a:b], self.end[a]
            back[unit, end - self.size[a]] += back[unit, end] * weights[a:b]
        whole = ahead[units, self.length]
        return (ahead[self.unit, self.end - self.size] * weights * back[self.unit, self.end] / whole[self.unit])[:, 0]


def units_of(word: str) -> list[str]:
    """A word's letters, marked, in parts of UNIT letters."""
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
    return [MARK * (k == 0) + letters[k : k + UNIT] for k in range(0, len(letters), UNIT)]


def log_probabilities(words: list[str], model: np.ndarray, of: Pieces) -> np.ndarray:
    """(word, language) for model (piece, language)."""
    parts = [(i, u) for i, w in enumerate(words) for u in units_of(w)]
    out = np.zeros((len(words), model.shape[1]))
    most = max(16, CELLS // ((UNIT + 2) * model.shape[1]))
    parts.sort(key=lambda p: len(p[1]))
    for k in range(0, len(parts), most):
        some = parts[k : k + most]
        steps = Steps([u for _, u in some], of)
        whole = steps.forward(steps.weights(model))[np.arange(len(some)), steps.length]
        np.add.at(out, [i for i, _ in some], np.log(whole))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, sample: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, n) of the training documents that are read, and each language's number of training documents."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    sizes = {r["lang"]: r["n"] for r in rows}
    share = docs.sparkSession.createDataFrame([(k, sample / n) for k, n in sizes.items()], "name string, share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.join(F.broadcast(share), known["lang"] == share["name"]).where(draw < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in PART.findall(text.lower()):
                    found.setdefault(lang, Counter()).update(WORD.findall(part))
            for lang, words in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    return drawn.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), sizes


def learnt(docs: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, model (piece, language) and log shares of the languages; None where nothing can be learnt."""
    import public_tokenizers

    spark = docs.sparkSession
    counts, sizes = word_counts(docs, sample, seed)
    if not sizes:
        return None
    names = sorted(sizes)
    size = pieces(public_tokenizers.path(vocabulary)).size
    model = np.full((size, len(names)), 1 / size)
    counted = written(counts, "lang-words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((names, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import public_tokenizers

            of, (names, model) = pieces(public_tokenizers.path(vocabulary)), shared.value
            place = {k: i for i, k in enumerate(names)}
            total = np.zeros(model.size)
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                parts = sorted(((u, place[lang], n) for lang, w, n in rows for u in units_of(w)), key=lambda p: len(p[0]))
                for k in range(0, len(parts), CELLS // UNIT):
                    units, langs, n = zip(*parts[k : k + CELLS // UNIT], strict=True)
                    steps, langs = Steps(units, of), np.array(langs, np.int64)
                    weights = model[steps.piece, langs[steps.unit]]
                    spelt = langs[steps.unit[steps.spelt]]
                    if len(spelt):
                        weights[steps.spelt] = np.vstack([model, np.ones((1, len(names)))])[steps.spelling, spelt[:, None]].prod(1)
                    taken = steps.expected(np.maximum(weights, LEAST)[:, None]) * np.array(n, float)[steps.unit]
                    plain = steps.piece >= 0
                    total += np.bincount(steps.piece[plain] * len(names) + langs[steps.unit[plain]], taken[plain], model.size)
                    for column in steps.spelling.T if len(spelt) else ():
                        real = column < of.size
                        total += np.bincount(column[real] * len(names) + spelt[real], taken[steps.spelt[real]], model.size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        # At most pieces x languages sums.
        found = counted.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        model = np.zeros(model.size)
        model[found.column("cell").to_numpy()] = np.round(found.column("n").to_numpy(), 6)  # whatever order the sums were made in
        model = model.reshape(size, len(names)) + PSEUDO
        model /= model.sum(0)
        shared.unpersist()
    shares = np.log(np.array([sizes[k] for k in names], float) / sum(sizes.values()))
    return names, model, shares


class Scorer:
    """Log probabilities of texts; those of words seen lately are kept."""

    def __init__(self, model: np.ndarray, shares: np.ndarray, of: Pieces):
        self.model, self.shares, self.of = model, shares, of
        self.most = max(1_000, min(REMEMBERED, 4 * REMEMBERED // len(shares)))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.lettered = np.zeros((0, len(self.shares))), np.zeros(0, bool)

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) log probabilities, and whether each text has a letter."""
        parts = [(i, p) for i, t in enumerate(texts) for p in (PART.findall(t.lower()) if t else ())]
        out, lettered = np.tile(self.shares, (len(texts), 1)), np.zeros(len(texts), bool)
        start = 0
        while start < len(parts):
            stop = start + 1
            while stop < len(parts) and parts[stop][0] != parts[stop - 1][0]:
                stop += 1
            of = np.array([i for i, _ in parts[start:stop]])
            z, has = self._of_parts([p for _, p in parts[start:stop]])
            out[of] += z
            lettered[of] |= has
            start = stop
        return out, lettered

    def _of_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.clear()
        words = [WORD.findall(t) for t in texts]
        flat = [w for x in words for w in x]
        new = list({w for w in flat if w not in self.known})
        if new:
            self.known |= {w: len(self.known) + k for k, w in enumerate(new)}
            self.rows = np.vstack([self.rows, log_probabilities(new, self.model, self.of)])
            self.lettered = np.append(self.lettered, [any(map(str.isalpha, w)) for w in new])
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        out = np.stack([np.bincount(text, self.rows[at, k], len(texts)) for k in range(len(self.shares))], 1)
        return out, np.bincount(text, self.lettered[at], len(texts)) > 0


def predicted(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = learnt(docs, vocabulary, sample, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        scorer = None
        if shared.value:
            names, model, shares = shared.value
            scorer = Scorer(model, shares, pieces(public_tokenizers.path(vocabulary)))
            claim("language", scorer.clear)
        for batch in text_slices(batches, "text"):
            n = batch.num_rows
            best, score = [UNKNOWN] * n, np.zeros(n)
            if scorer:
                z, lettered = scorer.of_texts(batch.column(1).to_pylist())
                top = z.argmax(1)
                best = [names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, 1 / np.exp(z - z.max(1, keepdims=True)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return documents_view(docs, held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents"))
