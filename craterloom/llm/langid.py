"""Language identification with a string kernel.

The kernel of two texts is the number of distinct character n-grams (n = 1 .. 3, blended) that both
hold, divided by the geometric mean of what each shares with itself.  A bounded sample of labelled
passages is drawn, some of them become Nystroem landmarks, and one-versus-rest kernel ridge regression
is solved on the Nystroem features.  Landmark weights fold into one weight per n-gram and language,
so a batch of texts is scored by one product of its (sparse) presence matrix and that weight matrix.

An n-gram is its code points, packed into one 64-bit number without loss, so no script has to share
symbols with another one.  Letters are taken in lower case, digits as 0, white space as a blank and
whatever else as a full stop.

Parameters of the learning sample, all documented bounds: PASSAGE characters make a passage (every
labelled text is cut into passages from end to end, none is left out); PER_LANGUAGE passages are drawn
for each language, each passage of the table with the same chance; LANDMARKS of them are landmarks;
LANGUAGES is the most label values that are learned, more are an error, none is dropped; RIDGE is the
ridge.  Every text is scored whole.

Defined results
---------------
* Null text, or text without a letter: language ``und``, score 0.
* Rows with a null label or null id are not learned from; a null id is not held out.
* Without any labelled row every text is ``und``.  Equal scores go to the alphabetically first language.
* Repeated rows get equal results.  An empty table gives no rows.  Of the columns only the text (and,
  for learning, id and label) are looked at; ``identify`` replaces columns named lang_pred or score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from craterloom.llm.core import SLICE_BYTES, tidy

PER_LANGUAGE, LANDMARKS, RIDGE, LANGUAGES, PASSAGE = 400, 256, 1e-2, 500, 20_000
_TOP, _BITS = 0x110000, 21


class Symbols:
    """Code points as kernel symbols: 1 + the code point of the folded character (0 is free)."""

    def __init__(self):
        self.table = np.empty(_TOP, np.uint32)
        self.is_letter = np.zeros(_TOP, bool)
        for first in range(0, _TOP, 0x1000):
            text = [chr(p) for p in range(first, first + 0x1000)]
            letter, digit, space = (np.fromiter(map(f, text), bool, len(text)) for f in (str.isalpha, str.isdigit, str.isspace))
            part = np.arange(first, first + 0x1000, dtype=np.uint32)
            part[~letter] = ord(".")
            part[digit] = ord("0")
            part[space] = ord(" ")
            self.table[first:first + 0x1000] = part + 1
            self.is_letter[first:first + 0x1000] = letter

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_SYMBOLS: list[Symbols] = []


def symbols() -> Symbols:
    if not _SYMBOLS:
        _SYMBOLS.append(Symbols())
    return _SYMBOLS[0]


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams, n = 1 .. 3, each packed into 64 bits."""
    a = symbols().table[symbols().points(text)].astype(np.uint64)
    b = a[:-1] | a[1:] << np.uint64(_BITS)
    c = b[:-1] | a[2:] << np.uint64(2 * _BITS)
    return np.unique(np.concatenate([a, b, c]))


class Model:
    """languages, known n-grams (sorted) and their weights, one column per language."""

    #: Alphabets up to this size are looked up in a table of their own; the results are the same.
    SMALL = 128

    def __init__(self, languages: list[str], known: np.ndarray, weights: np.ndarray):
        self.languages, self.known = languages, known
        self.weights = np.vstack([weights, np.zeros((1, weights.shape[1]))])  # the last row: any other n-gram

    def __getstate__(self):
        return self.languages, self.known, self.weights[:-1]

    def __setstate__(self, state):
        self.__init__(*state)

    def _rows(self, texts: list[str]):
        """For each text the rows of the weights that its distinct n-grams have; unknown ones have the last."""
        points = [symbols().table[symbols().points(t)] for t in texts]
        there = np.zeros(_TOP + 1, bool)
        for p in points:
            there[p] = True
        alphabet = np.flatnonzero(there)
        n, none = len(alphabet) + 1, len(self.known)
        if n > self.SMALL:
            for t in texts:
                g = grams(t)
                at = np.minimum(np.searchsorted(self.known, g), max(0, none - 1))
                yield np.where(self.known[at] == g, at, none) if none else np.zeros(len(g), np.int64)
            return
        small = np.zeros(_TOP + 1, np.int32)
        small[alphabet] = np.arange(1, n)
        mask = np.uint64((1 << _BITS) - 1)
        parts = [(self.known >> np.uint64(_BITS * k) & mask).astype(np.int64) for k in range(3)]
        codes = [small[p] for p in parts]
        here = np.ones(none, bool)
        for p, c in zip(parts, codes):
            here &= (p == 0) | (c > 0)
        row = np.full(n**3, none, np.int32)
        row[(codes[0] + n * codes[1] + n * n * codes[2])[here]] = np.flatnonzero(here)
        flags = np.zeros(n**3, bool)
        for p in points:
            a = small[p]
            b = a[:-1] + n * a[1:]
            flags[a] = flags[b] = True
            flags[b[:-1] + n * n * a[2:]] = True
            g = np.flatnonzero(flags)
            flags[g] = False
            yield row[g]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if t and self.languages and symbols().is_letter[symbols().points(t)].any()]
        rows, counts, at = [], [], []

        def flush():
            if rows:
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                # presence matrix times weights: each text's rows of the weight matrix, added up
                s = np.add.reduceat(self.weights[np.concatenate(rows)], starts, axis=0) / np.sqrt(np.array(counts))[:, None]
                best = s.argmax(1)
                for i, j, v in zip(at, best, s[np.arange(len(s)), best]):
                    lang[i], score[i] = self.languages[j], min(1.0, max(0.0, round(float(v), 9)))
                rows.clear(), counts.clear(), at.clear()

        for i, r in zip(live, self._rows([texts[i] for i in live])):
            rows.append(r)
            counts.append(len(r))
            at.append(i)
            if len(rows) >= 256 or sum(counts) > 400_000:
                flush()
        flush()
        return lang, score


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features of the sample, then ridge regression of one-versus-rest targets."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty(0, np.uint64), np.zeros((0, 0)))
    sets = [grams(t) for t in texts]
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in languages}
    each = max(1, landmarks // len(languages))
    chosen = [i for x in languages for i in by[x][:each]]
    known = np.unique(np.concatenate([sets[i] for i in chosen]))  # only a landmark's n-grams can weigh

    def rows(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        return at[known[at] == s]

    present = np.zeros((len(known), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        present[rows(sets[i]), j] = 1
    norm = np.sqrt(np.array([max(1, len(s)) for s in sets], np.float64))
    present /= norm[chosen].astype(np.float32)
    k = np.stack([present[rows(s)].sum(0, dtype=np.float64) for s in sets]) / norm[:, None]
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # k_mm ** -1/2
    z = k @ root
    # classes weigh alike, whatever their share of the sample
    w = np.array([1 / len(by[y]) for y in langs])
    y = np.array([[float(x == l) for l in languages] for x in langs])
    a = (z * w[:, None]).T @ z + ridge * w.sum() / len(texts) * np.eye(z.shape[1])
    alpha = root @ np.linalg.solve(a, (z * w[:, None]).T @ y)
    return Model(languages, known, present.astype(np.float64) @ alpha)


def labelled_sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, per_language: int, languages: int = LANGUAGES, passage: int = PASSAGE) -> tuple[list, list]:
    """per_language passages of each language at most; every passage of the table has the same chance.

    The driver holds at most 1.25 * per_language * passage characters for a language, on average, before
    it cuts down to per_language.  More label values than languages are an error.
    """
    ok = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ok = ok.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.greatest(F.lit(1), F.ceil(F.length(text_col) / passage)).cast("int").alias("n"))
    sizes = {r[0]: r[1] for r in ok.groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "l").limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"{lang_col} has more than {languages} values; raise languages to learn them all")
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("l") == lang, F.lit(min(1.0, per_language * 1.25 / n))).otherwise(share)
    chance = lambda k: F.pmod(F.xxhash64("u", k), F.lit(1 << 30)) / float(1 << 30)  # noqa: E731  a number for each passage of each row
    drawn = ok.withColumn("u", F.rand(17)).withColumn("share", share)
    drawn = drawn.withColumn("ks", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: chance(k) < F.col("share"))).where(F.size("ks") > 0)
    drawn = drawn.select("u", "l", F.explode(F.transform("ks", lambda k: F.struct(k.alias("k"), F.substring("t", k * passage + 1, F.lit(passage)).alias("t")))).alias("p")).select("u", "l", "p.k", "p.t")
    texts, langs, seen = [], [], {}
    for r in sorted(drawn.withColumn("c", chance(F.col("k"))).collect(), key=lambda r: (r.c, r.u, r.k)):
        if seen.get(r.l, 0) < per_language:
            seen[r.l] = seen.get(r.l, 0) + 1
            texts.append(r.t)
            langs.append(r.l)
    return texts, langs


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced); only the text decides."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            step = max(1, len(b) * SLICE_BYTES // max(1, b[text_col].nbytes))
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                lang, score = sent.value.predict(part[text_col].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, languages: int = LANGUAGES, passage: int = PASSAGE) -> Model:
    return fit(*labelled_sample(docs, ~held_out(), "doc_id", "text", "lang", per_language, languages, passage), landmarks)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")
