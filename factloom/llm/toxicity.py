"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, slices, staged, strings

#: Labelled rows that the model learns from at most: those of the smallest id hashes.
SAMPLE_ROWS = 20_000
#: A lexicon unit stands this many standard deviations above the toxic share, in this many toxic rows; entries at most.
LEXICON_Z, LEXICON_ROWS, LEXICON_SIZE = 6.0, 4, 5_000
#: Lengths of the word beginnings that may be lexicon units beside whole words.
PREFIXES = (4, 5, 6, 7)
#: Words within which a second-person word counts as near.
NEAR = 5
#: Second-person words of the corpus languages, and characters that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "word_hits", "stem_hits", "distinct_hits", "strongest_hit", "hidden_hits", "hits_near_you", "second_person",
    "capitals", "shouted_words", "exclamations", "punctuation", "obfuscated_words", "stretched_words", "log_words",
)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _core(word: str) -> str:
    """A word in lower case without what surrounds it."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())


def units(core: str) -> list[str]:
    """What of a word can stand in the lexicon: the word, and its beginnings, marked by a trailing bar."""
    return [core, *[core[:n] + "|" for n in PREFIXES if len(core) > n]] if len(core) >= 3 else []


def _revealed(core: str) -> str:
    """A word with look-alike characters read as letters, and other signs within it left out."""
    return re.sub(r"[\W_\d]", "", core.translate(LOOKALIKES))


class WordTable:
    """What the features need of each distinct word."""

    def __init__(self, lexicon: dict[str, float], words: list[str]):
        n = len(words)
        self.hit, self.stem, self.hidden, self.you = (np.zeros(n, bool) for _ in range(4))
        self.caps, self.letters, self.marks, self.bangs = (np.zeros(n, np.int64) for _ in range(4))
        self.shouted, self.odd, self.stretched = (np.zeros(n, bool) for _ in range(3))
        self.weight = np.zeros(n)
        stretched, second = re.compile(r"([^\W\d_])\1\1"), set(SECOND_PERSON)
        for i, word in enumerate(words):
            core = _core(word)
            found = [lexicon[u] for u in units(core) if u in lexicon]
            if core and not core.isalpha():
                shown = _revealed(core)
                self.odd[i] = any(c.isalpha() for c in core) and shown != core
                if not found and self.odd[i] and (hidden := [lexicon[u] for u in units(shown) if u in lexicon]):
                    self.hidden[i], found = True, hidden
            self.hit[i] = core in lexicon
            self.stem[i] = bool(found) and not self.hit[i]
            self.weight[i] = max(found, default=0.0)
            self.you[i] = core in second
            if not word.islower():
                self.caps[i] = sum(c.isupper() for c in word)
            if not word.isalpha():
                self.marks[i] = sum(unicodedata.category(c)[0] in "PS" for c in word)
                self.bangs[i] = word.count("!")
            self.letters[i] = len(core)
            self.shouted[i] = self.caps[i] > 2 and word.isupper()
            self.stretched[i] = stretched.search(core) is not None


def features(text: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each text; all zero for a text without words."""
    split = pc.utf8_split_whitespace(text.cast(pa.large_string()))
    coded = pc.list_flatten(split).dictionary_encode()
    words = strings(coded.dictionary)
    table, at = WordTable(lexicon, words), coded.indices.to_numpy().astype(np.int64)
    blank = np.array([not w for w in words], bool)
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    if len(at) and blank.any():
        keep = ~blank[at]
        cuts, at = np.concatenate([[0], np.cumsum(keep)])[cuts], at[keep]

    def summed(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])

    n, doc = np.diff(cuts), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    any_hit = (table.hit | table.stem)[at] if len(at) else np.zeros(0, bool)
    out = np.zeros((len(n), len(FEATURES)))
    if not len(at):
        return out
    per = np.maximum(n, 1)
    letters = np.maximum(summed(table.letters[at]), 1)
    hits = np.flatnonzero(any_hit)
    you = np.concatenate([[0], np.cumsum(table.you[at])])
    low, high = np.maximum(hits - NEAR, cuts[doc[hits]]), np.minimum(hits + NEAR + 1, cuts[doc[hits] + 1])
    near = np.zeros(len(at), bool)
    near[hits] = you[high] > you[low]
    pairs = np.unique(np.stack([doc[hits], at[hits]]), axis=1)
    strongest = np.zeros(len(n))
    np.maximum.at(strongest, doc[hits], table.weight[at[hits]])
    columns = {
        "word_hits": summed(table.hit[at]) / per, "stem_hits": summed(table.stem[at]) / per, "distinct_hits": np.log1p(np.bincount(pairs[0], minlength=len(n))), "strongest_hit": strongest,
        "hidden_hits": summed(table.hidden[at]) / per, "hits_near_you": summed(near) / np.maximum(summed(any_hit), 1), "second_person": summed(table.you[at]) / per,
        "capitals": summed(table.caps[at]) / letters, "shouted_words": summed(table.shouted[at]) / per, "exclamations": summed(table.bangs[at]) / per, "punctuation": summed(table.marks[at]) / letters,
        "obfuscated_words": summed(table.odd[at]) / per, "stretched_words": summed(table.stretched[at]) / per, "log_words": np.log1p(n),
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = columns[name]
    return out


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """{unit: weight} from rows (text, toxic): units far more frequent in toxic rows than their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        toxic: Counter = Counter()
        for batch in batches:
            for text, label in zip(strings(batch["text"]), batch["toxic"].to_pylist()):
                found = {u for word in set(text.split()) for u in units(_core(word))}
                n.update(found)
                if label:
                    toxic.update(found)
        yield pa.RecordBatch.from_pydict({"unit": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()), "hits": pa.array([toxic[u] for u in n], pa.int64())})

    share = sample.agg(F.avg("toxic")).first()[0]
    counted = sample.select("text", "toxic").mapInArrow(run, "unit string, n long, hits long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    z = (F.col("hits") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    found = counted.where((F.col("hits") >= LEXICON_ROWS) & (z >= LEXICON_Z)).orderBy(z.desc(), "unit").limit(LEXICON_SIZE)
    return {r.unit: float(np.log((r.hits + 0.5) / (r.n - r.hits + 0.5) * (1 - share) / share)) for r in found.collect()}


def with_features(docs: DataFrame, lexicon: dict[str, float], prefix: str) -> DataFrame:
    """docs with a double for each feature, named by prefix and number."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")
    names = [*docs.columns, *[f"{prefix}{k}" for k in range(len(FEATURES))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                found = features(pc.fill_null(part.column(at), ""), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in found.T]], names)

    extra = "".join(f", {n} double" for n in names[len(docs.columns) :])
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, plain + extra)


def score(docs: DataFrame, labels: DataFrame, score_col: str = "score") -> DataFrame:
    """docs with score_col: 0 to 1, higher for likelier toxic, for every row.

    Learns from labels(doc_id, toxic) joined to docs, but for rows held out by their id's checksum: a lexicon and trees
    from three quarters of at most SAMPLE_ROWS labelled rows, the calibration from the rest. Only texts make a score.
    Null and empty texts get the score of a text without words; rows without a label or doc_id are scored as any other,
    repeated rows alike; several labels of a document count as their largest. Without labels of both kinds to learn
    from, every score is 0.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = staged(own.join(F.broadcast(known), "doc_id").withColumn("fold", F.abs(F.xxhash64(F.lit(1), "doc_id")) % 4), "toxic")
    kinds = {(r.part, r.toxic) for r in sample.select((F.col("fold") > 0).alias("part"), "toxic").distinct().collect()}
    if not {(True, 0.0), (True, 1.0)} <= kinds:
        return docs.withColumn(score_col, F.lit(0.0))
    fit, rest = sample.where("fold > 0"), sample.where("fold = 0")
    lexicon = learn_lexicon(fit)
    prefix = free_name("f", ["".join(c[:1] for c in docs.columns)]) + "_tox"
    names = [f"{prefix}{k}" for k in range(len(FEATURES))]
    vector, raw, chance, guess = (free_name(f"{prefix}_{x}", docs.columns) for x in ("vector", "raw", "chance", "guess"))
    assemble = VectorAssembler(inputCols=names, outputCol=vector)
    trees = GBTClassifier(featuresCol=vector, labelCol="toxic", predictionCol=guess, maxIter=20, maxDepth=3, stepSize=0.2, seed=7).setRawPredictionCol(raw).setProbabilityCol(chance)
    ready = staged(with_features(fit.select("text", "toxic"), lexicon, prefix).drop("text").coalesce(4), "features")
    model = trees.fit(assemble.transform(ready))
    margin = lambda df: model.transform(assemble.transform(df)).withColumn(chance, vector_to_array(chance)[1])
    if not {(False, 0.0), (False, 1.0)} <= kinds:
        rest = sample
    rest = staged(margin(with_features(rest.select("text", "toxic"), lexicon, prefix)).select(F.col(chance).alias("margin"), "toxic").coalesce(4), "margins")
    steps = IsotonicRegression(featuresCol="margin", labelCol="toxic").fit(rest)
    scored = margin(with_features(docs, lexicon, prefix))
    bounds, values = steps.boundaries.toArray(), steps.predictions.toArray()
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], _stepped(F.col(chance), bounds, values).alias(score_col))


def _stepped(x: Column, bounds: np.ndarray, values: np.ndarray) -> Column:
    """The calibration, joined by lines between its steps; a hundredth of x itself tells ties apart."""
    at = F.array(*[F.struct(F.lit(float(b)).alias("x"), F.lit(float(v)).alias("y")) for b, v in zip(bounds, values)])
    high = F.try_element_at(F.filter(at, lambda p: p["x"] > x), F.lit(1))
    low = F.try_element_at(F.filter(at, lambda p: p["x"] <= x), F.lit(-1))
    line = F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"]))
    return F.lit(0.99) * line + F.lit(0.01) * x
