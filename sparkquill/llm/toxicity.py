"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of fixed lexicons by kind (over the text and in its densest window) and of a lexicon learned
from labels, how near both stand to the second person, shares of capitals and punctuation, in the text and at lexicon words,
and rates of obfuscated words. Obfuscation is undone before words are looked up, and lexicon words count with their endings.
What the fixed lexicons hold is not learned again: the learned one has what they miss (other languages, compounds). Labels are
learned from the training rows alone, which fall into three parts by their crc32: the lexicon (words and word beginnings) is
learned on the first, trees on the second, and the calibration on the third, so that none judges what it has seen. At most
``most_rows`` labelled rows are fitted on, picked by a hash of their id; that is the one bounded sample here, and every row is
scored.

Defined results: null or empty texts have features of 0 and a score like other texts; rows that repeat are
all scored; labels with a null are not learned from; without labels of both kinds in each part the score is
a fixed function of the fixed lexicon's density; a null doc_id is scored and not held out; an empty table gives
an empty result; other columns of the input (lang, source and whatever their names) are never looked at.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Insults in the languages of the corpus, by kind.
KINDS = {
    "mind": """
        idiot moron stupid dumb retard imbecile fool clown idioten dumm dummkopf blöd blödmann trottel estúpido tonto imbécil payaso
        imbécile crétin débile abruti
    """,
    "worth": """
        loser scum trash garbage worthless pathetic disgusting pig vermin filth freak creep coward liar jerk abschaum widerlich wertlos
        erbärmlich versager basura escoria inútil patético asqueroso perdedor ordure déchet minable dégoûtant pathétique nul
    """,
    "crude": "bastard bitch asshole crap shit fuck fucking damn whore slut arschloch scheiße mierda puta cabrón connard merde salope",
    "threat": "hate kill",
}
LEXICON = {w: kind for kind, listed in KINDS.items() for w in listed.split()}
#: Lexicon words of at least this many letters count with any ending.
STEM = 5
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tú tu te ti tus usted ustedes vosotros vous votre vos toi ton ta".split())
MOST_ROWS, MOST_TERMS, TREES, DEPTH = 24_000, 4_096, 20, 4
#: Words of a window, and distances from the second person, in words.
WINDOW, DISTANCES = 20, (2, 5, 10)
FEATURES = [
    "log_words", *[f"{kind}_density" for kind in KINDS], "lexicon_density", "lexicon_window", *[f"lexicon_within_{d}" for d in DISTANCES],
    "learned_density", "learned_weight", "learned_window", *[f"learned_within_{d}" for d in DISTANCES], "second_person",
    "capitals", "capital_words", "capital_hits", "punctuation", "exclamations", "marked_hits", "obfuscated", "obfuscated_lexicon",
]
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"[0-9@$!|]?[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+|[^\W\d_](?:[.\-*_][^\W\d_]){3,}")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None})
_BEGINS = (4, 5, 6)
_EDGES = ".,;:!?\"'()[]{}<>#%&*$-"
#: Of each byte: 1 for A-Z, 2 for ASCII punctuation, 3 for ! and ?, else 0.
_BYTE_KIND = np.array([3 if c in "!?" else 2 if c in string.punctuation else 1 if c in string.ascii_uppercase else 0 for c in map(chr, range(256))])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


_STEMS = {w for w in LEXICON if len(w) >= STEM}
_STEM_BEGINS, _STEM_SIZES = {w[:STEM] for w in _STEMS}, sorted({len(w) for w in _STEMS}, reverse=True)


def kind_of(word: str) -> str | None:
    """The kind of a lower-case word that a fixed lexicon holds, or of the longest stem that it begins with."""
    if word in LEXICON or word[:STEM] not in _STEM_BEGINS:
        return LEXICON.get(word)
    return next((LEXICON[word[:k]] for k in _STEM_SIZES if word[:k] in _STEMS), None)


def _densest(at: np.ndarray) -> int:
    """The most of the ascending places ``at`` that one window of words holds."""
    return int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max()) if len(at) else 0


def _distances(at: np.ndarray, you: np.ndarray) -> np.ndarray:
    """How far each place is from the nearest of ``you``; both ascend."""
    if not len(at) or not len(you):
        return np.zeros(0)
    after = np.searchsorted(you, at)
    return np.minimum(np.abs(at - you[np.maximum(after - 1, 0)]), np.abs(you[np.minimum(after, len(you) - 1)] - at))


def features(text: str, words: dict[str, float], begins: dict[str, float], four: frozenset[str]) -> list[float]:
    """The features of one text, in the order of FEATURES; ``four`` has the first four letters of ``begins``."""
    tokens = text.split()
    hidden = {t: c for t in set(tokens) if not t.isalpha() and (c := t.lower().strip(_EDGES)) and not c.isalpha() and _HIDDEN.fullmatch(c)}
    shown = {t: y for t, c in hidden.items() if kind_of(y := c.translate(_PLAIN)) or y in words}
    odd = sum(1 for t in tokens if t in hidden) if hidden else 0
    unhidden = sum(1 for t in tokens if t in shown) if shown else 0
    source = " ".join(shown.get(t, t) for t in tokens) if shown else text
    found = _WORD.findall(source.lower())
    distinct = set(found)
    fixed = {w: kind for w in distinct if (kind := kind_of(w))}
    learned = {}
    for w in distinct:
        if w not in fixed and (w in words or w[:4] in four):
            weight = max(words.get(w, 0.0), *[begins.get(w[:k], 0.0) for k in _BEGINS])
            if weight:
                learned[w] = weight
    you = np.array([i for i, w in enumerate(found) if w in SECOND_PERSON], np.int64) if distinct & SECOND_PERSON else np.zeros(0, np.int64)
    kinds, at, at_learned = dict.fromkeys(KINDS, 0), [], []
    weight, shouted, marked = 0.0, 0, 0
    for i, m in enumerate(_WORD.finditer(source)) if fixed or learned else ():
        w = m.group().lower()
        if w in fixed:
            kinds[fixed[w]] += 1
            at.append(i)
        elif w in learned:
            weight += learned[w]
            at_learned.append(i)
        else:
            continue
        shouted += m.group().isupper()
        marked += source[m.end() : m.end() + 1] in ("!", "?")
    at, at_learned = np.array(at, np.int64), np.array(at_learned, np.int64)
    near, near_learned = _distances(at, you), _distances(at_learned, you)
    raw = np.frombuffer(text.encode(), np.uint8)
    size, per = max(1, len(raw)), max(1, len(found))
    kind_count = np.bincount(_BYTE_KIND[raw], minlength=4)
    shout = sum(1 for t in tokens if len(t) > 2 and t.isupper()) if kind_count[1] > 2 else 0
    return [
        float(np.log1p(len(found))), *(n / per for n in kinds.values()), len(at) / per, _densest(at) / WINDOW, *(float((near <= d).sum()) / per for d in DISTANCES),
        len(at_learned) / per, weight / per, _densest(at_learned) / WINDOW, *(float((near_learned <= d).sum()) / per for d in DISTANCES), len(you) / per,
        kind_count[1] / size, shout / per, shouted / per, (kind_count[2] + kind_count[3]) / size, kind_count[3] / size, marked / per, odd / per, unhidden / per,
    ]


def _feature_rows(words: dict[str, float], begins: dict[str, float]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        four = frozenset(b[:4] for b in begins)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = [features(t or "", words, begins, four) for t in part.column("text").to_pylist()]
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array([x for v in values for x in v], pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "_features"])

    return rows


def with_features(docs: DataFrame, words: dict[str, float], begins: dict[str, float]) -> DataFrame:
    """``docs`` (which has ``text``) and a column ``_features``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(_feature_rows(words, begins), schema)


def _terms(texts: DataFrame, most: int = MOST_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that mark label 1 and that no fixed lexicon holds, with their log odds; the ``most`` strongest of each."""
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}, {}
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("\\p{L}+"), F.lit(0))))
    known = F.col("w").isin(*LEXICON) | F.col("w").rlike("^(?:" + "|".join(sorted(_STEMS)) + ")")
    listed = texts.select("toxic", F.monotonically_increasing_id().alias("row"), word.alias("w")).where("length(w) > 2").where(~known)
    begins = F.explode(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in _BEGINS]))
    begun = listed.select("toxic", "row", begins.alias("w")).where("w is not null").distinct()
    out = []
    for rows in (listed, begun):
        counts = rows.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1.0))
        # a term must be frequent enough among label 1 and clearly rarer elsewhere
        strong = counts.where("t >= 4").withColumn("odds", odds).where("odds > 2.0")
        best = strong.orderBy((F.col("odds") * F.sqrt("t")).desc(), "w").limit(most)
        out.append({r.w: float(r.odds) for r in best.collect()})
    return out[0], out[1]


class Model:
    """What scoring needs: terms, trees and calibration (or none of them)."""

    def __init__(self, words: dict[str, float], begins: dict[str, float], trees=None, calibration=None):
        self.words, self.begins, self.trees, self.calibration = words, begins, trees, calibration

    def score(self, docs: DataFrame, out: str = "score") -> DataFrame:
        """``docs`` and a column ``out``. Columns have other names meanwhile, so none of theirs meets one of ours."""
        columns = docs.columns
        inner = docs.toDF(*["text" if c == "text" else f"in{i}" for i, c in enumerate(columns)])
        rows = with_features(inner, self.words, self.begins)
        if self.trees is None:
            density = F.col("_features")[FEATURES.index("lexicon_density")]
            scored = rows.withColumn("_score", 1 - F.exp(-40 * density))
        else:
            calibrated = self.calibration.setFeaturesCol("_margin").setPredictionCol("_calibrated").transform(_margin(self.trees, rows))
            # The step function has level parts; a thousandth of the trees' own order tells texts apart there.
            smooth = 1 / (1 + F.exp(-2 * F.col("_margin")))
            scored = calibrated.withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("_calibrated") + 0.001 * smooth)))
        return scored.select(*inner.columns, "_score").toDF(*columns, out)


def _margin(trees, rows: DataFrame) -> DataFrame:
    vector = rows.withColumn("_vector", array_to_vector("_features"))
    return trees.transform(vector).withColumn("_margin", vector_to_array("_raw")[1]).drop("_vector", "_raw", "_probability", "_prediction")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, trees: int = TREES, depth: int = DEPTH, most_terms: int = MOST_TERMS) -> Model:
    """Learns from labelled rows whose fold is not 0, at most about ``most_rows`` of them; ``most_terms`` 0: no lexicon is learned."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = usable.where(fold(F.col("doc_id")) != 0)
    n = train.count()
    if n > most_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    # At most about most_rows pairs of numbers: small enough to go to every task, so no text is shuffled for them.
    texts = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")
    texts = materialize(texts.withColumn("part", fold(F.col("doc_id"))), "labelled")
    kinds = {(r.part, r.toxic) for r in texts.select("part", "toxic").distinct().collect()}
    parts = {"terms": [1, 2], "trees": [3], "calibration": [4]}
    if any(not any((p, k) in kinds for p in of) for of in parts.values() for k in (0, 1)):
        return Model({}, {})
    words, begins = _terms(texts.where(F.col("part").isin(parts["terms"])), most_terms) if most_terms else ({}, {})
    rows = materialize(with_features(texts.where("part > 2").select("text", "part", "toxic"), words, begins).drop("text"), "features")
    of = lambda name: rows.where(F.col("part").isin(parts[name])).withColumn("label", F.col("toxic").cast("double"))
    gbt = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11)
    model = gbt.fit(of("trees").withColumn("_vector", array_to_vector("_features")).select("_vector", "label"))
    model.setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction")
    margins = _margin(model, of("calibration")).select("_margin", "label")
    return Model(words, begins, model, IsotonicRegression(featuresCol="_margin", labelCol="label").fit(margins))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels, **how).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
