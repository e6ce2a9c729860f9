"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the word classes of a clause: one marks insults, one marks words of harm as threats where the clause has
a target, one marks insults as aimed where it has one, and two mark what follows a negation or a verb of speech. Composed, they map a
clause's classes to the kinds of its offences; the path of the highest weight is taken. A document's score is a logistic
function of its offences' weights, summed by kind, and of their density; a word outside a matched clause adds nothing.

What is an insult, and how heavy, is learned from labelled documents: words and stems (beginnings of four to seven letters) whose
document counts differ between the labels by a likelihood ratio of at least RATIO, weighted by their log odds. The kinds' coefficients are fitted on
features for which each document's own fold had no part in the lexicon. Both take a sample of labelled rows that TOXIC and CLEAN bound, chosen by a
hash of the id. All documents are scored, whole.

Defined cases: a null or empty text has no clauses and gets the score of none; letters decide the words, upper case as lower; a document
without a label, or with a null id, is scored and never learned from; an id labelled several times has its highest label; rows that
repeat an id are scored each by its own text; without ten toxic and ten clean rows to learn from the coefficients are DEFAULT; of words and stems of
equal weight either gives the same score; very long texts are read whole; other columns aren't carried; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, stored
from .words import release, slices, split

# Words of closed classes, in four languages.
NEGATIONS = frozenset("not no never none without isn't aren't don't nicht kein keine keinen nie niemals ne pas jamais sans nunca ni sin jamás".split())
REPORTS = frozenset("said says say wrote writes called calls quoted claimed allegedly sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
TARGETS = frozenset(
    "you your yours yourself he him she her they them their all everyone people du dich dir dein deine ihr euch sie alle tu toi te ton vous votre ils elles tous tú ti usted ustedes vosotros ellos ellas todos".split()
)
THREATS = frozenset("kill hurt murder destroy burn beat crush shoot strangle töten schlagen verletzen umbringen tuer frapper mourir brûler matar golpear morir quemar".split())

#: Letters of a stem, the likelihood ratio that a word or stem must reach, and the least weight that counts.
STEMS, RATIO, LEAST = range(4, 8), 24.0, 1.0
#: Labelled rows that are learned from, about, and entries of the lexicon at most.
TOXIC, CLEAN, ENTRIES = 10_000, 20_000, 50_000
FOLDS = 5
KINDS = "IADnr"  # insult, aimed insult, threat, negated, reported
#: A kind's feature: threats are rare in labels and weigh as aimed insults do. The last feature is the density.
PLACE, FEATURES = [0, 1, 1, 2, 3], ["plain", "aimed", "negated", "reported", "density"]
DEFAULT = (-6.0, (2.0, 2.0, 0.5, 0.5, 0.5))
#: A threat's weight where the labels say nothing of its word.
THREAT = 3.0
#: Tokens whose classes a worker keeps.
KEPT = 400_000
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, read) -> [(written, weight, state)]; state 0 begins."""

    arcs: dict[tuple[int, str], list[tuple[str, float, int]]]
    finals: frozenset[int]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""
        arcs, names, todo = {}, {(0, 0): 0}, [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            for (state, read), own in self.arcs.items():
                if state != a:
                    continue
                for mid, w1, to_a in own:
                    for written, w2, to_b in other.arcs.get((b, mid), []):
                        to = (to_a, to_b)
                        if to not in names:
                            names[to] = len(names)
                            todo.append(to)
                        arcs.setdefault((names[pair], read), []).append((written, w1 + w2, names[to]))
        finals = frozenset(i for (a, b), i in names.items() if a in self.finals and b in other.finals)
        return Transducer(arcs, finals)

    def best(self, symbols: str) -> str:
        """What the accepted path of the highest weight writes, one sign a symbol."""
        paths = {0: (0.0, "")}
        for s in symbols:
            new: dict[int, tuple[float, str]] = {}
            for state, (weight, written) in paths.items():
                for sign, more, to in self.arcs.get((state, s), []):
                    if to not in new or new[to][0] < weight + more:
                        new[to] = (weight + more, written + sign)
            paths = new
        ends = [p for state, p in paths.items() if state in self.finals]
        return max(ends, key=lambda p: p[0])[1] if ends else "." * len(symbols)


def _machine(arcs: list[tuple[int, str, str, float, int]], finals: set[int], alphabet: str) -> Transducer:
    """Signs that a state has no arc for stay as they are; None is written for no arc at all."""
    made: dict = {}
    for state, read, written, weight, to in arcs:
        made.setdefault((state, read), []).append((written, weight, to))
    for state in {a[0] for a in arcs} | {a[4] for a in arcs}:
        for sign in alphabet:
            made.setdefault((state, sign), [(sign, 0.0, state)])
    return Transducer({k: [a for a in v if a[0]] for k, v in made.items()}, frozenset(finals))


def with_target(read: str, aimed: str, alone: str) -> Transducer:
    """`read` becomes `aimed` in a clause that has a target (T) before or after it, else `alone`. States: 0 nothing yet, 1 a target was
    seen, 2 one is owed, 3 there must be none."""
    arcs = [(0, "T", "T", 0.0, 1), (0, read, aimed, 1.0, 2), (0, read, alone, 0.0, 3), (1, read, aimed, 1.0, 1)]
    arcs += [(2, "T", "T", 0.0, 1), (2, read, aimed, 1.0, 2), (3, read, alone, 0.0, 3), (3, "T", "", 0.0, 3)]
    return _machine(arcs, {0, 1, 3}, "OHTNRIADnr.")


def after(mark: str, offences: str, written: str) -> Transducer:
    """Offences that follow the mark within the clause become `written`."""
    arcs = [(0, mark, mark, 0.0, 1)] + [(1, o, written, -0.5, 1) for o in offences]
    return _machine(arcs, {0, 1}, "OHTNRIADnr.")


#: Classes of a clause's words: O insult, H word of harm, T target, N negation, R verb of speech. Kinds: see KINDS.
INSULT = _machine([(0, "O", "I", 1.0, 0)], {0}, "OHTNRIADnr.")
GRAMMAR = INSULT.then(with_target("H", "D", ".")).then(with_target("I", "A", "I")).then(after("N", "IAD", "n")).then(after("R", "IADn", "r"))


class Reader:
    """Classes and weights of tokens under one lexicon, and the offences of texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.tokens: dict[str, tuple[int, float, bool]] = {}
        self.paths: dict[str, str] = {}

    def weight(self, word: str) -> float:
        """The largest weight of the word and its stems, told apart by a dash."""
        get = self.lexicon.get
        return max([get(word, 0.0), *(get(word[:n] + "-", 0.0) for n in STEMS if len(word) > n)])

    def read(self, token: str) -> tuple[int, float, bool]:
        """(class, weight, whether a clause ends here) of a run of anything but white space."""
        found = self.tokens.get(token)
        if found is None:
            sign, weight = 0, 0.0
            for word in LETTERS.findall(token.lower()):
                own = self.weight(word)
                if own >= LEAST and own > weight:
                    sign, weight = ord("O"), own
                elif word in THREATS and not sign:
                    sign, weight = ord("H"), THREAT
                elif not sign:
                    sign = ord("N") if word in NEGATIONS else ord("R") if word in REPORTS else ord("T") if word in TARGETS else 0
            found = sign, weight, token[-1] in ".!?;:"
            if len(self.tokens) >= KEPT:
                self.tokens.clear()
            if len(token) <= 40:
                self.tokens[token] = found
        return found

    def kinds(self, symbols: str) -> str:
        if len(symbols) > 30:
            return GRAMMAR.best(symbols)
        found = self.paths.get(symbols)
        if found is None:
            if len(self.paths) >= KEPT:
                self.paths.clear()
            found = self.paths[symbols] = GRAMMAR.best(symbols)
        return found

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(one row of FEATURES a text, matched clauses)."""
        codes, distinct, starts = split(texts)
        facts = [self.read(t) for t in distinct.to_pylist()]
        sign, weight, ends = (np.array([f[k] for f in facts], kind) for k, kind in enumerate((np.int64, np.float64, bool)))
        sums, matched = np.zeros((len(starts) - 1, len(FEATURES) - 1)), np.zeros(len(starts) - 1, np.int64)
        if len(codes):
            signs, stop = sign[codes], ends[codes]
            stop[starts[1:][np.diff(starts) > 0] - 1] = True
            clause = np.concatenate([[0], np.cumsum(stop)[:-1]])
            offence = (signs == ord("O")) | (signs == ord("H"))
            held = np.zeros(clause[-1] + 1, bool)
            held[clause[offence]] = True
            at = np.flatnonzero((signs > 0) & held[clause])
            doc = np.searchsorted(starts, at, side="right") - 1
            cuts = np.flatnonzero(np.diff(clause[at], prepend=-1, append=-1))
            letters = signs[at].astype(np.uint8).tobytes().decode()
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                some = False
                for kind, i in zip(self.kinds(letters[a:b]), range(a, b), strict=True):
                    k = KINDS.find(kind)
                    if k >= 0:
                        sums[doc[i], PLACE[k]] += weight[codes[at[i]]]
                        some = True
                matched[doc[a]] += some
        density = 200 * sums[:, :2].sum(1) / (np.diff(starts) + 20)
        return np.log1p(np.concatenate([sums, density[:, None]], 1)), matched


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(fold, label, text) of about TOXIC and CLEAN labelled documents that aren't held out, chosen by a hash of the id; equal texts of a
    label once."""
    told = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col).cast("int")).alias("label"))
    told = stored(told.withColumn("fold", fold("id")).where("fold <> 0"), "labels")
    many = {r.label: r.n for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r.label in (0, 1)}
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    few = [told.where((F.col("label") == k) & (place < min(1.0, most / many.get(k, 1)) * 1_000_000)) for k, most in ((0, CLEAN), (1, TOXIC))]
    few = F.broadcast(few[0].unionByName(few[1]))
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text")).join(few, "id")
    return stored(rows.groupBy("label", "text").agg(F.min("fold").alias("fold")), "labelled")


def candidate_counts(sample: DataFrame) -> DataFrame:
    """(candidate, c0, c1, ...): in how many documents of each fold and label a word, or a stem (with a dash), is; fold and label give the place."""
    width = 2 * (FOLDS - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(width)]
        for part in slices(batches, 2):
            for label, own_fold, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                found = set(LETTERS.findall(text.lower()))
                found |= {w[:n] + "-" for w in found for n in STEMS if len(w) > n}
                counts[2 * (own_fold - 1) + label].update(found)
        for a in range(0, len(every := list(set().union(*counts))), 100_000):
            some = every[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[w] for w in some], pa.int64()) for c in counts)], names)
        release()

    names = ["candidate", *[f"c{k}" for k in range(width)]]
    counted = sample.select("label", "fold", "text").mapInArrow(work, "candidate string, " + ", ".join(f"c{k} long" for k in range(width)))
    return counted.groupBy("candidate").agg(*[F.sum(n).alias(n) for n in names[1:]])


def likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Of a toxic and b clean documents that hold a candidate, against one rate for both labels; 0 where it isn't the toxic ones that hold it more."""
    def told(x, n):
        p = np.clip(x / n, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    def at(x, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    both = (a + b) / (toxic + clean)
    found = 2 * (told(a, toxic) + told(b, clean) - at(a, toxic, both) - at(b, clean, both))
    return np.where(a * clean > b * toxic, found, 0.0)


def lexicon_of(words: list[str], a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> dict[str, float]:
    if not (toxic and clean):
        return {}
    keep = likelihood_ratio(a, b, toxic, clean) >= RATIO
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    return {w: float(o) for w, o, k in zip(words, odds, keep, strict=True) if k and o >= LEAST}


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    intercept: float
    coefficients: tuple[float, ...]


def with_features(rows: DataFrame, lexicons: dict[int, dict[str, float]]) -> DataFrame:
    """(label, and FEATURES) of rows (fold, label, text), each read under its fold's lexicon."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {k: Reader(v) for k, v in shared.value.items()}
        for part in slices(batches, 2):
            for k, reader in readers.items():
                own = part.filter(pc.equal(part.column(0), k))
                if own.num_rows:
                    found = reader.features(own.column(2))[0]
                    yield pa.RecordBatch.from_arrays([own.column(1), *map(pa.array, found.T)], ["label", *FEATURES])
        release()

    return rows.select("fold", "label", "text").mapInArrow(work, "label int, " + ", ".join(f"{x} double" for x in FEATURES))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The lexicon and coefficients, learned from labelled documents outside the held-out fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    sizes = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda label, but=0: sum(n for (f, k), n in sizes.items() if k == label and f != but)
    toxic = sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS - 1)), F.lit(0))
    rows = candidate_counts(sample).where(toxic >= 4).orderBy(toxic.desc(), "candidate").limit(ENTRIES).toArrow()
    words = rows["candidate"].to_pylist()
    counts = np.stack([rows[f"c{k}"].to_numpy() for k in range(2 * (FOLDS - 1))]).astype(np.float64)
    lexicons = {}
    for f in range(FOLDS):  # 0: none is left out
        used = [k for k in range(FOLDS - 1) if k != f - 1]
        clean_in, toxic_in = (counts[[2 * k + y for k in used]].sum(0) for y in (0, 1))
        lexicons[f] = lexicon_of(words, toxic_in, clean_in, size(1, f), size(0, f))
    if min(size(0), size(1)) < 10:
        return ToxicityModel(lexicons[0], *DEFAULT)
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(stored(with_features(sample, lexicons), "features"))
    made = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, maxIter=50).fit(data)
    return ToxicityModel(lexicons[0], float(made.intercept), tuple(map(float, made.coefficients)))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_clauses): the score of every document, and its clauses that hold an offence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(shared.value.lexicon), np.array(shared.value.coefficients)
        for part in slices(batches, 1):
            found, matched = reader.features(part.column(1))
            score = 1 / (1 + np.exp(-np.clip(found @ weights + shared.value.intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(matched)], ["doc_id", "score", "n_clauses"])
        release()

    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_clauses long")
