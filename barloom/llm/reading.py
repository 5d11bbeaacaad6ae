"""Reading level: regularised ordinal regression over text features, calibrated to graded texts.

Features of a text: lexical diversity, word rarity, connectives, a clause-depth proxy and
lengths.  Rarity is the negative log of a word's share of all words of the corpus, which are
counted exactly; shares under ``LEAST_SHARE`` count as that share, so at most 1 / LEAST_SHARE
words have a rarity of their own and what is broadcast doesn't grow with the corpus.  The
proportional-odds model is fitted on the driver from the features of the graded texts, of
which at most ``MAX_GRADES`` ratings are used.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.storage import write_table

#: The share of all words at which rarity ends: rarer words are equally rare.
LEAST_SHARE = 2e-6
#: Distinct words a task holds before it passes their counts on, or starts its table of words anew (memory only).
HELD_WORDS = 300_000
#: Ratings used to fit the model; beyond it those of smallest hash.
MAX_GRADES = 20_000
GRADES = ("easy", "middle", "advanced")
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ["e.g", "i.e", "cf", "vs", "etc", "viz", "ca", "approx", "resp", "al", "fig", "eq", "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "inc", "ltd"]
#: Words that link sentences and main clauses, and words that open a subordinate clause, by language (English else).
CONNECTIVES = {
    "en": frozenset("and but or nor so yet therefore however moreover furthermore thus hence consequently nevertheless nonetheless accordingly besides likewise otherwise meanwhile instead finally".split()),
    "de": frozenset("und aber oder denn doch jedoch deshalb daher darum folglich außerdem zudem dennoch trotzdem ferner hingegen allerdings sonst schließlich also".split()),
    "fr": frozenset("et mais ou donc or ni car cependant toutefois néanmoins ainsi pourtant ensuite enfin aussi par conséquent d'ailleurs".split()),
    "es": frozenset("y e o u pero sino pues entonces además asimismo sin embargo no obstante así luego finalmente tampoco".split()),
}
SUBORDINATORS = {
    "en": frozenset("although because whereas while since unless until though if when whenever where notwithstanding insofar despite whether that which who whom whose whereby as after before once".split()),
    "de": frozenset("dass weil obwohl während wenn falls sofern bevor nachdem damit indem sobald solange ob welche welcher welches deren dessen wobei wodurch da als".split()),
    "fr": frozenset("que qui quand lorsque puisque parce quoique bien si comme dont où lequel laquelle afin tandis avant après".split()),
    "es": frozenset("que porque aunque cuando mientras si como donde quien cuyo cuya cual puesto para antes después".split()),
}
FEATURES = ("diversity", "rarity", "connectives", "clause_depth", "log_words_per_sentence", "letters_per_word", "long_words")

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?]+(?=\s|$)")
_SHORT = re.compile(r"(?:^|[^\w.])(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\.$", re.I)
_PAUSE = re.compile(r"[,;:(]|[—–]")


class _Words:
    """What is known of each word of a language, looked up once per worker."""

    def __init__(self, rarity: dict[str, float] | None, lang: str = "en"):
        self.rarity, self.most = rarity or {}, -np.log(LEAST_SHARE) if rarity else 0.0
        self.connectives, self.subordinators = CONNECTIVES.get(lang, CONNECTIVES["en"]), SUBORDINATORS.get(lang, SUBORDINATORS["en"])
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, 5))

    def learn(self, words: set[str]) -> None:
        index = self.index
        if len(index) > HELD_WORDS:
            index.clear()
        fresh = words.difference(index)
        at, need = len(index), len(index) + len(fresh)
        if need > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), 5))))
        for i, w in enumerate(fresh, at):
            letters = len(w) - sum(w.count(c) for c in "-'’")
            index[w] = i
            self.table[i] = letters, self.rarity.get(w, self.most), w in self.connectives, w in self.subordinators, letters >= 9

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def sentences(text: str) -> int:
    """Sentence ends of a text; a rest with a word after the last end counts as a sentence."""
    n, last = 0, 0
    for m in _STOP.finditer(text):
        if m.group() == "." and _SHORT.search(text, max(0, m.start() - 12), m.end()):
            continue
        if _WORD.search(text, last, m.start()):
            n += 1
        last = m.end()
    return n + bool(_WORD.search(text, last))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def text_features(text: str | None, words: list[str], known: _Words) -> tuple:
    """(n_words, n_sentences, words per sentence, letters per word, features...) of one text whose words are known; no words give nulls."""
    if not words:
        return (0, 0, None, None) + (None,) * len(FEATURES)
    at = known(words)
    seen = known.table[at]
    n, ends = len(words), max(1, sentences(text))
    letters, rare, connect, sub, long = seen.sum(0)
    span = 100  # windows of equal size, so that the measure doesn't fall with length
    if n <= span:
        diversity = len(set(words)) / n
    else:
        starts = [*range(0, n - span, span), n - span]  # the last ends where the text ends
        diversity = float(np.mean([len(set(at[i : i + span].tolist())) / span for i in starts]))
    pauses = len(_PAUSE.findall(text))
    per = n / ends
    return (n, ends, per, letters / n, diversity, rare / n, connect / n, (sub + pauses) / ends, float(np.log(per)), letters / n, long / n)


def word_rarity(docs: DataFrame, text: str) -> dict[str, float]:
    """The negative log share of each word of at least LEAST_SHARE, counted over all documents: at most 1 / LEAST_SHARE words."""

    def count(batches):
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace").decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > HELD_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = write_table(rows, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = counts.where(F.col("n") >= F.lit(LEAST_SHARE * total)).toPandas()
    return dict(zip(held["word"], np.log(total / held["n"].to_numpy(float)).tolist()))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> dict:
    """Proportional-odds logistic regression with an L2 penalty on the slopes (gradient steps with momentum)."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / sd
    n, d = z.shape
    k = len(GRADES)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k))[:-1] / n, 0.01, 0.99)
    cut, beta = np.log(share / (1 - share)), np.zeros(d)
    gap = np.append(cut[0], np.log(np.maximum(np.diff(cut), 1e-3)))
    m = v = np.zeros(d + k - 1)
    sig = lambda q: 1 / (1 + np.exp(-np.clip(q, -35, 35)))
    for step in range(1, rounds + 1):
        cut = gap[0] + np.append(0, np.cumsum(np.exp(gap[1:])))
        eta = z @ beta
        edges = np.concatenate(([-np.inf], cut, [np.inf]))
        hi, lo = sig(edges[grade + 1] - eta), sig(edges[grade] - eta)
        hi, lo = np.where(grade == k - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_beta = z.T @ (d_hi - d_lo) / n + ridge * beta / n
        g_cut = np.array([-(d_hi[grade == j].sum() - d_lo[grade == j + 1].sum()) / n for j in range(k - 1)])
        g_gap = np.append(g_cut.sum(), [np.exp(gap[j]) * g_cut[j:].sum() for j in range(1, k - 1)])
        g = np.concatenate((g_beta, g_gap))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        beta, gap = beta - move[:d], gap - move[d:]
    return {"mean": mean, "sd": sd, "beta": beta, "cut": gap[0] + np.append(0, np.cumsum(np.exp(gap[1:])))}


def grade_of(score: np.ndarray, model: dict) -> np.ndarray:
    return np.searchsorted(model["cut"], score)


def _features(docs: DataFrame, keep: list[str], text: str, rarity, model: dict | None) -> DataFrame:
    names = ["n_words", "n_sentences", "words_per_sentence", "letters_per_word"]

    def run(batches):
        known: dict[str, _Words] = {}
        for batch in batches:
            texts, langs = batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            langs = [x if x in CONNECTIVES else "en" for x in langs]
            rows: list = []
            for at in range(0, len(texts), 512):
                part = [(t, words_of(t), x) for t, x in zip(texts[at : at + 512], langs[at : at + 512])]
                for x in {x for _, _, x in part}:
                    known.setdefault(x, _Words(rarity.value, x)).learn({w for _, ws, y in part if y == x for w in ws})
                rows += [text_features(t, ws, known[x]) for t, ws, x in part]
            cols = list(zip(*rows)) if rows else [[]] * (4 + len(FEATURES))
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())]
            if model is None:
                out += [pa.array(c, pa.float64()) for c in cols[4:]]
                labels = [*names, *(f"f_{f}" for f in FEATURES)]
            else:
                x = np.array([[0.0 if v is None else v for v in r[4:]] for r in rows]).reshape(len(rows), len(FEATURES))
                score = ((x - model["mean"]) / model["sd"]) @ model["beta"]
                none = np.array([r[0] == 0 for r in rows], bool)
                level = np.array(GRADES, object)[grade_of(score, model)]
                out += [pa.array(score, pa.float64(), mask=none), pa.array(level.tolist(), pa.string(), mask=none)]
                labels = [*names, "score", "level"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *out], [*keep, *labels])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    schema += ", n_words bigint, n_sentences bigint, words_per_sentence double, letters_per_word double, "
    schema += ", ".join(f"f_{f} double" for f in FEATURES) if model is None else "score double, level string"
    return docs.select(*keep, F.col("lang").cast("string").alias("__lang"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_grades: int = MAX_GRADES):
    """The broadcast rarity table and the fitted model."""
    rarity = docs.sparkSession.sparkContext.broadcast(word_rarity(docs, text))
    order = F.xxhash64("doc_id", "rater", "grade")
    used = labels.select("doc_id", "rater", "grade").distinct().where(F.col("doc_id").isNotNull() & F.col("grade").isin(*GRADES)).orderBy(order).limit(max_grades)
    graded = docs.join(F.broadcast(used.select("doc_id").distinct()), "doc_id", "left_semi")  # at most max_grades rows
    rows = _features(graded, ["doc_id"], text, rarity, None).where("n_words > 0").join(used, "doc_id").toPandas()
    x = rows[[f"f_{f}" for f in FEATURES]].to_numpy(float)
    grade = rows["grade"].map({g: i for i, g in enumerate(GRADES)}).to_numpy(int)
    if len(x) == 0:
        model = {"mean": np.zeros(len(FEATURES)), "sd": np.ones(len(FEATURES)), "beta": np.zeros(len(FEATURES)), "cut": np.array([-0.5, 0.5])}
    else:
        model = fit_ordinal(x, grade)
    return rarity, model


def reading_levels(docs: DataFrame, labels: DataFrame, text: str = "text", max_grades: int = MAX_GRADES) -> DataFrame:
    """``doc_id, lang, n_words, n_sentences, words_per_sentence, letters_per_word, score, level`` per document.

    ``score`` is the linear predictor (higher is harder), ``level`` easy, middle or advanced.
    Words are runs of letters, also joined by hyphen or apostrophe; sentences end at . ! ? before
    white space or the end, not after an abbreviation.  Texts without a word (null, empty, scripts
    and symbols without letters) have 0 words and null measures.  The model is calibrated to the
    graded (English) texts; ``lang`` is passed on for filtering.  Without usable grades the score
    is 0 and the level middle.  Ratings that disagree all count; repeated ratings count once.
    """
    rarity, model = train(docs, labels, text, max_grades)
    return _features(docs, ["doc_id", "lang"], text, rarity, model)
