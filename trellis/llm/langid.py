"""Language identification in two steps: the language family, then one-versus-one linear support vector machines
between the languages of that family.

Features are hashed character trigrams of the whole text as shares of all its trigrams. The machines are fitted on
a sample of labelled rows, about MAX_SAMPLE and twice that at most, drawn evenly over the languages by a hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aim of the training sample (rows; twice that is collected at most), and of the rows of one language.
MAX_SAMPLE, PER_LANGUAGE = 2000, 500
DIM = 1 << 13
UNKNOWN = "und"
#: Language codes by family; a code in none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
}
_FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes.split()}
#: ASCII letters in lower case; other ASCII is a blank; bytes beyond ASCII stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULT = np.uint32(2654435761)
_STEP = 1 << 16


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of the words of a text, blanks between and around them included."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return ((((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * _MULT) >> np.uint32(32 - 13)).astype(np.int64)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient steps; y is +1 or -1. Both classes weigh the same."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    v = np.ones(d, np.float32)
    for _ in range(8):  # largest curvature
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / (1.0 + 2.0 * (norm + c))
    w = old = np.zeros(d, np.float32)
    b = old_b = 0.0
    for t in range(steps):
        m = t / (t + 3)
        u, ub = w + m * (w - old), b + m * (b - old_b)
        slack = weight * np.maximum(0, 1 - y * (x @ u + ub)) * y
        old, old_b = w, b
        w, b = u - step * (u - 2 * (x.T @ slack)), ub - step * (-2 * float(slack.sum()))
    return w.astype(np.float32), float(b)


class Model:
    """Machines as columns of one weight matrix: one per family, then one per pair of languages within a family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, scale: float):
        self.langs, self.scale = langs, scale
        self.families = sorted({family(a) for a in langs})
        self.members = [[i for i, a in enumerate(langs) if family(a) == f] for f in self.families]
        self.pairs = [[(a, b) for k, a in enumerate(m) for b in m[k + 1 :]] for m in self.members]
        columns = []
        fam = np.array([self.families.index(family(a)) for a in langs])[y] if len(y) else y
        if len(self.families) > 1:
            for f in range(len(self.families)):
                columns.append(fit_svm(x, np.where(fam == f, 1, -1).astype(np.float32)))
        for pairs in self.pairs:
            for a, b in pairs:
                own = (y == a) | (y == b)
                columns.append(fit_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32)))
        self.w = np.stack([w for w, _ in columns], 1) if columns else np.zeros((DIM, 0), np.float32)
        self.b = np.array([b for _, b in columns])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1; UNKNOWN and 0 for a text without a letter."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        h = trigrams(text.encode())
        total = np.zeros(self.w.shape[1])
        for i in range(0, len(h), _STEP):
            total += self.w[h[i : i + _STEP]].sum(axis=0, dtype=np.float64)
        margin = total * self.scale / max(1, len(h)) + self.b
        share = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        f, score, at = 0, 1.0, 0
        if len(self.families) > 1:
            p = share(margin[: len(self.families)])
            f, at = int(np.argmax(margin[: len(self.families)])), len(self.families)
            score = float(p[f])
        at += sum(map(len, self.pairs[:f]))
        votes = dict.fromkeys(self.members[f], 0.0)
        for k, (a, b) in enumerate(self.pairs[f]):
            p = float(share(margin[at + k]))
            votes[a] += p
            votes[b] += 1 - p
        best = max(votes, key=lambda i: (votes[i], -i))
        if len(votes) > 1:
            score *= votes[best] / (len(votes) - 1)
        return self.langs[best], min(1.0, max(0.0, score))


def fit(train: DataFrame, max_sample: int = MAX_SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with text and lang; rows with null in either are left out. Without rows it knows no language."""
    rows = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_sample // 2).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), 1.0)
    quota = min(per_language, max(2, max_sample // len(langs)))
    space = 1 << 30
    limits = F.create_map(*[F.lit(v) for a in langs for v in (a, min(space, -(-space * quota // counts[a])))])
    drawn = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(space))).where(F.col("_h") < limits[F.col("lang")])

    def run(batches):
        for b in batches:
            made = [np.unique(trigrams(t), return_counts=True) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([n.astype(np.float32) for _, n in made], pa.list_(pa.float32())), b.column(2)], names=["lang", "at", "n", "_h"])

    got = drawn.select("lang", "text", "_h").mapInArrow(run, "lang string, at array<int>, n array<float>, _h bigint").orderBy("_h").limit(2 * max_sample).collect()
    x, y = np.zeros((len(got), DIM), np.float32), np.array([langs.index(r["lang"]) for r in got], np.int64)
    for i, r in enumerate(got):
        if r["at"]:
            x[i, np.array(r["at"])] = np.array(r["n"], np.float32) / np.float32(sum(r["n"]))
    length = np.linalg.norm(x, axis=1)
    scale = float(1 / (length[length > 0].mean() or 1)) if (length > 0).any() else 1.0
    x *= scale
    kept = [i for i in range(len(langs)) if (y == i).any()]
    return Model([langs[i] for i in kept], x, np.searchsorted(kept, y) if len(kept) else y, scale)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no training sees: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from the whole text alone. Repeated rows each come back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights for each machine, whatever the input

    def run(batches):
        own = sent.value
        for b in batches:
            found = [own.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fit_and_identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score: fitted on the rows that aren't held out, applied to all."""
    model = fit(docs.where(~held_out("doc_id")), **options)
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
