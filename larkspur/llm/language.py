"""Language identification by hierarchical discrimination.

A text is folded to lower-case letters. Its byte n-grams (one to four bytes) are hashed into a fixed table, and their
frequencies are the features. Linear support vector machines first separate the language families, one against one;
then, within the winning family, one-versus-one machines separate the closely related languages. Votes decide, margins
break ties, and the least margin of the decisions, passed through a logistic curve, is the score. The curve's slope is fitted
on sample rows that the machines it is fitted with have not seen (each fifth row, set aside for a first fit).

Families come from the table below; a learned language that it does not name is a family of its own. A text's scores are
sums of table entries over its n-grams, so scoring makes one pass over the bytes and holds no feature vectors.

Defined results: null text and text without a letter give `und` with score 0; rows whose language is null are not learned
from; with no learned language everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bytewords
from larkspur.llm.common import text_slices

#: Family by ISO 639-1 code.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
    "fi": "uralic", "hu": "uralic", "et": "uralic", "tr": "turkic", "az": "turkic",
}
#: Whole texts of a language that the sample has at most, and of all languages together (the driver holds a row of 8,192
#: numbers for each); longer texts than SAMPLE_TEXT_BYTES (folded) are not taken into the sample.
SAMPLE_ROWS = 600
SAMPLE_ALL_ROWS = 12_000
SAMPLE_TEXT_BYTES = 256 << 10
SLOTS = 1 << 13
GRAMS = (1, 2, 3, 4)
EPOCHS = 40


def folded(text: str) -> Column:
    """The text in lower case with each run of other characters than letters as one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))


def gram_slots(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each gram length, the table slot of the gram that begins at each byte; bytes beyond the end of a row count as zero."""
    value = raw.astype(np.uint64)
    ends = np.unique(offsets[1:])
    code, out = np.zeros(len(raw), np.uint64), []
    for n in GRAMS:
        # The gram of n bytes from a position: the one of n - 1 bytes from it and the byte that follows.
        nxt = np.zeros(len(raw), np.uint64)
        nxt[: max(0, len(raw) - n + 1)] = value[n - 1 :]
        for back in range(1, n):
            at = ends - back
            nxt[at[at >= 0]] = 0
        code = code * np.uint64(257) + nxt + np.uint64(1)
        out.append((bytewords.mix64(code + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int32))
    return out


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(texts: list[str]) -> np.ndarray:
    """Gram frequencies of whole texts, a row each."""
    x = np.zeros((len(texts), SLOTS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        for slots in gram_slots(raw, np.array([0, len(raw)])):
            x[i] += np.bincount(slots, minlength=SLOTS)
        x[i] /= max(1, len(raw))
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear support vector machine by dual coordinate descent; y is +1 or -1."""
    scale = 1.0 / (np.sqrt((x * x).sum(1).mean()) + 1e-12)
    z = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
    norms, w, alpha = (z * z).sum(1), np.zeros(z.shape[1], np.float32), np.zeros(len(z))
    limit = c * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(z)):
            step = np.clip(alpha[i] - (y[i] * (z[i] @ w) - 1) / norms[i], 0, limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * z[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w[:-1] * np.float32(scale), float(w[-1])


class LanguageModel:
    """Pairwise machines between families and between the languages of each family."""

    def __init__(self, texts: list[str], langs: list[str]):
        x = features(texts) if texts else np.zeros((0, SLOTS), np.float32)
        aside = np.arange(len(texts)) % 5 == 4
        self.slope = 1.0
        if aside.any():
            self._fit(x[~aside], [g for g, a in zip(langs, aside, strict=True) if not a])
            self.slope = self._fitted_slope(x[aside], [g for g, a in zip(langs, aside, strict=True) if a])
        self._fit(x, langs)

    def _fitted_slope(self, x: np.ndarray, langs: list[str]) -> float:
        """The slope of the logistic curve from a row's least winning margin to whether its language is right: the one of
        highest likelihood (a right answer's share is smoothed, so that sure margins do not drive it to infinity)."""
        if not self.pairs:
            return 1.0
        best, least = self._decide(x @ self.table + self.bias)
        right = np.array([self.langs[b] == g for b, g in zip(best.tolist(), langs, strict=True)], float)
        share = (right * len(right) + 0.5) / (len(right) + 1)
        steps = np.geomspace(0.1, 100, 61)
        p = np.clip(1 / (1 + np.exp(-np.clip(np.outer(steps, least), -30, 30))), 1e-9, 1 - 1e-9)
        return float(steps[(share * np.log(p) + (1 - share) * np.log(1 - p)).sum(1).argmax()])

    def _fit(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        family = np.array([FAMILY.get(g, g) for g in self.langs])
        self.families = sorted(set(family.tolist()))
        self.family_of = np.array([self.families.index(f) for f in family], np.int64)
        code = np.array([self.langs.index(g) for g in langs], np.int64)
        self.pairs: list[tuple[str, int, int]] = []
        tables, bias = [], []
        kinds = [("family", a, b, self.family_of[code]) for a in range(len(self.families)) for b in range(a)]
        kinds += [("lang", a, b, code) for a in range(len(self.langs)) for b in range(a) if self.family_of[a] == self.family_of[b]]
        for kind, a, b, of in kinds:
            own = (of == a) | (of == b)
            w, b0 = fit_svm(x[own], np.where(of[own] == a, 1.0, -1.0))
            self.pairs.append((kind, a, b))
            tables.append(w)
            bias.append(b0)
        self.table = np.array(tables, np.float32).reshape(len(tables), SLOTS).T.copy()
        self.bias = np.array(bias)

    def margins(self, column: pa.Array) -> np.ndarray:
        """The value of every machine for every row of folded text."""
        raw, offsets = bytewords.utf8(column)
        total = np.zeros((len(offsets) - 1, self.table.shape[1]))
        step = 1 << 20
        rows = len(offsets) - 1
        at = 0
        while at < rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1)
            base, part = offsets[at], raw[offsets[at] : offsets[to]]
            for lo in range(0, max(1, len(part)), 4 * step):  # a longer text is summed in pieces that overlap by a gram
                hi = min(len(part), lo + 4 * step)
                own = np.clip(offsets[at : to + 1] - base, lo, hi) - lo
                seen = part[lo : min(len(part), hi + max(GRAMS) - 1)]
                ends = np.clip(offsets[at : to + 1] - base - lo, 0, len(seen))  # of rows, not of pieces: a gram may pass hi
                values = sum(self.table[s[: hi - lo]] for s in gram_slots(seen, ends))
                total[at:to] += _per_row(values, own)
            at = to
        return total / np.maximum(1, np.diff(offsets))[:, None] + self.bias

    def _decide(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, least margin of the decisions for it) of each row of machine values."""
        n = len(m)
        votes = {"family": np.zeros((n, len(self.families))), "lang": np.zeros((n, len(self.langs)))}
        for i, (kind, a, b) in enumerate(self.pairs):
            soft = np.tanh(m[:, i]) * 0.01
            votes[kind][:, a] += (m[:, i] > 0) + soft
            votes[kind][:, b] += (m[:, i] <= 0) - soft
        family = votes["family"].argmax(1)
        best = np.where(self.family_of[None, :] == family[:, None], votes["lang"], -np.inf).argmax(1)
        least = np.full(n, np.inf)
        for i, (kind, a, b) in enumerate(self.pairs):
            won = family if kind == "family" else best
            side = np.where(won == a, 1.0, np.where(won == b, -1.0, 0.0))
            least = np.where(side != 0, np.minimum(least, side * m[:, i]), least)
        return best, least

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        raw, offsets = bytewords.utf8(column)
        has = np.diff(offsets) > 0
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best, least = self._decide(self.margins(column) if self.pairs else np.zeros((n, 0)))
        sure = 1 / (1 + np.exp(-np.clip(self.slope * least, -30, 30)))
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, sure, 0.0)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: those whose identifier's checksum modulo 3 is not 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a sample of at most SAMPLE_ROWS whole texts a language, chosen by a hash of the row; one pass for all languages."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.shiftrightunsigned(F.xxhash64(id_col, text_col, F.lit(31)), 2).alias("lot"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return LanguageModel([], [])
    share = max(10, min(SAMPLE_ROWS, SAMPLE_ALL_ROWS // len(counts)))
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(g, min(1 << 62, int((1 << 62) * 1.2 * share / n))) for g, n in counts.items()], "lang string, below long"))
    picked = rows.join(bounds, "lang").where("lot < below").select("lang", "lot", folded("text").alias("t")).where(F.octet_length("t").between(1, SAMPLE_TEXT_BYTES))
    by_lang: dict[str, dict[int, str]] = {}
    for r in picked.toLocalIterator():  # about 1.2 times the sample
        own = by_lang.setdefault(r["lang"], {})
        own[r["lot"]] = r["t"]
    sample = [(t, lang) for lang, own in sorted(by_lang.items()) for _, t in sorted(own.items())[:share]]
    return LanguageModel([t for t, _ in sample], [g for _, g in sample])


def predict_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    model = train(docs, learnable(id_col), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each pair of languages

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "folded"):
            langs, scores = shared.value.predict(batch.column("folded"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), folded(text_col).alias("folded")).mapInArrow(add, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (~learnable("doc_id")).alias("held_out"), "lang_pred", "score")
