"""Language identification with interpolated Kneser-Ney character models, one per language.

The models are fit on a bounded sample of labelled rows (``per_language`` documents of each language, picked by the
hash of id and text) and are the only thing that comes to the driver. Every whole text of the input is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import map_arrow, text_chunks
from newsgraph.session import stored

PER_LANGUAGE = 2000  # bound of the labelled sample, documents of one language (expected number)
FOLDS = 5  # parts of the sample; each is explained by models of the others to calibrate the rejection
ORDER = 4
UNKNOWN = "und"
_SPACE = 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _classes() -> np.ndarray:
    """16-bit symbol of each code point: the lower-case letter, or a blank for what is no letter."""
    out = np.full(0x110000, _SPACE, np.uint16)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            out[point] = low if low <= 0xFFFF else 0xE000 + low % 0x1800
    return out


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts behind each other, each led by three blanks, and the place of each text's first symbol
    (one more for the end). Runs of blanks are one blank."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.array([ord(c) for t in texts for c in t], np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = _classes()[points]
    blank = symbols == _SPACE
    before = np.ones(len(blank), bool)
    before[1:] = blank[:-1]
    before[starts[:-1][starts[:-1] < len(blank)]] = True
    keep = ~(blank & before)
    kept_before = np.concatenate([[0], np.cumsum(keep)])[starts]
    lengths = np.diff(kept_before)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(kept_before[-1] + 3 * len(lengths), _SPACE, np.uint64)
    out[np.arange(kept_before[-1]) + 3 * (text_of + 1)] = symbols[keep]
    return out, kept_before


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-gram that ends at each symbol, and the range of each text in them."""
    s, starts = _symbols(data, offsets)
    packed = np.zeros(len(s), np.uint64)
    packed[3:] = (s[:-3] << np.uint64(48)) | (s[1:-2] << np.uint64(32)) | (s[2:-1] << np.uint64(16)) | s[3:]
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return packed[np.arange(starts[-1]) + 3 * (text_of + 1)], starts


def _hash(keys: np.ndarray) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * _MIX  # a bijection: no two keys meet
    return mixed ^ (mixed >> np.uint64(29))


def _low(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * symbols)) - 1)


class Model:
    """Log-probabilities of all languages at once, per order in arrays sorted by the hash of the n-gram."""

    def __init__(self, languages: list[str], language: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.languages = languages
        n = len(languages)
        per_order: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: []}
        for i in range(n):
            per_order[ORDER].append((keys[language == i], counts[language == i].astype(np.float64)))
        for order in range(ORDER - 1, 0, -1):  # how many different symbols stand before an n-gram
            per_order[order] = []
            for longer, _ in per_order[order + 1]:
                kinds, times = np.unique(_low(longer, order), return_counts=True)
                per_order[order].append((kinds, times.astype(np.float64)))
        symbols = np.unique(np.concatenate([k for k, _ in per_order[1]]))
        uniform = 1.0 / (len(symbols) + 1)
        self.uniform = float(np.log(uniform))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(1, ORDER + 1):
            seen = np.unique(np.concatenate([k for k, _ in per_order[order]]))
            contexts = np.unique(seen >> np.uint64(16))
            backoff = np.ones((len(contexts), n))
            direct = np.zeros((len(seen), n))
            for i, (own, times) in enumerate(per_order[order]):
                if not len(own):
                    continue
                ones, twos = (times == 1).sum(), (times == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = np.searchsorted(contexts, own >> np.uint64(16))
                total = np.bincount(at, times, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                known = total > 0
                backoff[known, i] = discount * kinds[known] / total[known]
                direct[np.searchsorted(seen, own), i] = (times - discount) / total[at]
            if order == 1:
                lower = np.full((len(seen), n), uniform)
            else:
                lower = np.exp(self._score(_low(seen, order - 1), order - 1))
            full = direct + backoff[np.searchsorted(contexts, seen >> np.uint64(16))] * lower
            self.grams[order] = self._sorted(seen, np.log(full))
            self.contexts[order] = self._sorted(contexts, np.log(backoff))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hash(keys)
        order = np.argsort(hashes)
        return hashes[order], np.ascontiguousarray(values[order], np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hash(keys)
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return at, table[0][at] == hashes

    def _score(self, keys: np.ndarray, order: int) -> np.ndarray:
        at, hit = self._find(self.grams[order], keys)
        out = self.grams[order][1][at]
        if not hit.all():
            missed = keys[~hit]
            context, known = self._find(self.contexts[order], missed >> np.uint64(16))
            weight = np.where(known[:, None], self.contexts[order][1][context], np.float32(0))
            if order == 1:
                out[~hit] = weight + np.float32(self.uniform)
            else:
                out[~hit] = weight + self._score(_low(missed, order - 1), order - 1)
        return out

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol of each text under each language, the number of symbols, and whether it has letters."""
        grams, starts = _grams(data, offsets)
        sizes = np.diff(starts)
        out = np.zeros((len(sizes), len(self.languages)))
        filled = np.flatnonzero(sizes)
        if len(filled):
            sums = np.add.reduceat(self._score(grams, ORDER), starts[filled], axis=0, dtype=np.float64)
            out[filled] = -sums / sizes[filled, None]
        letters = np.concatenate([[0], np.cumsum(_low(grams, 1) != _SPACE)])
        return out, sizes, letters[starts[1:]] > letters[starts[:-1]]


def held_out(doc_id: Column) -> Column:
    """The part that is never learned from: CRC-32 of the id as text, modulo 4, is 2. A NULL id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    labelled = labelled.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        # The text belongs to the draw: rows with one id, or with none, are not drawn together.
        (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)).alias("_u"),
        # Another hash than the one that picks the sample, so the folds do not depend on the rate.
        F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col), F.col(text_col)), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    rates = stored(
        labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("_rate")), "language_rates"
    )
    sample = labelled.join(rates, "lang").where(F.col("_u") < F.col("_rate"))
    return sample.select("lang", "text", "fold")


def _model(languages: list[str], language: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counts in which an n-gram of a language may stand several times, once per fold."""
    order = np.lexsort([keys, language])
    language, keys = language[order], keys[order]
    first = np.flatnonzero(np.r_[True, (language[1:] != language[:-1]) | (keys[1:] != keys[:-1])])
    return Model(languages, language[first], keys[first], np.add.reduceat(counts[order], first))


def _limits(
    n: int, blind: float, language: np.ndarray, entropy: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, float, float]:
    """The centre of each language, and what may be above it: a part that stays and one that shrinks with the length.

    A language that has texts in one fold only is explained by no other fold: its centre is a blind guess among the
    symbols. The two other parts are those of all languages together, so they are defined for few texts.
    """
    centres = np.full(n, blind)
    for own in np.unique(language):
        centres[own] = np.median(entropy[language == own])
    stays, shrinks = 0.05, 2.0
    if len(entropy):
        excess = np.maximum(entropy - centres[language], 0)
        stays += float(np.quantile(excess[size >= np.median(size)], 0.999))
        shrinks += float(np.max(np.maximum(excess - stays, 0) * np.sqrt(size)))
    return centres, 2 * stays, 2 * shrinks


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> dict | None:
    """The models and the rejection limits, or None if there is no labelled text with a letter.

    The models are fit on the whole sample. The limits come from the same texts at any size of the table: each fold of
    the sample is explained by models of the other folds.
    """
    sample = stored(_labelled_sample(docs, id_col, text_col, lang_col, per_language), "language_sample")
    languages = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            parts = list(zip(*(rows.column(k).to_pylist() for k in (0, 1)), strict=True))
            grams, starts = _grams(data, offsets)
            for part in set(parts):
                own = [grams[a:b] for a, b, p in zip(starts[:-1], starts[1:], parts, strict=True) if p == part]
                keys, times = np.unique(np.concatenate(own), return_counts=True)
                number, fold = (np.full(len(keys), x, np.int32) for x in (languages.index(part[0]), part[1]))
                yield pa.record_batch(
                    [pa.array(number), pa.array(fold), pa.array(keys.view(np.int64)), pa.array(times)],
                    ["lang", "fold", "gram", "n"],
                )

    counted = map_arrow(sample.select("lang", "fold", "text"), count, "lang int, fold int, gram long, n long")
    rows = counted.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    if not rows.num_rows:
        return None
    fold, keys, counts = rows["fold"].to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    # A language without any letter explains nothing and is no answer.
    lettered, language = np.unique(rows["lang"].to_numpy(), return_inverse=True)
    languages = [languages[i] for i in lettered]
    model = _model(languages, language, keys, counts)
    context = docs.sparkSession.sparkContext

    def explained(part: int) -> pa.Table | None:
        """Language, entropy and size of the texts of a fold whose language is known from the other folds."""
        others = fold != part
        known = np.unique(language[others])
        if not len(known):
            return None
        shared = context.broadcast(_model(languages, language[others], keys[others], counts[others]))

        def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in text_chunks(batches, "text"):
                entropy, sizes, letters = shared.value.cross_entropy(data, offsets)
                own = np.array([languages.index(x) for x in rows.column(0).to_pylist()], np.int32)
                best = entropy[:, known].min(axis=1)
                yield pa.record_batch(
                    [pa.array(own[letters]), pa.array(best[letters]), pa.array(sizes[letters].astype(np.int64))],
                    ["lang", "entropy", "size"],
                )

        texts = sample.where((F.col("fold") == part) & F.col("lang").isin([languages[i] for i in known]))
        out = map_arrow(texts.select("lang", "text"), calibrate, "lang int, entropy double, size long").toArrow()
        shared.unpersist()
        return out

    found = [x for x in map(explained, range(FOLDS)) if x is not None]  # three numbers per text of the sample
    none = {"lang": np.zeros(0, int), "entropy": np.zeros(0), "size": np.zeros(0, int)}
    seen = [np.concatenate([empty, *(x[c].to_numpy() for x in found)]) for c, empty in none.items()]
    limits = _limits(len(languages), -model.uniform, *seen)
    return {"model": context.broadcast(model), "limits": limits}


def identify(
    docs: DataFrame,
    fitted: dict | None,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns with ``lang_pred, score, accepted`` for every row.

    ``lang_pred`` has the least cross-entropy per symbol (ties: the language that sorts first), ``score`` is its
    share of the likelihoods at the weight of at most 20 symbols. ``accepted`` is false when even the best language
    explains the text worse than the calibrated limit of that language. Defined results: a text without letters
    (NULL, empty, digits) and any text when nothing could be learned is ``und`` with score 0, not accepted. Columns that a caller
    keeps must not be called like the three results. Empty input: no rows.
    """
    kept = docs.select(*[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    names = [*kept.columns[:-1], "lang_pred", "score", "accepted"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "_text"):
            own = list(rows.columns[:-1])
            if fitted is None:
                n = rows.num_rows
                yield pa.record_batch([*own, pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([False] * n)], names)
                continue
            model = fitted["model"].value
            centres, stays, shrinks = fitted["limits"]
            entropy, sizes, letters = model.cross_entropy(data, offsets)
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            weight = np.minimum(sizes, 20)[:, None]
            share = 1.0 / np.exp(-(entropy - least[:, None]) * weight).sum(axis=1)
            limit = centres[best] + stays + shrinks / np.sqrt(np.maximum(sizes, 1))
            labels = np.array([*model.languages, UNKNOWN], object)[np.where(letters, best, len(model.languages))]
            yield pa.record_batch(
                [
                    *own,
                    pa.array(labels.tolist(), pa.string()),
                    pa.array(np.where(letters, share, 0.0)),
                    pa.array(letters & (least <= limit)),
                ],
                names,
            )

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in kept.columns[:-1])
    out = map_arrow(kept, score, f"{fields}, lang_pred string, score double, accepted boolean")
    return out.toDF(*keep, "lang_pred", "score", "accepted")


def keep_accepted(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns kept."""
    fitted = fit(docs, id_col, text_col, lang_col, per_language)
    found = identify(docs, fitted, text_col, tuple(docs.columns))
    flags = found.columns[: len(docs.columns)]
    positional = found.toDF(*[f"_c{i}" for i in range(len(flags))], "_lang", "_score", "_accepted")
    kept = positional.where("_accepted").drop("_lang", "_score", "_accepted")
    return kept.toDF(*flags)
